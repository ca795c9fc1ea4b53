"""Text functions: strip/lower with Unicode whitespace, message recovery, prompts."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from tagwright import constants as K


def _c(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def strip_ws(c) -> Column:
    """Python ``str.strip()``: remove leading/trailing Unicode whitespace.

    ``trim`` with an explicit character set touches only the two ends (a
    regex replace would scan the whole text).
    """
    return F.trim(_c(c), F.lit(K.WS_CHARS))


def clean_text(c) -> Column:
    """``strip().lower()``."""
    return F.lower(strip_ws(c))


def extract_message(c, marker: str = K.PROMPT_MARKER) -> Column:
    """Text after the first marker to the end, stripped; the fallback text when absent (F1).

    A substring search (``instr``, code-point positions) instead of a regex
    over the whole text.
    """
    col = _c(c)
    pos = F.instr(col, marker)
    after = col.substr(pos + F.lit(len(marker)), F.length(col))
    return (F.when(col.isNull(), F.lit(None).cast("string"))
            .when(pos > 0, strip_ws(after))
            .otherwise(F.lit(K.EXTRACT_FALLBACK)))


def compose_message(template: str, username, comment) -> Column:
    """``template + username + "+" + comment`` (P4); null in, null out."""
    return F.concat(F.lit(template), _c(username), F.lit("+"), _c(comment))


def prompt_infer(message, system_message: str = K.DEFAULT_SYSTEM_MESSAGE) -> Column:
    """Chat prompt without the answer."""
    return F.concat(F.lit(K.CHAT_SYSTEM_OPEN + system_message + K.CHAT_USER_OPEN),
                    _c(message), F.lit(K.CHAT_ASSISTANT_OPEN))


def prompt_train(message, label, system_message: str = K.DEFAULT_SYSTEM_MESSAGE) -> Column:
    """Chat prompt followed by the answer ``[label]``."""
    return F.concat(prompt_infer(message, system_message), F.lit("["), _c(label).cast("string"),
                    F.lit("]" + K.CHAT_TURN_END))
