"""Label parsers for labeller answers (strict) and model outputs (lenient)."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from tagwright import constants as K
from tagwright.functions.text import _c

WS, DIG = K.WS_CLASS, K.DIGIT_CLASS
# whole text must be [n], (n), mixed [n) / (n], or n, with surrounding whitespace
STRICT_PATTERN = rf"\A{WS}*(?:[\[(]({DIG}+)[\])]|({DIG}+)){WS}*\z"
# first bracketed number anywhere
BRACKET_PATTERN = rf"\[({DIG}+)\]"


def digits_to_int(s: Column) -> Column:
    """String of decimal digits of any script to INT; null when empty or out of range."""
    return _try_int(F.translate(s, K.OTHER_DIGITS, K.OTHER_DIGIT_VALUES))


def _try_int(s: Column) -> Column:
    return s.try_cast("int")


def parse_label_strict(c) -> Column:
    """Strict answer parser (F2): the class id, or null when the text is not valid.

    No range check: ``[7]`` parses to 7.
    """
    col = _c(c)
    g1 = F.nullif(F.regexp_extract(col, STRICT_PATTERN, 1), F.lit(""))
    g2 = F.nullif(F.regexp_extract(col, STRICT_PATTERN, 2), F.lit(""))
    return F.when(col.rlike(STRICT_PATTERN), digits_to_int(F.coalesce(g1, g2)))


def parse_label_lenient(c) -> Column:
    """Lenient model-output parser (F3): 0..3, or -1.

    The first ``[n]`` decides when present (n outside 0..3 gives -1, with no
    keyword fallback); otherwise keywords in fixed order on the lower-cased text.
    """
    col = _c(c)
    has_bracket = col.rlike(BRACKET_PATTERN)
    n = digits_to_int(F.regexp_extract(col, BRACKET_PATTERN, 1))
    low = F.lower(col)
    kw = F.lit(K.UNLABELED)
    for word, cls in reversed(K.LENIENT_KEYWORDS):
        kw = F.when(low.contains(word), F.lit(cls)).otherwise(kw)
    return (F.when(col.isNull(), F.lit(K.UNLABELED))
            .when(has_bracket, F.when(n.between(0, K.NUM_CLASSES - 1), n).otherwise(F.lit(K.UNLABELED)))
            .otherwise(kw)).cast("int")
