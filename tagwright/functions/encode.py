"""Fixed-length character encoding: vocabulary, ids, attention mask, prompt stripping."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, Window, functions as F

from tagwright import constants as K
from tagwright.functions.text import _c

MAX_VOCAB = 1_114_112  # number of Unicode code points: the proven bound of a character vocabulary


def chars(c) -> Column:
    """Code points of the text (empty text -> empty array)."""
    col = _c(c)
    return F.when(col == "", F.array().cast("array<string>")).otherwise(F.split(col, ""))


def char_vocabulary(df: DataFrame, text_col: str = "message") -> DataFrame:
    """``(char, n, id)``: characters of all texts by frequency; ids from 4 (0 pad, 1 unk, 2 start, 3 end).

    Counting is a distributed ``explode`` + partial ``groupBy``; only the
    distinct characters (bounded by the code-point count) are ranked.
    """
    counts = df.select(F.explode(chars(text_col)).alias("char")).groupBy("char").agg(F.count(F.lit(1)).alias("n"))
    rank = F.row_number().over(Window.orderBy(F.desc("n"), F.col("char")))  # over distinct characters only
    return counts.select("char", "n", (rank + K.END_ID).cast("int").alias("id"))


def vocabulary_dict(vocab: DataFrame) -> dict:
    """The learned vocabulary as a model object ``{char: id}``.

    Like Spark ML's CountVectorizerModel it is collected once, in one job; there are no more characters than code
    points, and more rows than that are an error.
    """
    rows = vocab.select("char", "id").limit(MAX_VOCAB + 1).collect()
    if len(rows) > MAX_VOCAB:
        raise ValueError(f"vocabulary of more than {MAX_VOCAB} entries exceeds the code-point bound")
    return {r["char"]: int(r["id"]) for r in rows}


def token_ids(c, vocab: dict, limit: int | None = None) -> Column:
    """Characters of the text (of its first ``limit`` ones if given) -> ids, unknown -> 1 (no start/end, no padding).

    JVM only: the vocabulary is one array literal indexed by code point, looked up per character.
    """
    by_point = [K.UNK_ID] * (max(map(ord, vocab), default=-1) + 1)
    for ch, i in vocab.items():
        by_point[ord(ch)] = i
    ids = F.from_json(F.lit(json.dumps(by_point)), "array<int>")  # folded to a literal by the optimizer
    text = _c(c) if limit is None else F.substring(_c(c), 1, limit)
    return F.transform(chars(text), lambda ch: F.coalesce(F.get(ids, F.ascii(ch)), F.lit(K.UNK_ID)))


def encode_fixed_length(ids, max_len: int = K.CLASSIFIER_MAX_LEN) -> Column:
    """``struct(input_ids, attention_mask, token_type_ids)`` from token ids (F12):
    start + ids + end, truncated and padded to ``max_len``."""
    core = F.concat(F.array(F.lit(K.START_ID)), F.slice(_c(ids), 1, max_len - 2), F.array(F.lit(K.END_ID)))
    n = F.size(core)
    ids = F.concat(core, F.array_repeat(F.lit(K.PAD_ID), F.lit(max_len) - n))
    mask = F.concat(F.array_repeat(F.lit(1), n), F.array_repeat(F.lit(0), F.lit(max_len) - n))
    types = F.array_repeat(F.lit(0), F.lit(max_len))
    return F.struct(ids.alias("input_ids"), mask.alias("attention_mask"), types.alias("token_type_ids"))


def causal_labels(input_ids) -> Column:
    """Causal-LM labels are a copy of the input ids, prompt and padding included."""
    return _c(input_ids)


def strip_prompt_tokens(input_ids, output_ids) -> Column:
    """Generated part of an output sequence: everything after the full input length."""
    inp, out = _c(input_ids), _c(output_ids)
    return F.slice(out, F.size(inp) + 1, F.greatest(F.size(out) - F.size(inp), F.lit(0)))
