"""Labeller answers: parse, keep the last valid answer per id, merge, purge, quarantine."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame, Observation, functions as F

from tagwright import constants as K
from tagwright.functions.labels import STRICT_PATTERN, parse_label_strict

REASON_BAD_JSON = "bad_json"
REASON_MISSING = "missing_content"
REASON_FORMAT = "bad_format"
REASON_NOT_TEXT = "not_text"
REASON_RANGE = "out_of_range"
REASON_NO_ID = "missing_id"
REASON_NO_ANSWER = "no_answer"


def answer_fields(raw: DataFrame, raw_col: str = "raw") -> DataFrame:
    """Add ok, custom_id, content and present to answer lines (P7), from one strict JSON parse; the raw line goes.

    A line is ok if it is exactly one JSON object: text after it, a second object on the line, quotes of another kind and
    blank lines are not. ``content`` is ``response.body.choices[0].message.content`` where that is text;
    ``present`` says that the path holds any value but null.
    """
    part = lambda path, kind: F.try_variant_get("_v", path, kind)
    d = raw.withColumn("_v", F.try_parse_json(F.concat(F.lit("["), F.col(raw_col), F.lit("]")))).drop(raw_col)
    d = d.withColumns({"_one": part("$[0]", "variant"), "_more": part("$[1]", "variant"),
                       "_content": part("$[0].response.body.choices[0].message.content", "variant")})
    d = d.withColumns({"ok": F.coalesce(F.schema_of_variant("_one").startswith("OBJECT") & F.col("_more").isNull(), F.lit(False)),
                       "_kind": F.schema_of_variant("_content")})
    fields = F.struct("ok", F.when(F.col("ok"), F.try_variant_get("_one", "$.custom_id", "string")).alias("custom_id"),
                      F.when(F.col("ok") & (F.col("_kind") == "STRING"), F.try_variant_get("_content", "$", "string")).alias("content"),
                      F.coalesce(F.col("ok") & (F.col("_kind") != "VOID"), F.lit(False)).alias("present"))
    # inline: a filter on the fields isn't pushed below it, which would parse the line again for every field it names
    return d.select(*[c for c in raw.columns if c != raw_col], F.inline(F.array(fields)))


def parse_responses(raw: DataFrame, raw_col: str = "raw", order_col: str = "line_no") -> DataFrame:
    """JSON answer lines -> (line_no, custom_id, content, class, reason).

    ``class`` is the strict parse (F2) and null when the line is not usable;
    ``reason`` says why: bad JSON, missing content, content that is no text, wrong format, a number beyond the class
    type, no id. The id of a corrupt line is null (the line carries none that can be trusted).
    """
    parsed = answer_fields(raw.select(F.col(order_col).alias("line_no"), F.col(raw_col).alias("raw")))
    parsed = parsed.withColumn("class", parse_label_strict("content"))
    reason = (F.when(~F.col("ok"), F.lit(REASON_BAD_JSON))
              .when(~F.col("present"), F.lit(REASON_MISSING))
              .when(F.col("content").isNull(), F.lit(REASON_NOT_TEXT))
              .when(F.col("class").isNull() & F.col("content").rlike(STRICT_PATTERN), F.lit(REASON_RANGE))
              .when(F.col("class").isNull(), F.lit(REASON_FORMAT))
              .when(F.col("custom_id").isNull(), F.lit(REASON_NO_ID)))
    return parsed.select("line_no", "custom_id", "content", "class", reason.alias("reason"))


def last_valid_per_key(parsed: DataFrame, key: str = "custom_id", order_col: str = "line_no") -> DataFrame:
    """Latest valid class per key (W3): a later invalid answer does not erase an earlier valid one.

    ``max_by`` is partially aggregated map-side, so a key with many answers
    never lands whole in one task.
    """
    return (parsed.where(F.col("class").isNotNull() & F.col(key).isNotNull())
            .groupBy(key).agg(F.max_by("class", order_col).alias("class")))


def merge_labels(unlabeled: DataFrame, labels: DataFrame, key: str = "custom_id") -> DataFrame:
    """Comments left-joined with parsed labels (J1); unmatched stay -1, unknown ids drop."""
    base = unlabeled.drop("class") if "class" in unlabeled.columns else unlabeled
    lab = labels.select(key, F.col("class").alias("_label"))
    return (base.join(lab, key, "left")
            .withColumn("class", F.coalesce(F.col("_label"), F.lit(K.UNLABELED)).cast("int"))
            .drop("_label"))


def purge_unlabeled(df: DataFrame) -> DataFrame:
    """Rows whose class is not -1."""
    return df.where(F.col("class") != K.UNLABELED)


def response_errors(parsed: DataFrame, comments: DataFrame, key: str = "custom_id") -> DataFrame:
    """Quarantine (J9): every unusable answer line, plus comments that got no answer."""
    bad = parsed.where(F.col("reason").isNotNull()).select("line_no", key, "reason")
    # distinct first (partially aggregated), so an id answered very often is one row before the anti join
    answered = parsed.where(F.col(key).isNotNull()).select(key).distinct()
    missing = (comments.select(key).join(answered, key, "left_anti")
               .select(F.lit(None).cast("bigint").alias("line_no"), key, F.lit(REASON_NO_ANSWER).alias("reason")))
    return bad.unionByName(missing)


class WriteCounts(NamedTuple):
    total: int
    kept: int

    @property
    def removed(self) -> int:
        return self.total - self.kept


def write_purged(df: DataFrame, path: str, label: str = "class") -> WriteCounts:
    """Write the labelled rows as Parquet; the counts of all and of kept rows are taken by the same pass.

    They are metrics observed on the rows as they are written, so nothing is scanned twice; a retried task counts once.
    """
    seen = Observation("purge")
    d = df.observe(seen, F.count(F.lit(1)).alias("total"), F.count_if(F.col(label).isNotNull() & (F.col(label) != K.UNLABELED)).alias("kept"))
    purge_unlabeled(d).write.mode("overwrite").parquet(path)
    return WriteCounts(**seen.get)
