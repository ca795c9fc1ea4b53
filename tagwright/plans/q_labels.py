"""Registered queries: labeller answers -> labelled dataset."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from tagwright import constants as K
from tagwright.operators import labels as L, metrics as M, prepare as P
from tagwright.plans import fixtures as fx, oracle as O
from tagwright.plans.registry import register
from tagwright.session import scratch_path


def unlabeled(spark: SparkSession, sf: str) -> DataFrame:
    return P.unlabeled_from_requests(P.build_request(fx.comments(spark, sf)))


def parsed(spark: SparkSession, sf: str) -> DataFrame:
    return L.parse_responses(fx.responses(spark, sf))


def merged(spark: SparkSession, sf: str) -> DataFrame:
    return L.merge_labels(unlabeled(spark, sf), L.last_valid_per_key(parsed(spark, sf)))


def class_spine(spark: SparkSession, n: int = K.NUM_CLASSES) -> DataFrame:
    return spark.range(n).select(F.col("id").cast("int").alias("class"))


def purge_class_counts(spark: SparkSession, sf: str) -> DataFrame:
    """Rows per class 0..3 after purge; classes outside 0..3 stay in the data but are not counted."""
    counts = L.purge_unlabeled(merged(spark, sf)).groupBy("class").agg(F.count(F.lit(1)).alias("n"))
    counts = counts.where(F.col("class").between(0, K.NUM_CLASSES - 1))  # <= K rows, safe to broadcast
    return (class_spine(spark).join(F.broadcast(counts), "class", "left")
            .select("class", F.coalesce("n", F.lit(0)).cast("bigint").alias("n")))


register("purge_class_counts", f"""
SELECT s.class, CAST(coalesce(c.n, 0) AS BIGINT) AS n FROM ({O.SPINE}) s
LEFT JOIN (SELECT class, count(*) AS n FROM ({O.PURGED}) p GROUP BY class) c ON s.class = c.class
""")(purge_class_counts)


@register("extract_nested", f"""
SELECT line_no, custom_id, content FROM ({O.PARSED}) p
""")
def q_extract_nested(spark, sf):
    return parsed(spark, sf).select("line_no", "custom_id", "content")


@register("parse_label_strict", f"""
SELECT line_no, content, class FROM ({O.PARSED}) p
""")
def q_parse_label_strict(spark, sf):
    return parsed(spark, sf).select("line_no", "content", "class")


@register("last_valid_per_key", O.LAST_VALID)
def q_last_valid(spark, sf):
    return L.last_valid_per_key(parsed(spark, sf))


@register("merge_labels", O.MERGED)
def q_merge_labels(spark, sf):
    return merged(spark, sf)


@register("purge_unlabeled", O.PURGED)
def q_purge(spark, sf):
    return L.purge_unlabeled(merged(spark, sf))


@register("response_errors", f"""
SELECT line_no, custom_id, reason FROM ({O.PARSED}) p WHERE reason IS NOT NULL
UNION ALL
SELECT CAST(NULL AS BIGINT) AS line_no, c.custom_id, 'no_answer' AS reason FROM ({O.COMMENTS}) c
WHERE NOT EXISTS (SELECT 1 FROM ({O.PARSED}) p WHERE p.custom_id = c.custom_id)
""")
def q_response_errors(spark, sf):
    return L.response_errors(parsed(spark, sf), fx.comments(spark, sf))


@register("dataset_counts", f"""
SELECT m.total, m.kept, m.total - m.kept AS removed, p.answers, p.errors, p.labeled_ids FROM
(SELECT count(*) AS total, count(*) FILTER (WHERE class <> -1) AS kept FROM ({O.MERGED}) x) m,
(SELECT count(*) AS answers, count(*) FILTER (WHERE reason IS NOT NULL) AS errors,
        count(DISTINCT custom_id) FILTER (WHERE class IS NOT NULL) AS labeled_ids FROM ({O.PARSED}) y) p
""")
def q_dataset_counts(spark, sf):
    m = merged(spark, sf).agg(F.count(F.lit(1)).alias("total"),
                              F.count_if(F.col("class") != K.UNLABELED).alias("kept"))
    p = parsed(spark, sf).agg(
        F.count(F.lit(1)).alias("answers"),
        F.count_if(F.col("reason").isNotNull()).alias("errors"),
        F.count_distinct(F.when(F.col("class").isNotNull(), F.col("custom_id"))).alias("labeled_ids"))
    return (M.side_by_side(m, p)  # two one-row aggregates
            .select("total", "kept", (F.col("total") - F.col("kept")).alias("removed"),
                    "answers", "errors", "labeled_ids"))


@register("observed_counts", f"SELECT count(*) AS total, count(*) FILTER (WHERE class <> -1) AS kept, count(*) FILTER (WHERE class = -1) AS removed FROM ({O.MERGED}) x")
def q_observed_counts(spark, sf):
    """Counts of a purge, taken while its rows are written."""
    c = L.write_purged(merged(spark, sf), scratch_path(spark, "purged"))
    return spark.createDataFrame([(c.total, c.kept, c.removed)], "total long, kept long, removed long")
