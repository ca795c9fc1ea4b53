"""Derived input tables (FIXTURES.md section 3), computed by Spark from the parquet tables.

Pseudo-random numbers come from ``md5`` of a tag and the key, never from
``rand()``, so they do not depend on partitioning and have a DuckDB twin.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from tagwright.sources.tables import load


def u(tag: str, key: str = "doc_id") -> Column:
    """Uniform [0, 1) from the first 32 bits of md5('<tag>:<key>')."""
    h = F.md5(F.concat(F.lit(f"{tag}:"), F.col(key).cast("string")))
    return F.conv(F.substring(h, 1, 8), 16, 10).cast("bigint") / F.lit(4294967296.0)


def comments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, custom_id, username, comment, message."""
    d = load(spark, sf_dir, "documents")
    return d.select(
        "doc_id",
        F.concat(F.lit("row-"), F.col("doc_id").cast("string")).alias("custom_id"),
        F.col("source").alias("username"),
        F.col("text").alias("comment"),
        F.concat(F.col("source"), F.lit("+"), F.col("text")).alias("message"),
    )


def gold(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, custom_id, message, class: labels joined onto documents, -1 where absent."""
    c = comments(spark, sf_dir)
    lab = load(spark, sf_dir, "labels").select("doc_id", "quality", "toxic")
    return (c.join(lab, "doc_id", "left")
            .select("doc_id", "custom_id", "message",
                    F.coalesce(2 * F.col("quality") + F.col("toxic"), F.lit(-1)).cast("int").alias("class")))


def truth(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, custom_id, message, true_label drawn close to the published supports; one row in 97 has the unknown class 7."""
    c = comments(spark, sf_dir)
    y = u("y")
    lab = (F.when(F.col("doc_id") % 97 == 5, 7).when(y < 0.13, 0).when(y < 0.56, 1).when(y < 0.65, 2).otherwise(3)).cast("int")
    return c.select("doc_id", "custom_id", "message", lab.alias("true_label"))


def preds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, custom_id, message, true_label, base_pred, tuned_pred, confidence."""
    t = truth(spark, sf_dir)
    base = (F.when(u("v") < 0.2, F.lit(-1))
            .when(u("b") < 0.55, F.col("true_label"))
            .otherwise(F.floor(4 * u("b2")).cast("int"))).cast("int")
    tuned = (F.when(F.col("doc_id") % 89 == 3, F.lit(7)).when(u("t") < 0.8, F.col("true_label"))
             .otherwise(F.floor(4 * u("t2")).cast("int"))).cast("int")
    conf = F.round(0.25 + 0.75 * u("c"), 6)
    return t.select("doc_id", "custom_id", "message", "true_label",
                    base.alias("base_pred"), tuned.alias("tuned_pred"), conf.alias("confidence"))


# content of the labeller's answer by doc_id % 12 (escaped newline stays escaped in JSON)
RESPONSE_CONTENT = ["[0]", "(1)", "2", " [3]\\n", "[7]", "It is 1", "", "Not Negative", "[1", "mild",
                    "It is [2], not [0]", "[1]"]


def response_json(custom_id: Column, content: Column) -> Column:
    return F.concat(F.lit('{"custom_id": "'), custom_id,
                    F.lit('", "response": {"body": {"choices": [{"message": {"content": "'), content,
                    F.lit('"}}]}}}'))


def damaged(raw: Column, custom_id: Column) -> Column:
    """The answer lines of some documents with the faults that labellers' files show, by doc_id % 29."""
    k = F.col("doc_id") % 29
    number = F.concat(F.lit('{"custom_id": "'), custom_id, F.lit('", "response": {"body": {"choices": [{"message": {"content": 1}}]}}}'))
    no_id = F.lit('{"response": {"body": {"choices": [{"message": {"content": "[1]"}}]}}}')
    return (F.when(k == 1, F.concat(raw, F.lit(" done"))).when(k == 2, F.concat(raw, raw))
            .when(k == 3, F.translate(raw, '"', "'")).when(k == 4, number).when(k == 5, no_id)
            .when(k == 6, response_json(custom_id, F.lit("[99999999999]"))).when(k == 7, F.lit(""))
            .when(k == 8, F.concat(raw, F.lit(", "), raw)).otherwise(raw))


def responses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """line_no, custom_id, raw: the labeller's answers as JSON text lines."""
    d = load(spark, sf_dir, "documents").select("doc_id")
    cid = F.concat(F.lit("row-"), F.col("doc_id").cast("string"))
    content = F.element_at(F.array(*[F.lit(x) for x in RESPONSE_CONTENT]),
                           (F.col("doc_id") % 12 + 1).cast("int"))
    first = d.where(F.col("doc_id") % 17 != 0).select(
        (2 * F.col("doc_id")).alias("line_no"), cid.alias("custom_id"),
        damaged(F.when(F.col("doc_id") % 19 == 0, F.lit("{bad")).otherwise(response_json(cid, content)), cid).alias("raw"))
    second = d.where((F.col("doc_id") % 13 == 0) & (F.col("doc_id") % 17 != 0)).select(
        (2 * F.col("doc_id") + 1).alias("line_no"), cid.alias("custom_id"),
        response_json(cid, F.when(F.col("doc_id") % 2 == 0, F.lit("[3]")).otherwise(F.lit("sorry"))).alias("raw"))
    return first.unionByName(second)


def history(spark: SparkSession, sf_dir: str) -> DataFrame:
    """run_id, epoch, m: one metric series per event type over days.

    The epoch is the dense rank of the day; the rank is taken on the small
    (run, day) aggregate, so no task ever sees raw events of a whole run.
    """
    ev = load(spark, sf_dir, "events").select("event_type", "ts", "value")
    per_day = ev.groupBy(F.col("event_type").alias("run_id"), F.to_date("ts").alias("day")) \
        .agg(F.avg("value").alias("m"))
    w = Window.partitionBy("run_id").orderBy("day")
    return per_day.select("run_id", F.dense_rank().over(w).cast("int").alias("epoch"), "m")
