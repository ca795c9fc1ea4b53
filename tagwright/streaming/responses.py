"""Labeller answers arriving as JSONL files -> a continuously updated label table.

Each micro-batch is parsed exactly like the batch path (``parse_responses``)
and its latest valid answer per id is appended to a changelog table,
partitioned by micro-batch id (overwriting that partition on a retry makes
the write idempotent). Line order inside a micro-batch is (file name, split
start, position), i.e. the writer's part order; across micro-batches the
later batch wins. The
current labels are a partially aggregated ``max_by`` over the changelog, so
an id answered in many batches is combined before any shuffle.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from tagwright.operators.labels import last_valid_per_key, parse_responses
from tagwright.session import drop_path, scratch_path


def response_lines_stream(spark: SparkSession, src_path: str, max_files_per_trigger: int | None = None) -> DataFrame:
    reader = spark.readStream.format("text")
    if max_files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", max_files_per_trigger)
    return reader.load(src_path).select(
        F.col("value").alias("raw"), F.col("_metadata.file_path").alias("_f"),
        F.col("_metadata.file_block_start").alias("_s"))


def _upsert(table_path: str, errors_path: str | None):
    def run(batch_df: DataFrame, batch_id: int) -> None:
        keyed = batch_df.withColumn("line_key", F.struct(
            F.lit(batch_id).cast("bigint").alias("batch"), "_f", "_s", F.monotonically_increasing_id().alias("seq")))
        parsed = parse_responses(keyed, order_col="line_key").persist()
        latest = (parsed.where(F.col("class").isNotNull() & F.col("custom_id").isNotNull())
                  .groupBy("custom_id").agg(F.max_by("class", "line_no").alias("class"), F.max("line_no").alias("line_no")))
        (latest.withColumn("batch_id", F.lit(batch_id).cast("bigint"))
         .write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("batch_id").parquet(table_path))
        if errors_path:
            (parsed.where(F.col("reason").isNotNull()).select("custom_id", "content", "reason")
             .withColumn("batch_id", F.lit(batch_id).cast("bigint"))
             .write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("batch_id")
             .parquet(errors_path))
        parsed.unpersist()
    return run


def start_label_stream(spark: SparkSession, src_path: str, table_path: str, errors_path: str | None = None,
                       checkpoint_location: str | None = None, available_now: bool = False,
                       max_files_per_trigger: int | None = None):
    """Start the stream; returns the ``StreamingQuery``."""
    lines = response_lines_stream(spark, src_path, max_files_per_trigger)
    w = lines.writeStream.foreachBatch(_upsert(table_path, errors_path)).option(
        "checkpointLocation", checkpoint_location or scratch_path(spark, "label-stream-ckpt"))
    if available_now:
        w = w.trigger(availableNow=True)
    return w.start()


def current_labels(spark: SparkSession, table_path: str) -> DataFrame:
    """Latest valid class per id over all micro-batches so far."""
    log = spark.read.parquet(table_path)
    return last_valid_per_key(log, order_col="line_no")


def compact_labels(spark: SparkSession, table_path: str) -> int:
    """Merge the changelog's micro-batches so far into one partition; returns how many were merged.

    The merged rows (latest answer per id, with its line key) are written first, then the merged partitions are dropped:
    a crash in between leaves rows twice, which ``current_labels`` resolves to the same labels. Not for use while another
    job reads the table; the stream itself only adds partitions and may go on.
    """
    log = spark.read.parquet(table_path)
    batches = sorted(r["batch_id"] for r in log.select("batch_id").distinct().collect())   # one per partition folder
    if len(batches) < 2:
        return 0
    newest = batches[-1]
    merged = min(batches[0], 0) - 1   # ids of merged partitions are negative and never those of a micro-batch
    (log.where(F.col("batch_id") <= newest).groupBy("custom_id")
     .agg(F.max_by("class", "line_no").alias("class"), F.max("line_no").alias("line_no"))
     .withColumn("batch_id", F.lit(merged).cast("bigint"))
     .write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("batch_id").parquet(table_path))
    for b in batches:
        drop_path(spark, f"{table_path.rstrip('/')}/batch_id={b}")
    return len(batches)
