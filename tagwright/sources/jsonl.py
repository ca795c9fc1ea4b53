"""Line-delimited JSON: labelling requests and labeller responses."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from tagwright import schemas
from tagwright.operators.labels import answer_fields
from tagwright.operators.prepare import request_content


def write_requests_jsonl(requests: DataFrame, path: str, mode: str = "overwrite") -> None:
    """One compact JSON object per line, non-ASCII kept as is."""
    requests.select(F.to_json(F.struct(*requests.columns)).alias("value")).write.mode(mode).text(path)


def read_requests_jsonl(spark: SparkSession, path: str) -> DataFrame:
    """Requests -> ``(custom_id, full_content)``; a malformed line fails the job."""
    req = spark.read.schema(schemas.REQUEST).option("mode", "FAILFAST").json(path)
    return request_content(req)


def read_responses_jsonl(spark: SparkSession, path: str) -> DataFrame:
    """Responses -> ``(custom_id, content, corrupt, line_key)`` (S3).

    Lines are read as text and decoded by ``answer_fields``, as in the table
    path, so a bad line is flagged, never fatal. ``line_key``
    orders lines like the files do (file, split start, position in the
    split), which is what "the last answer wins" needs.
    """
    lines = answer_fields(read_response_lines(spark, path))
    return lines.select("custom_id", "content", (~F.col("ok")).cast("int").alias("corrupt"), "line_key")


def read_response_lines(spark: SparkSession, path: str) -> DataFrame:
    """``(raw, line_key)`` for every line of the response files; feed to ``parse_responses(order_col='line_key')``."""
    t = spark.read.text(path)
    key = F.struct(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("start"),
                   F.monotonically_increasing_id().alias("seq"))
    return t.select(F.col("value").alias("raw"), key.alias("line_key"))
