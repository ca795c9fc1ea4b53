"""Preparing comments: projection, class init, dense row ids, requests, batches."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from tagwright import constants as K
from tagwright.session import ensure_checkpoint_dir
from tagwright.functions.text import compose_message, extract_message


def project_by_position(df: DataFrame, positions=(0, 2), names=("username", "comment")) -> DataFrame:
    """Keep columns by position and rename them."""
    cols = [F.col(f"`{df.columns[p]}`").alias(n) for p, n in zip(positions, names)]
    return df.select(*cols)


def init_class(df: DataFrame, name: str = "class") -> DataFrame:
    """Add the constant class -1."""
    return df.withColumn(name, F.lit(K.UNLABELED).cast("int"))


def select_features_target(df: DataFrame) -> DataFrame:
    """``custom_id, message, class``."""
    return df.select("custom_id", "message", F.col("class").cast("int").alias("class"))


def assign_row_id(df: DataFrame, order_cols, name: str = "row_idx", checkpoint: bool = True) -> DataFrame:
    """Dense zero-based position in ``order_cols`` order (P5), without a global window.

    ``order_cols`` should form a unique key: positions of tied rows are not
    defined, and a value shared by many rows would land in one range partition.

    The input is range-partitioned and sorted by Spark; the sorted data is
    checkpointed (shared ``spark.checkpoint.dir``) so partition contents are
    fixed. Each row's position is the row count of all earlier partitions
    (a prefix sum over one row per partition, broadcast) plus its position
    inside its own partition. No task ever holds more than its partition.
    """
    s = df.orderBy(*order_cols)
    if checkpoint:
        ensure_checkpoint_dir(df.sparkSession)
        s = s.checkpoint(eager=True)
    s = s.withColumn("_pid", F.spark_partition_id()).withColumn("_mid", F.monotonically_increasing_id())
    counts = s.groupBy("_pid").agg(F.count(F.lit(1)).alias("_n"))
    w = Window.orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("_pid", F.coalesce(F.sum("_n").over(w), F.lit(0)).alias("_off"))
    local = F.col("_mid") - F.shiftleft(F.col("_pid").cast("bigint"), 33)
    return (s.join(F.broadcast(offsets), "_pid")
            .withColumn(name, (F.col("_off") + local).cast("bigint"))
            .drop("_pid", "_mid", "_off"))


def ensure_custom_id(df: DataFrame, order_cols, key: str = "custom_id") -> DataFrame:
    """Keep an existing ``custom_id``; otherwise make ``row-<position>`` from the dense index (P5)."""
    if key in df.columns:
        return df
    return assign_row_id(df, order_cols, "_pos").withColumn(key, custom_id_from_index("_pos")).drop("_pos")


def custom_id_from_index(idx_col: str = "row_idx"):
    return F.concat(F.lit("row-"), F.col(idx_col).cast("string"))


def assign_batches(df: DataFrame, size: int, idx_col: str = "row_idx", name: str = "batch_id") -> DataFrame:
    """Consecutive fixed-size batches on the dense index; the last one short."""
    return df.withColumn(name, F.floor(F.col(idx_col) / F.lit(size)).cast("bigint"))


def build_request(df: DataFrame, template: str = K.DEFAULT_TEMPLATE, id_col: str = "custom_id",
                  username: str = "username", comment: str = "comment") -> DataFrame:
    """One nested chat request per comment (P6); the user message is P4.

    A comment with a null name or text has no message and gets no request; ``without_request`` returns these.
    """
    df = df.where(F.col(username).isNotNull() & F.col(comment).isNotNull())
    messages = F.array(
        F.struct(F.lit("system").alias("role"), F.lit(K.REQUEST_SYSTEM).alias("content")),
        F.struct(F.lit("user").alias("role"), compose_message(template, username, comment).alias("content")),
    )
    body = F.struct(F.lit(K.REQUEST_MODEL).alias("model"), messages.alias("messages"),
                    F.lit(K.REQUEST_STREAM).alias("stream"), F.lit(K.REQUEST_MAX_TOKENS).alias("max_tokens"))
    return df.select(F.col(id_col).alias("custom_id"), F.lit(K.REQUEST_METHOD).alias("method"),
                     F.lit(K.REQUEST_URL).alias("url"), body.alias("body"))


def without_request(df: DataFrame, username: str = "username", comment: str = "comment") -> DataFrame:
    """The rows that ``build_request`` leaves out, with a reason."""
    reason = F.when(F.col(comment).isNull(), F.lit("null_comment")).otherwise(F.lit("null_username"))
    return df.where(F.col(username).isNull() | F.col(comment).isNull()).withColumn("reason", reason)


def request_content(requests: DataFrame) -> DataFrame:
    """``(custom_id, full_content = body.messages[1].content)``."""
    return requests.select("custom_id", F.get(F.col("body.messages"), 1)["content"].alias("full_content"))


def unlabeled_from_requests(requests: DataFrame, marker: str = K.PROMPT_MARKER) -> DataFrame:
    """Recover ``(custom_id, message, class=-1)`` from the request text (F1 + P2)."""
    rc = request_content(requests)
    return init_class(rc.select("custom_id", extract_message("full_content", marker).alias("message")))
