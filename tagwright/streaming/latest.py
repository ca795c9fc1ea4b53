"""Latest valid answer per id held as keyed state of the stream, with expiry.

``responses.py`` appends to a changelog that has to be merged from time to time. Here the state store itself is the
table: one value per id, replaced in place, read with Spark's state reader. An answer's place is (file, split start,
position), as in the batch read, so the result does not depend on when which file arrives: the last valid answer by
place wins, a later invalid one erases nothing.

Answers of one id within an Arrow batch are reduced to the last one before the shuffle, so an id that is answered very
often sends one row per batch, not one per answer. An id whose answer was not renewed for ``keep_for_ms`` of
processing time expires: it no longer counts for later answers, and is removed by a later micro-batch.

Needs the RocksDB state store; ``use_keyed_state`` sets it for the session if the session has no choice of its own.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from tagwright.operators.labels import parse_responses
from tagwright.streaming.responses import response_lines_stream

_PROVIDER = "spark.sql.streaming.stateStore.providerClass"
_IDLE_BATCHES = "spark.sql.streaming.noDataMicroBatches.enabled"
_ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
_PLACE = ["file", "start", "seq"]
_ANSWERS = "custom_id string, file string, start long, seq long, class int"
_STATE, _STATE_SCHEMA = "latest", "file string, start long, seq long, class int"


def use_keyed_state(spark: SparkSession) -> None:
    if "RocksDB" not in (spark.conf.get(_PROVIDER, "") or ""):
        spark.conf.set(_PROVIDER, _ROCKSDB)


def answers(lines: DataFrame) -> DataFrame:
    """Valid answers with their places, at most one per id and Arrow batch. A task reads its file pieces one after the
    other, so the running row number orders the lines of a piece."""
    placed = lines.select("raw", F.struct(F.col("_f").alias("file"), F.col("_s").alias("start")).alias("piece"))
    valid = (parse_responses(placed, order_col="piece").where(F.col("class").isNotNull() & F.col("custom_id").isNotNull())
             .select("custom_id", "line_no.file", "line_no.start", F.col("class").cast("int").alias("class")))

    def last_in_batch(batches):
        seen = 0
        for b in batches:
            b["seq"] = range(seen, seen + len(b))
            seen += len(b)
            yield b.sort_values(_PLACE).drop_duplicates("custom_id", keep="last")[["custom_id", *_PLACE, "class"]]

    return valid.mapInPandas(last_in_batch, _ANSWERS)


class LatestAnswer(StatefulProcessor):
    """One value per id: the place and class of its last valid answer so far."""

    def __init__(self, keep_for_ms: int | None = None) -> None:
        self.keep_for_ms = keep_for_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.latest = handle.getValueState(_STATE, _STATE_SCHEMA, self.keep_for_ms)

    def handleInputRows(self, key, rows, timerValues):
        before = tuple(self.latest.get()) if self.latest.exists() else None
        best = before
        for part in rows:
            for r in part.itertuples(index=False):
                answer = (r.file, int(r.start), int(r.seq), int(r[-1]))
                if best is None or answer[:3] > best[:3]:
                    best = answer
        if best != before:
            self.latest.update(best)
            yield pd.DataFrame({"custom_id": [key[0]], "class": [best[3]]})

    def close(self) -> None:
        pass


def latest_answers(lines: DataFrame, keep_for_ms: int | None = None) -> DataFrame:
    """Streamed response lines -> ``(custom_id, class)`` whenever the latest valid answer of an id changes."""
    return answers(lines).groupBy("custom_id").transformWithStateInPandas(
        LatestAnswer(keep_for_ms), "custom_id string, class int", "Update", "ProcessingTime" if keep_for_ms else "None")


def start_latest_stream(spark: SparkSession, src_path: str, checkpoint_location: str, keep_for_ms: int | None = None,
                        available_now: bool = False, max_files_per_trigger: int | None = None, changes=None):
    """Start the stream. ``changes(df, batch_id)`` gets each micro-batch's changed labels; without it only the state is kept."""
    use_keyed_state(spark)
    out = latest_answers(response_lines_stream(spark, src_path, max_files_per_trigger), keep_for_ms)
    w = out.writeStream.outputMode("update").option("checkpointLocation", checkpoint_location)
    w = w.foreachBatch(changes) if changes else w.format("noop")
    if not available_now:
        return w.start()
    # with expiry Spark would go on with empty micro-batches for ever; the query keeps the setting it is started with
    before = spark.conf.get(_IDLE_BATCHES)
    spark.conf.set(_IDLE_BATCHES, "false")
    try:
        return w.trigger(availableNow=True).start()
    finally:
        spark.conf.set(_IDLE_BATCHES, before)


def labels_in_state(spark: SparkSession, checkpoint_location: str) -> DataFrame:
    """``(custom_id, class)`` of every id in the state as of the last committed micro-batch."""
    use_keyed_state(spark)
    s = spark.read.format("statestore").option("stateVarName", _STATE).load(checkpoint_location)
    value = F.col("value.value") if "value" in s.schema["value"].dataType.fieldNames() else F.col("value")
    return s.select(F.col("key.custom_id").alias("custom_id"), value["class"].alias("class"))
