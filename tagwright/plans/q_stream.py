"""Registered queries: the streaming label table (changelog, keyed state), run to completion over the fixture's answer files."""

from __future__ import annotations

from pyspark.sql import functions as F

from tagwright.plans import fixtures as fx, oracle as O
from tagwright.plans.registry import register
from tagwright.session import scratch_path
from tagwright.streaming.latest import labels_in_state, start_latest_stream
from tagwright.streaming.responses import current_labels, start_label_stream


@register("stream_labels", O.LAST_VALID)
def q_stream_labels(spark, sf):
    src, table = scratch_path(spark, "stream-src"), scratch_path(spark, "stream-labels")
    fx.responses(spark, sf).orderBy("line_no").select(F.col("raw").alias("value")).write.text(src)
    q = start_label_stream(spark, src, table, checkpoint_location=scratch_path(spark, "stream-ckpt"), available_now=True)
    q.awaitTermination()
    return current_labels(spark, table)


@register("stream_keyed_state", O.LAST_VALID)
def q_stream_keyed_state(spark, sf):
    src, ckpt = scratch_path(spark, "keyed-src"), scratch_path(spark, "keyed-ckpt")
    fx.responses(spark, sf).orderBy("line_no").select(F.col("raw").alias("value")).write.text(src)
    start_latest_stream(spark, src, ckpt, available_now=True).awaitTermination()
    return labels_in_state(spark, ckpt)
