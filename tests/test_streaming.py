"""Answers arriving in two rounds of files: the later valid answer wins, a later invalid one does not erase."""

import os

from tagwright.session import scratch_path
from tagwright.streaming.responses import compact_labels, current_labels, start_label_stream


def _line(cid, content):
    return '{"custom_id": "%s", "response": {"body": {"choices": [{"message": {"content": "%s"}}]}}}' % (cid, content)


def test_label_stream_two_rounds(spark, tmp_path):
    src = tmp_path / "in"
    src.mkdir()
    table, errors = scratch_path(spark, "t-stream-labels"), scratch_path(spark, "t-stream-errors")
    ckpt = scratch_path(spark, "t-stream-ckpt")
    (src / "a.jsonl").write_text("\n".join([_line("a", "[1]"), _line("b", "(2)"), "{bad", _line("a", "[0]")]) + "\n")
    q = start_label_stream(spark, str(src), table, errors, ckpt, available_now=True)
    q.awaitTermination(120)
    assert {r.custom_id: r["class"] for r in current_labels(spark, table).collect()} == {"a": 0, "b": 2}
    (src / "b.jsonl").write_text("\n".join([_line("a", "sorry"), _line("b", "[3]"), _line("c", "2")]) + "\n")
    os.utime(src / "b.jsonl", None)
    q = start_label_stream(spark, str(src), table, errors, ckpt, available_now=True)
    q.awaitTermination(120)
    assert {r.custom_id: r["class"] for r in current_labels(spark, table).collect()} == {"a": 0, "b": 3, "c": 2}
    reasons = sorted(r.reason for r in spark.read.parquet(errors).collect())
    assert reasons == ["bad_format", "bad_json"]
    assert compact_labels(spark, table) == 2 and compact_labels(spark, table) == 0
    assert {r.custom_id: r["class"] for r in current_labels(spark, table).collect()} == {"a": 0, "b": 3, "c": 2}
    (src / "c.jsonl").write_text(_line("a", "[2]") + "\n")
    start_label_stream(spark, str(src), table, errors, ckpt, available_now=True).awaitTermination(120)
    assert compact_labels(spark, table) == 2
    assert {r.custom_id: r["class"] for r in current_labels(spark, table).collect()} == {"a": 2, "b": 3, "c": 2}
