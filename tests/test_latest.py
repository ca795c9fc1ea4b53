"""Keyed state of the label stream: equal to the batch read after any order of files, over restarts, with expiry."""

import itertools
import os
import time

import pytest

from tagwright.operators.labels import last_valid_per_key, parse_responses
from tagwright.session import scratch_path
from tagwright.sources.jsonl import read_response_lines
from tagwright.streaming.latest import labels_in_state, start_latest_stream

FILES = {
    "a.jsonl": [("a", "[1]"), ("b", "(2)"), (None, None), ("a", "[0]"), ("hot", "[1]")],
    "b.jsonl": [("a", "sorry"), ("b", "[3]"), ("c", "2"), *[("hot", f"[{i % 4}]") for i in range(300)]],
    "c.jsonl": [("b", "[1]"), ("d", "[9]"), ("hot", "no answer")],
}


def _line(cid, content):
    if cid is None:
        return "{bad"
    return '{"custom_id": "%s", "response": {"body": {"choices": [{"message": {"content": "%s"}}]}}}' % (cid, content)


def _labels(df):
    rows = [(r["custom_id"], r["class"]) for r in df.collect()]
    assert len(rows) == len(dict(rows))
    return dict(rows)


def _put(folder, name):
    (folder / name).write_text("\n".join(_line(*x) for x in FILES[name]) + "\n")
    os.utime(folder / name, None)


@pytest.mark.parametrize("order", [o for i, o in enumerate(itertools.permutations(FILES)) if i in (0, 3, 5)])
def test_any_order_of_files_with_a_restart_after_each(spark, tmp_path, order):
    ckpt = scratch_path(spark, "t-keyed")
    for name in order:
        _put(tmp_path, name)
        start_latest_stream(spark, str(tmp_path), ckpt, available_now=True).awaitTermination(120)
    batch = last_valid_per_key(parse_responses(read_response_lines(spark, str(tmp_path)), order_col="line_key"))
    got = _labels(labels_in_state(spark, ckpt))
    assert got == _labels(batch) and got["hot"] == 3 and got["a"] == 0 and got["b"] == 1


def test_changes_are_given_and_old_answers_expire(spark, tmp_path):
    ckpt, changed = scratch_path(spark, "t-keyed"), []

    def changes(df, batch_id):
        changed.append(_labels(df))

    def run(name, keep):
        _put(tmp_path, name)
        start_latest_stream(spark, str(tmp_path), ckpt, keep, available_now=True, changes=changes).awaitTermination(120)

    run("b.jsonl", 1)
    time.sleep(1)
    run("a.jsonl", 1)   # an earlier file: b's answers there count, as the later ones have expired
    seen = [c for c in changed if c]
    assert seen[0] == {"b": 3, "c": 2, "hot": 3} and seen[1] == {"a": 0, "b": 2, "hot": 1}
