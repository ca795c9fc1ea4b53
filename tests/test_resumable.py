"""A scoring run that dies halfway and is taken up again."""

import os

import pytest
from pyspark.sql import functions as F

from tagwright import constants as K
from tagwright.operators import score as SC


def scorer(log, dies=None, fails=(), mended=None):
    def fn(texts):
        if dies in texts:
            os._exit(1)
        with open(os.path.join(log, "calls"), "a") as f:    # a small append is one write
            f.write(",".join(texts) + "\n")
        if set(texts) & set(fails) and not (mended and os.path.exists(mended)):
            raise RuntimeError("model failure")
        return [f"[{len(t)}]" for t in texts]
    return fn


def calls(log):
    with open(os.path.join(log, "calls")) as f:
        return [x.strip() for x in f]


def table(spark):
    return spark.range(0, 40, 1, 3).select(F.format_string("%02d", "id").alias("custom_id"), F.concat(F.lit("t"), F.lpad(F.col("id").cast("string"), 2, "0")).alias("prompt"))


def test_finished_batches_are_scored_once(spark, tmp_path):
    log, path = str(tmp_path), str(tmp_path / "run")
    kw = dict(order_cols=["prompt"], batch_size=4, wave_batches=2)
    with pytest.raises(Exception):  # noqa: B017  (the worker process is gone)
        SC.score_resumable(table(spark), scorer(log, dies="t17"), path, **kw)
    before = calls(log)
    got = {r["custom_id"]: r["model_output"] for r in SC.score_resumable(table(spark), scorer(log), path, **kw).collect()}
    assert got == {f"{i:02d}": "[3]" for i in range(40)}
    committed = [",".join(f"t{i:02d}" for i in range(b * 4, b * 4 + 4)) for b in range(4)]     # waves 0 and 1
    assert set(committed) <= set(before) and all(calls(log).count(c) == 1 for c in committed)
    n = len(calls(log))
    assert SC.score_resumable(table(spark), scorer(log), path, **kw).count() == 40 and len(calls(log)) == n   # nothing left to score


def test_failed_batches_are_retried_a_bounded_number_of_times(spark, tmp_path):
    log, path = str(tmp_path), str(tmp_path / "run")
    fn = scorer(log, fails=("t05", "t30"))
    d = SC.score_resumable(table(spark), fn, path, order_cols=["prompt"], batch_size=4, retries=2).cache()
    assert d.where(F.col("model_output") == K.ERROR_OUTPUT).count() == 8 and d.count() == 40
    assert [calls(log).count(c) for c in ("t04,t05,t06,t07", "t28,t29,t30,t31", "t00,t01,t02,t03")] == [3, 3, 1]
    ledger = {r["batch_id"]: (r["attempt"], r["rows"], r["failed"]) for r in SC.ledger(d).collect()}
    assert ledger[1] == (2, 4, 4) and ledger[0] == (0, 4, 0) and len(ledger) == 10


def test_empty_table(spark, tmp_path):
    assert SC.score_resumable(table(spark).limit(0), scorer(str(tmp_path)), str(tmp_path / "run"), order_cols=["prompt"]).count() == 0
