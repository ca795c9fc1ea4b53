"""Epoch training: against plain numpy, on any number of partitions, resumed after a lost driver, stopped by its history."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tagwright.operators import epochs as EP, history as H
from tagwright.operators.bayes import token_counts

S = EP.Settings(features=64, batch=20, epochs=4, learning_rate=0.1)
SCHEMA = "custom_id string, message string, class int"


def rows(seed, n):
    rng = random.Random(seed)
    letters = {0: "abcd", 1: "cdef", 3: "egxyz"}
    out = []
    for i in range(n):
        y = rng.choice([0, 0, 1, 3])
        out.append((f"{seed}-{i}", "".join(rng.choice(letters[y] + " hi") for _ in range(rng.randrange(30))), y))
    return out


@pytest.fixture(scope="module")
def data(spark):
    return spark.createDataFrame(rows(1, 150) + [("no class", "abc", None)], SCHEMA), spark.createDataFrame(rows(2, 60), SCHEMA)


@pytest.fixture(scope="module")
def run(data):
    return EP.train_epochs(*data, S)


def plain(spark, data, s):
    """The same training in plain floats, without Spark's sums: one weight matrix and one loss per epoch."""
    vectors = EP.features(data[0].where("class is not null"), s.features, "custom_id", "message", "class")
    steps = -(-vectors.count() // s.batch)
    slots = steps * s.slots_per_step
    got = vectors.withColumn("slot", F.pmod(F.xxhash64(F.lit(s.seed), "key"), F.lit(slots))).collect()
    labels = sorted({r["label"] for r in got})
    n = {y: sum(r["label"] == y for r in got) for y in labels}
    x, y = np.zeros((len(got), s.features + 1)), np.zeros((len(got), len(labels)))
    for i, r in enumerate(got):
        x[i, r["at"]] = r["n"]
        x[i] /= max(np.linalg.norm(x[i]), 1e-300)
        x[i, -1], y[i, labels.index(r["label"])] = 1, 1
    weight = np.array([len(got) / (n[r["label"]] * len(labels)) for r in got])
    w, m, v = (np.zeros((s.features + 1, len(labels))) for _ in range(3))
    out = []
    for epoch in range(1, s.epochs + 1):
        order, losses = EP.slot_order(s, epoch, slots), 0.0
        for i in range(steps):
            at = [k for k, r in enumerate(got) if r["slot"] in order[i * s.slots_per_step:(i + 1) * s.slots_per_step]]
            z = np.exp(x[at] @ w)
            p = z / z.sum(axis=1, keepdims=True)
            losses -= (weight[at] * np.log((p * y[at]).sum(axis=1))).sum()
            g = x[at].T @ ((p - y[at]) * weight[at][:, None]) / weight[at].sum()
            g *= min(1, s.clip / np.linalg.norm(g))
            t, total = (epoch - 1) * steps + i + 1, steps * s.epochs
            m, v = s.beta1 * m + (1 - s.beta1) * g, s.beta2 * v + (1 - s.beta2) * g * g
            up = max(1, round(s.warmup * total))
            rate = s.learning_rate * (t / up if t <= up else (total - t + 1) / (total - up + 1))
            w = w - rate * (m / (1 - s.beta1 ** t)) / (np.sqrt(v / (1 - s.beta2 ** t)) + 1e-8)
        out.append((w, losses / weight.sum()))
    return out


def test_matches_plain_numpy(spark, data, run):
    want = plain(spark, data, S)
    assert np.abs(want[run.best_epoch - 1][0] - run.weights).max() < 1e-5
    got = [r["train_loss"] for r in run.history.orderBy("epoch").collect()]
    assert np.allclose(got, [loss for _, loss in want[:len(got)]], atol=1e-6) and got[-1] < got[0]
    assert max(r["val_accuracy"] for r in run.history.collect()) > 0.8


def test_same_on_1_and_13_partitions(data, run):
    for parts in (1, 13):
        other = EP.train_epochs(data[0].repartition(parts), data[1].repartition(parts), S)
        assert other.history.collect() == run.history.collect() and (other.weights == run.weights).all()


def test_resumes_after_a_lost_driver(data, run, tmp_path):
    def lost(epoch):
        if epoch == 2:
            raise KeyboardInterrupt

    done = []
    with pytest.raises(KeyboardInterrupt):
        EP.train_epochs(*data, S, str(tmp_path / "run"), after_epoch=lost)
    again = EP.train_epochs(*data, S, str(tmp_path / "run"), after_epoch=done.append)
    assert done == [3, 4]                                     # the first two are not trained again
    assert again.history.collect() == run.history.collect() and (again.weights == run.weights).all() and again.best_epoch == run.best_epoch


def test_stops_by_its_own_history(data):
    s = S._replace(epochs=6, patience=1, learning_rate=0.0)   # nothing improves after the first epoch
    stopped = EP.train_epochs(*data, s)
    d = stopped.history.withColumn("run_id", F.lit("r"))
    r = H.early_stopping(d, 1).first()
    assert (r["stop_epoch"], r["stopped"], r["best_epoch"]) == (2, 1, 1) and stopped.best_epoch == 1 and d.count() == 2


def test_a_slot_is_one_file(data, tmp_path):
    """Files follow the slots, not the slots times the tasks that cut the texts."""
    EP.train_epochs(data[0].repartition(13), data[1], S._replace(epochs=1), str(tmp_path / "run"))
    slots = list((tmp_path / "run" / "train").glob("slot=*"))
    assert len(slots) > 20 and all(len(list(x.glob("*.parquet"))) == 1 for x in slots)


def test_jobs_follow_the_epochs_and_not_the_steps(spark, data):
    """An epoch of 38 steps takes as many Spark jobs as one of 3 steps."""
    sc, jobs = spark.sparkContext, []
    for batch in (50, 4):
        sc.setJobGroup(f"steps of {batch}", "")
        try:
            steps = EP.train_epochs(*data, S._replace(epochs=1, batch=batch)).history.first()["steps"]
            jobs.append(len(sc.statusTracker().getJobIdsForGroup(f"steps of {batch}")))
        finally:
            sc.setLocalProperty("spark.jobGroup.id", None)
    assert steps == 38 and jobs[0] > 0 and jobs[1] < jobs[0] + 10


def test_many_small_slices_are_one_step(data, run, monkeypatch):
    monkeypatch.setattr(EP, "_runs", lambda b, classes: ((int(b.column("step")[i].as_py()), b.slice(i, 1)) for i in range(b.num_rows)))
    other = EP.train_epochs(*data, S)
    assert other.history.collect() == run.history.collect() and (other.weights == run.weights).all()


def test_steps_cut_by_what_a_task_may_hold(monkeypatch):
    assert [(s, r.num_rows) for s, r in EP._runs(slices(), 2)] == [(0, 2), (1, 3)]
    monkeypatch.setattr(EP, "CELLS", 4)
    assert [(s, r.num_rows) for s, r in EP._runs(slices(), 2)] == [(0, 1), (0, 1), (1, 3)]


def slices():
    import pyarrow as pa
    at = pa.array([[9], [1, 2], [3, 4], [5], [], [6, 7]], pa.list_(pa.int32()))
    return pa.RecordBatch.from_arrays([pa.array([0, 0, 0, 1, 1, 1], pa.int32()), at], names=["step", "at"]).slice(1)


ODD = [("a", "Straße ÄÖ İstanbul \ufb03 \U0001d49c\U0001d4b7 漢字かな e\u0301 ١٢", 0), ("b", "", 1), ("c", None, 0), ("d", "!!", 1), ("a", "mehr 漢字漢", 1),
       (None, "a text without a key", 0), ("e", "z", 1), ("e", "z", 1), ("f", "x\x00y\U00010400\U00010401", None), ("g", "aé漢\U0001d49cé漢" * 40, 0), ("h", "one, 2", 3)]


@pytest.mark.parametrize("size", [64, 1 << 20])
@pytest.mark.parametrize("rows", [ODD, [x for x in ODD if x[0] in ("f", "g", "h", None)]], ids=["shared keys", "own keys"])
def test_features_are_the_hashed_token_counts(spark, size, rows):
    """Against Spark's own hash of the tokens that ``bayes`` counts; rows that share a key share their counts."""
    d = spark.createDataFrame(rows, SCHEMA)
    want = {}
    for r in token_counts(d, "message", "custom_id").select("custom_id", F.pmod(F.xxhash64("token"), F.lit(size)).alias("at"), "n").collect():
        n = want.setdefault(r["custom_id"], {})
        n[r["at"]] = n.get(r["at"], 0) + r["n"]
    want[None] = {}
    got = EP.features(d, size, "custom_id", "message", "class")
    assert got.dtypes == [("key", "string"), ("label", "int"), ("at", "array<int>"), ("n", "array<bigint>")]
    expected = [(k, y, *map(list, zip(*sorted(want.get(k, {}).items())))) if want.get(k) else (k, y, [], []) for k, _, y in rows]
    assert sorted(map(repr, (tuple(r) for r in got.collect()))) == sorted(map(repr, expected))
