"""Weighted draws and the permutation without a sort, for any sizes and weights."""

import pytest
from pyspark.sql import functions as F

from tagwright.operators import balance as B, labels as L


def drawn(df, w, n, **kw):
    return {r["custom_id"]: r["draws"] for r in B.weighted_draws(df, w, n_draws=n, **kw).collect()}


def test_exactly_n_draws_in_proportion_on_any_partitions(spark):
    df = spark.range(500).select(F.col("id").cast("string").alias("custom_id"), (F.col("id") % 5).alias("w"))
    got = drawn(df.repartition(1), F.col("w"), 20_000)
    assert sum(got.values()) == 20_000 and got == drawn(df.repartition(11), F.col("w"), 20_000)
    per = [sum(n for k, n in got.items() if int(k) % 5 == w) / 20_000 for w in range(5)]
    assert per[0] == 0 and all(abs(per[w] - w / 10) < 0.02 for w in range(1, 5))


def test_a_row_of_a_third_of_the_weight_and_odd_weights(spark):
    rows = [("heavy", 50_000.0)] + [(f"r{i}", 1.0) for i in range(100_000)] + [("null", None), ("nan", float("nan")), ("minus", -4.0), ("tiny", 1e-9)]
    df = spark.createDataFrame(rows, "custom_id string, w double")
    got = drawn(df, F.col("w"), 3000)
    assert sum(got.values()) == 3000 and abs(got["heavy"] - 1000) < 120 and not set(got) & {"null", "nan", "minus", "tiny"}
    assert drawn(df.where("custom_id in ('null', 'minus')"), F.col("w"), 10) == {} and drawn(df.limit(0), F.col("w"), 10) == {}
    assert drawn(df.where("custom_id = 'r1'"), F.col("w"), 10) == {"r1": 10}


@pytest.mark.parametrize("n", [1, 2, 3, 5, 16, 17, 100, 5000])
def test_permutation(spark, n):
    d = spark.range(0, n, 1, 3).select("id", B.permuted("id", n, tag="a").alias("p"), B.permuted("id", n, tag="b").alias("q"))
    rows = d.collect()
    assert sorted(r["p"] for r in rows) == sorted(r["q"] for r in rows) == list(range(n))
    if n >= 100:
        assert sum(r["p"] == r["id"] for r in rows) < 10 and sum(r["p"] == r["q"] for r in rows) < 10
        assert sum(r["p"] < n / 2 for r in rows if r["id"] < n / 2) / n == pytest.approx(0.25, abs=0.1)


def test_permutation_moves_no_rows_and_keeps_nulls(spark):
    d = spark.range(10).select(F.when(F.col("id") != 3, F.col("id")).alias("i"))
    out = B.shuffle_permuted(d, "i", 10, epoch=2)
    assert "Exchange" not in out._jdf.queryExecution().executedPlan().toString()
    assert [r["position"] is None for r in out.collect() if r["i"] is None] == [True]


def test_counts_are_taken_by_the_write_itself(spark, tmp_path):
    d = spark.range(0, 1000, 1, 7).select(F.when(F.col("id") % 4 == 0, -1).when(F.col("id") % 10 == 1, None).otherwise(2).alias("class"))
    c = L.write_purged(d, str(tmp_path / "out"))
    assert (c.total, c.kept, c.removed) == (1000, spark.read.parquet(str(tmp_path / "out")).count(), 1000 - c.kept)
    assert L.write_purged(d.limit(0), str(tmp_path / "none")) == (0, 0)
