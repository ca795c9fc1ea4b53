import pytest
from pyspark.sql import functions as F

from tagwright.llm import mixing


def brute_targets(sizes, cap=3.0):
    """Share by weight, stop at the cap, reshare the excess until none is above."""
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: i % 3 + 1 for i, s in enumerate(order)}
    target, free, left = {}, set(order), float(sum(sizes.values()))
    while free:
        total = sum(weight[s] for s in free)
        over = {s for s in free if left * weight[s] / total > cap * sizes[s]}
        if not over:
            target |= {s: left * weight[s] / total for s in free}
            break
        for s in over:
            target[s] = cap * sizes[s]
        left -= sum(target[s] for s in over)
        free -= over
    return target


@pytest.mark.parametrize("sizes", [{"a": 10, "b": 10, "c": 10}, {"a": 1, "b": 2, "c": 900, "d": 40, None: 7, "é": 300},
                                   {"a": 0, "b": 5}, {"a": 0}, {"z": 1, "y": 1, "x": 1000}])
def test_targets(spark, sizes):
    src = spark.createDataFrame([(s, 1, n) for s, n in sizes.items()], "source string, docs long, source_size long")
    got = {r["source"]: r["target"] for r in mixing.targets(src).collect()}
    assert got == pytest.approx(brute_targets(sizes))


def test_targets_of_many_sources_take_several_rounds(spark):
    sizes = {f"host{i:04d}": 3 ** (i % 12) for i in range(600)}
    src = spark.createDataFrame([(s, 1, n) for s, n in sizes.items()], "source string, docs long, source_size long").repartition(13)
    got = {r["source"]: r["target"] for r in mixing.targets(src).collect()}
    assert got == pytest.approx(brute_targets(sizes)) and sum(got.values()) == pytest.approx(sum(sizes.values()))
    assert mixing.targets(src.limit(0)).collect() == []


def test_budgets_are_met_by_whole_documents(spark, docs_of):
    rows = [(i, " ".join(["w"] * (1 + i * 7 % 30)), "abc"[i % 7 % 3] if i % 11 else None) for i in range(900)]
    mix = mixing.mix(docs_of(rows)).cache()
    for r in mix.groupBy("source").agg(F.sum("taken").alias("t"), F.first("target").alias("x"), F.max(F.col("taken") / F.col("size")).alias("m"),
                                       F.min("copies").alias("lo"), F.max("copies").alias("hi")).collect():
        assert abs(r["t"] - r["x"]) <= 15 and r["m"] <= 3 and r["hi"] - r["lo"] <= 1
    again = mixing.mix(docs_of(rows, 8))
    assert mix.exceptAll(again).count() == 0 and again.exceptAll(mix).count() == 0
    repeated = mixing.mixed_rows(docs_of(rows)).groupBy("doc_id").count()
    assert {r["doc_id"]: r["count"] for r in repeated.collect()} == {r["doc_id"]: r["copies"] for r in mix.where("copies > 0").collect()}


def test_sampling_follows_the_weights(spark, docs_of):
    """In the fractional part, documents of five times the weight are taken far more often."""
    rows = [(i, "w " * 10, "ab"[i // 1000]) for i in range(2000)]   # b gets 4/3 of its size: one document in three twice
    weight = F.when(F.col("doc_id") % 2 == 0, 1.0).otherwise(0.2)
    twice = mixing.mix(docs_of(rows), weight).where("source = 'b' and copies = 2")
    counts = {r["odd"]: r["count"] for r in twice.groupBy((F.col("doc_id") % 2).alias("odd")).count().collect()}
    assert 320 < sum(counts.values()) < 346 and counts[0] > 3 * counts[1]


@pytest.mark.parametrize("weight", [0.05, 0.2, 1.0])
def test_no_bucket_is_hot_at_any_weight(spark, weight):
    """The one bucket that is sorted holds a small multiple of the even share, whatever the weight of the source."""
    n, buckets = 100_000, 317
    keys = spark.range(n).select(mixing.exponential_key(F.col("id"), F.lit("t"), F.lit(weight), "mix").alias("_key"),
                                 F.lit(buckets).alias("_buckets"))
    largest = keys.groupBy(mixing._bucket().alias("b")).count().agg(F.max("count")).first()[0]
    assert largest < 14 * n / buckets


def test_a_source_of_letterless_texts_meets_its_target(spark, docs_of):
    rows = [(i, "1 2 3 4 5 6 7 8", "a") for i in range(2000)] + [(5000 + i, "w " * 8, "b") for i in range(2000)]
    mix = mixing.mix(docs_of(rows))
    for r in mix.groupBy("source").agg(F.sum("taken").alias("t"), F.first("target").alias("x")).collect():
        assert abs(r["t"] - r["x"]) <= 4


def test_hostile_rows(spark, hostile):
    got = mixing.mix(hostile).collect()
    assert len(got) == 12 and sum(r["taken"] for r in got if r["size"] == 0) == 0
    assert mixing.mixed_rows(hostile).columns == hostile.columns
    assert mixing.mix(hostile.limit(0)).count() == 0 and mixing.mixed_rows(hostile.limit(0)).count() == 0


def test_capped_sources_repeat_empty_documents_like_the_others(spark, docs_of):
    """Sizes 100 to 1: the small source of the largest weight is held at three whole epochs, for empty documents too."""
    rows = [(i, "w " * 100, "a") for i in range(100)] + [(100 + i, "" if i % 2 else "w", "c") for i in range(200)] + [(300, "w", "b")]
    got = {r["copies"] for r in mixing.mix(docs_of(rows)).where("source = 'c'").select("copies").distinct().collect()}
    assert got == {3}
