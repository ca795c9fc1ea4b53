"""Exact, repeatable stratified split (train / validation / test).

Sizes follow the usual two-step library split: test = ceil(0.2 N) taken
first, validation = ceil(0.125 M) of the remaining M. Inside a split step
the per-class quota is the largest-remainder allocation of the *kept* part
(ties: lowest class id), the held-out part of a class is what remains.
Which rows fall where is decided by ``md5(seed:key)``, not by ``rand()``,
so the result does not depend on partitioning or retries.

Scale: a row's rank inside its class is ``prefix(class, bucket) + rank
inside (class, bucket)``, where the bucket is the first hex digits of the
hash. The prefix table has at most K * 16**digits rows and is broadcast
only under that proven bound; no task ever holds a whole class.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from tagwright import constants as K
from tagwright.session import ensure_checkpoint_dir

BROADCAST_ROWS = 1_000_000


def key_hash(key: str, seed, tag: str = "") -> Column:
    prefix = f"{seed}:{tag + ':' if tag else ''}"
    return F.md5(F.concat(F.lit(prefix), F.col(key).cast("string")))


def approximate_mode(counts: DataFrame, n_col: str, draws_col: str, out: str, label: str = "class") -> DataFrame:
    """Largest-remainder allocation of ``draws`` over classes in proportion to ``n`` (K-row table)."""
    allw = Window.partitionBy()  # the table has one row per class
    cont = F.col(n_col).cast("double") / F.sum(n_col).over(allw).cast("double") * F.col(draws_col).cast("double")
    t = counts.withColumn("_cont", cont).withColumn("_floor", F.floor("_cont").cast("bigint"))
    t = t.withColumn("_rem", F.col("_cont") - F.col("_floor"))
    t = t.withColumn("_need", F.col(draws_col) - F.sum("_floor").over(allw))
    t = t.withColumn("_rk", F.row_number().over(Window.orderBy(F.desc("_rem"), F.col(label))))
    t = t.withColumn(out, (F.col("_floor") + F.when(F.col("_rk") <= F.col("_need"), 1).otherwise(0)).cast("bigint"))
    return t.drop("_cont", "_floor", "_rem", "_need", "_rk")


def quotas_from_counts(counts: DataFrame, label: str = "class") -> DataFrame:
    """Per class ``(n)`` -> n, n_test, n_validation, n_train (a K-row table)."""
    allw = Window.partitionBy()
    tot = F.sum("n").over(allw)
    q = counts.withColumn("_n_test_total", F.ceil(F.lit(0.2) * tot).cast("bigint"))
    q = q.withColumn("_keep1", (tot - F.col("_n_test_total")).cast("bigint"))
    q = approximate_mode(q, "n", "_keep1", "_train1", label)
    q = q.withColumn("n_test", F.col("n") - F.col("_train1")).withColumn("m", F.col("_train1"))
    mt = F.sum("m").over(allw)
    q = q.withColumn("_keep2", (mt - F.ceil(F.lit(0.125) * mt)).cast("bigint"))
    q = approximate_mode(q, "m", "_keep2", "n_train", label)
    q = q.withColumn("n_validation", F.col("m") - F.col("n_train"))
    return q.select(label, "n", "n_test", "n_validation", "n_train")


def split_quotas(df: DataFrame, label: str = "class") -> DataFrame:
    """Per class: n, n_test, n_validation, n_train."""
    return quotas_from_counts(df.groupBy(F.col(label)).agg(F.count(F.lit(1)).alias("n")), label)


class HashRanks:
    """Rows with their md5 hash and bucket, plus the materialized (class, bucket) size table.

    A class of n rows has about sqrt(n) buckets per digit step (16**digits, digits from the row count), so neither the
    size table nor a bucket grows with the data alone. The size table is computed once,
    written to the shared checkpoint folder (cutting lineage, so the input is
    not re-scanned for it) and its row count is the proven bound under which
    it is broadcast. Class counts and quotas derive from it. Rows without a class are not counted.
    """

    def __init__(self, df: DataFrame, h: Column, label: str = "class", digits: int | None = None):
        self.label = label
        if digits is None:
            n = df.where(F.col(label).isNotNull()).count()
            digits = next(d for d in range(2, 9) if 16 ** d >= n ** 0.5 or d == 8)
        self.rows = df.withColumn("_h", h).withColumn("_b", F.substring("_h", 1, digits))
        sizes = (self.rows.where(F.col(label).isNotNull()).groupBy(label, "_b")
                 .agg(F.count(F.lit(1)).alias("_bn")))
        ensure_checkpoint_dir(df.sparkSession)
        self.sizes = sizes.checkpoint(eager=True)
        self.n_sizes = self.sizes.count()

    def small(self, d: DataFrame) -> DataFrame:
        return F.broadcast(d) if self.n_sizes <= BROADCAST_ROWS else d

    def class_counts(self) -> DataFrame:
        return self.sizes.groupBy(self.label).agg(F.sum("_bn").alias("n"))

    def prefixes(self) -> DataFrame:
        """(class, _b, _bn, _off): rows of the class in earlier buckets."""
        w = Window.partitionBy(self.label).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
        return self.sizes.withColumn("_off", F.coalesce(F.sum("_bn").over(w), F.lit(0)))

    def ranked(self, key: str, name: str = "rank") -> DataFrame:
        """0-based rank of each row inside its class by ``(h, key)``."""
        label = self.label
        inner = F.row_number().over(Window.partitionBy(label, "_b").orderBy("_h", key)) - 1
        return (self.rows.withColumn("_r", inner).join(self.small(self.prefixes().drop("_bn")), [label, "_b"])
                .withColumn(name, (F.col("_off") + F.col("_r")).cast("bigint"))
                .drop("_h", "_b", "_r", "_off"))

    def cuts(self, positions: DataFrame, key: str) -> DataFrame:
        """For each (class, cut, pos): ``_from``, the (hash, key) of the row at that 0-based rank; null: past the last row.

        Only the one bucket that holds a cut is ranked.
        """
        label = self.label
        at = positions.join(self.prefixes(), label).where(
            (F.col("_off") <= F.col("pos")) & (F.col("pos") < F.col("_off") + F.col("_bn")))
        near = self.rows.select(label, "_h", "_b", F.col(key).alias("_k")).join(self.small(at), [label, "_b"])
        inner = F.row_number().over(Window.partitionBy(label, "cut").orderBy("_h", "_k")) - 1
        return (near.withColumn("_r", inner).where(F.col("_off") + F.col("_r") == F.col("pos"))
                .select(label, "cut", F.struct("_h", "_k").alias("_from")))


def stratified_split(df: DataFrame, key: str = "custom_id", label: str = "class", seed=K.SPLIT_SEED,
                     digits: int | None = None) -> DataFrame:
    """Adds ``split`` in {'train', 'validation', 'test', 'quarantine'} (W1); rows without a class go to quarantine.

    The two cuts of a class are found as (hash, key) values, then every row is placed by comparing with them: whole
    rows are not shuffled. Keys should be unique; rows that share a key and class stay together.
    """
    hr = HashRanks(df, key_hash(key, seed), label, digits)
    quotas = hr.small(quotas_from_counts(hr.class_counts(), label))
    cut = lambda name, pos: F.struct(F.lit(name).alias("cut"), pos.cast("bigint").alias("pos"))
    positions = quotas.select(label, F.explode(F.array(
        cut("test", F.col("n_test")), cut("validation", F.col("n_test") + F.col("n_validation")))).alias("_c")).select(label, "_c.*")
    found = hr.cuts(positions, key).groupBy(label).agg(
        F.max(F.when(F.col("cut") == "test", F.col("_from"))).alias("_test_end"),
        F.max(F.when(F.col("cut") == "validation", F.col("_from"))).alias("_validation_end"))
    # one row per class, checkpointed: found once, however often the split is used
    ends = hr.class_counts().select(label).join(found, label, "left").checkpoint(eager=True)
    me = F.struct(F.col("_h"), F.col(key).alias("_k"))
    before = lambda end: F.col(end).isNull() | (me < F.col(end))  # noqa: E731  (no such row: everything is before it)
    split = (F.when(F.col(label).isNull(), F.lit("quarantine")).when(before("_test_end"), F.lit("test"))
             .when(before("_validation_end"), F.lit("validation")).otherwise(F.lit("train")))
    return hr.rows.join(hr.small(ends), label, "left").withColumn("split", split).drop("_h", "_b", "_test_end", "_validation_end")


def split_distribution(split_df: DataFrame, label: str = "class") -> DataFrame:
    """Count and percent per class inside each split and in the original (A3)."""
    by = split_df.groupBy("split", label).agg(F.count(F.lit(1)).alias("n"))
    orig = by.groupBy(label).agg(F.sum("n").alias("n")).select(F.lit("original").alias("split"), label, "n")
    allc = by.unionByName(orig)
    tot = F.sum("n").over(Window.partitionBy("split"))
    return allc.select("split", label, F.col("n").cast("bigint").alias("n"),
                       (F.col("n").cast("double") * 100 / tot.cast("double")).alias("pct"))


def split_integrity(original: DataFrame, split_df: DataFrame, key: str = "custom_id") -> DataFrame:
    """One row: input rows, rows per split, rows missing from every split, keys in more than one.

    Both key lists are tagged and go through one aggregate per key and one over all.
    """
    mark = lambda d, split: d.select(F.col(key).alias("_k"), split.alias("_s"))
    both = mark(original, F.lit(None).cast("string")).unionByName(mark(split_df, F.col("split")))
    in_split = lambda name: F.count_if(F.col("_s") == name)
    names = ("train", "validation", "test", "quarantine")
    per_key = both.groupBy("_k").agg(F.count_if(F.col("_s").isNull()).alias("_in"), F.count("_s").alias("_out"),
                                     *[in_split(n).alias(n) for n in names])
    total = lambda c: F.coalesce(F.sum(c), F.lit(0)).cast("bigint")
    return per_key.agg(
        total("_in").alias("n_input"), total("_out").alias("n_split_rows"), *[total(n).alias(f"n_{n}") for n in names],
        total(F.when(F.col("_out") == 0, F.col("_in")).otherwise(0)).alias("missing"),
        F.count_if(F.col("_out") > 1).alias("duplicated"))
