"""Class imbalance: inverse-frequency weights, balanced resampling, repeatable shuffle."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window, functions as F

from tagwright import constants as K
from tagwright.operators.prepare import assign_row_id
from tagwright.operators.split import BROADCAST_ROWS, HashRanks, key_hash
from tagwright.session import ensure_checkpoint_dir

ROUNDS = 6   # of the Feistel network


def hash_unit(h: Column) -> Column:
    """Uniform [0, 1) from the first 52 bits of an md5 hex string."""
    return hash_bits(h) / F.lit(float(1 << 52))


def hash_bits(h: Column) -> Column:
    """The first 52 bits of an md5 hex string as a long."""
    return F.conv(F.substring(h, 1, 13), 16, 10).cast("bigint")


def class_weights(df: DataFrame, label: str = "class") -> DataFrame:
    """``N / (n_c * K)`` per observed class (A12); K = number of observed classes."""
    return weights_from_counts(df.groupBy(label).agg(F.count(F.lit(1)).alias("n")), label)


def weights_from_counts(counts: DataFrame, label: str = "class") -> DataFrame:
    """Class weights from a table ``(class, n)``; classes without rows have none."""
    counts = counts.where(F.col("n") > 0)
    allw = Window.partitionBy()  # one row per class
    w = F.sum("n").over(allw).cast("double") / (F.col("n").cast("double") * F.count(F.lit(1)).over(allw))
    return counts.select(label, "n", w.alias("weight"))


def attach_class_weight(df: DataFrame, weights: DataFrame, label: str = "class") -> DataFrame:
    """Per-row weight by class lookup (J4); Spark broadcasts the weight table where its size allows it."""
    return df.join(weights.select(label, "weight"), label, "left")


def balanced_resample(df: DataFrame, key: str = "custom_id", label: str = "class", seed=K.SPLIT_SEED,
                      n_draws: int | None = None) -> DataFrame:
    """Draws with replacement, class uniform then row uniform inside the class (U4).

    Exactly ``n_draws`` (default: the row count) draws. Draw i picks class
    ``observed[floor(u1(i) K)]`` and in-class rank ``floor(u2(i) n_c)``;
    draws are counted per (class, rank) before the join, so a tiny class
    drawn many times is one joined row with a multiplicity, never a hot key.
    Returns ``(key, label, draws)``; ``explode_draws`` gives one row per draw.
    """
    spark = df.sparkSession
    hr = HashRanks(df.select(key, label), key_hash(key, seed, "resample"), label)
    counts = hr.class_counts().withColumnRenamed("n", "n_c")
    classes = counts.select(label, "n_c", (F.row_number().over(Window.orderBy(label)) - 1).alias("_ci"))
    totals = counts.agg(F.count(F.lit(1)).alias("k"), F.sum("n_c").alias("n")).first()  # two scalars
    k = int(totals.k)
    n = n_draws if n_draws is not None else int(totals.n or 0)
    draws = spark.range(n).select(
        F.floor(hash_unit(key_hash("id", seed, "r1")) * F.lit(k)).cast("int").alias("_ci"),
        hash_unit(key_hash("id", seed, "r2")).alias("_u2"))
    picked = draws.join(hr.small(classes), "_ci")  # equi-join on the class index; one row per class
    per_cell = picked.groupBy(label, F.floor(F.col("_u2") * F.col("n_c")).cast("bigint").alias("_rank")) \
        .agg(F.count(F.lit(1)).alias("draws"))
    ranked = hr.ranked(key, "_rank")
    return ranked.join(per_cell, [label, "_rank"]).select(key, label, "draws")


def explode_draws(resampled: DataFrame, chunk: int = 10_000) -> DataFrame:
    """One row per draw. A row drawn often is first cut into chunks that are dealt out, then the draws of a chunk are
    expanded: no array is longer than ``chunk`` or than the number of chunks, and no task expands a whole row."""
    last = F.floor((F.col("draws") - 1) / chunk).cast("bigint")
    chunks = (resampled.where(F.col("draws") > 0).withColumn("_c", F.explode(F.sequence(F.lit(0).cast("bigint"), last)))
              .withColumn("_m", F.least(F.lit(chunk).cast("bigint"), F.col("draws") - F.col("_c") * chunk)))
    spread = chunks.repartition(F.xxhash64(*[c for c in resampled.columns if c != "draws"], "_c"))
    return spread.withColumn("_d", F.explode(F.sequence(F.lit(1).cast("bigint"), F.col("_m")))).drop("_d", "_m", "_c", "draws")


def weighted_draws(df: DataFrame, weight: Column, key: str = "custom_id", n_draws: int | None = None, seed=K.SPLIT_SEED,
                   scale: int = 1_000_000) -> DataFrame:
    """Draws with replacement, each row by its own weight: ``(key, draws)`` of the rows drawn at least once.

    Exactly ``n_draws`` draws (default: as many as rows of positive weight). Weights are taken in units of 1/``scale``, null,
    NaN and negative ones as 0, so every row owns a whole interval of ``[0, total)`` and a draw is a whole number in it (52 random
    bits). Intervals follow hash buckets of about sqrt(rows) rows: bucket sums give each bucket's start, and only rows of
    one bucket are added up in a task. The search for the interval that holds a draw is an equi-join on a grid of as
    many cells as rows: a row is listed under the cells that it touches, at most rows + cells entries in all, and a heavy row lies
    under many cells, so no key is hot.
    """
    spark = df.sparkSession
    ensure_checkpoint_dir(spark)
    units = F.round(F.coalesce(F.nanvl(weight.cast("double"), F.lit(0.0)), F.lit(0.0)) * scale).cast("bigint")
    d = df.select(key, units.alias("_u")).where("_u > 0").withColumn("_h", key_hash(key, seed, "weighted"))
    n = d.count()
    digits = 1
    while 16 ** (2 * digits) < n:
        digits += 1
    d = d.withColumn("_b", F.substring("_h", 1, digits))
    before = Window.orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)     # 16^digits rows, about sqrt(n)
    starts = (d.groupBy("_b").agg(F.sum("_u").alias("_sum"))
              .select("_b", "_sum", F.coalesce(F.sum("_sum").over(before), F.lit(0)).alias("_start")).checkpoint())
    total = starts.agg(F.sum("_sum")).first()[0] or 0
    if not total:
        return df.select(key, F.lit(0).cast("bigint").alias("draws")).limit(0)
    small = F.broadcast(starts) if 16 ** digits <= BROADCAST_ROWS else starts
    cell = -(-total // n)
    upto = Window.partitionBy("_b").orderBy("_h", key).rowsBetween(Window.unboundedPreceding, 0)
    rows = d.join(small, "_b").withColumn("_hi", F.col("_start") + F.sum("_u").over(upto)).withColumn("_lo", F.col("_hi") - F.col("_u"))
    first, last = F.expr(f"_lo div {cell}"), F.expr(f"(_hi - 1) div {cell}")
    chunk = 10_000   # cells of a heavy row that are listed at a time
    rows = rows.select(key, "_lo", "_hi", first.alias("_first"), last.alias("_last"))
    rows = rows.withColumn("_k", F.explode(F.sequence(F.expr(f"_first div {chunk}"), F.expr(f"_last div {chunk}"))))
    rows = rows.select(key, "_lo", "_hi", F.explode(F.sequence(F.greatest("_first", F.col("_k") * chunk), F.least("_last", F.col("_k") * chunk + chunk - 1))).alias("_cell"))
    at = hash_bits(key_hash("id", seed, "weighted-draw")).cast("decimal(16,0)") * F.lit(total).cast("decimal(19,0)")
    draws = spark.range(n if n_draws is None else n_draws).select(at.alias("_x")).select(F.expr(f"_x div {1 << 52}").alias("_t"))
    draws = draws.withColumn("_cell", F.expr(f"_t div {cell}"))
    return (draws.join(rows, "_cell").where("_lo <= _t AND _t < _hi").groupBy(key).agg(F.count(F.lit(1)).alias("draws")))


def permuted(index: Column | str, n: int, seed=K.SPLIT_SEED, tag: str = "permute") -> Column:
    """The place of dense index 0..n-1 under a keyed bijection of 0..n-1: a shuffle without sorting or moving a row.

    An alternating Feistel network on ``rows x columns`` cells, at least n: in turn the row is shifted by a hash of the
    column and the column by a hash of the row, which can be undone, so places are distinct. A place of n or more is
    put through again until it is below n; there are fewer than 2 sqrt(n) + 1 such cells, so small tables need no more steps
    than that and for large ones a second step is rare already. A null index stays null.
    """
    columns = math.isqrt(max(0, n - 1)) + 1
    rows = max(1, -(-n // columns))
    spare = rows * columns - n

    def shift(r: Column, v: Column) -> Column:
        return hash_bits(F.md5(F.concat_ws(":", F.lit(f"{seed}:{tag}"), r.cast("string"), v.cast("string"))))

    def once(x: Column) -> Column:
        begin = F.struct(F.floor(x / columns).cast("bigint").alias("row"), (x % columns).cast("bigint").alias("column"))
        end = F.aggregate(F.array(*[F.lit(i) for i in range(ROUNDS)]), begin, lambda a, r: F.struct(
            F.when(r % 2 == 0, (a["row"] + shift(r, a["column"])) % rows).otherwise(a["row"]).alias("row"),
            F.when(r % 2 == 1, (a["column"] + shift(r, a["row"])) % columns).otherwise(a["column"]).alias("column")),
            lambda a: a["row"] * columns + a["column"])
        return end

    x = (F.col(index) if isinstance(index, str) else index).cast("bigint")
    again = F.aggregate(F.sequence(F.lit(1), F.lit(min(spare, 64))), once(x), lambda a, _: F.when(a < n, a).otherwise(once(a))) if spare else once(x)
    return F.when(again < n, again).when(x.isNotNull(), F.raise_error(F.lit("permuted: no place found")).cast("bigint"))


def shuffle_permuted(df: DataFrame, index: str, n: int, seed=K.SPLIT_SEED, epoch: int = 0, name: str = "position") -> DataFrame:
    """Repeatable random order of rows that have a dense index (T5): a map, a new order per epoch without any exchange."""
    return df.withColumn(name, permuted(index, n, seed, f"epoch{epoch}"))


def shuffle_rows(df: DataFrame, key: str = "custom_id", seed=K.SPLIT_SEED, epoch: int = 0,
                 name: str = "position") -> DataFrame:
    """Repeatable random order (T5): range-partitioned sort on ``md5(seed:epoch:key)``, dense position."""
    h = key_hash(key, seed, f"epoch{epoch}")
    return assign_row_id(df.withColumn("_h", h), ["_h", key], name=name).drop("_h")
