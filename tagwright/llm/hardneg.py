"""Hard-negative mining with Kronecker-packed products.

Vectors of integers are scored by exact inner products. Several candidates' components, biased to be non-negative, are
written into separate fields of one wide integer (64 bits while the scores allow it, Python integers of any width
otherwise). One product per anchor component then advances all of them at once: no field can overflow into the next,
because a field has as many bits as the largest possible sum. The exact scores are read from the fields and the biases
taken off.

Anchors are a stated query set. They are taken in blocks of at most ``block_mb`` of components; a block is broadcast and
each task runs its own candidates past it, keeping the best few per anchor, so candidates are never moved or paired.
A block takes two passes: one for the positives, one for the negatives that fit each positive's range.

Defined results: rows with a null label, a null vector or a null or non-finite component take no part; vectors of unequal
length are padded with zeros; a null id is never an anchor and comes after all ids; equal scores go by smaller id; a
repeated row is another row; an anchor without positives, or a positive without negatives in range, gives no rows; a score
beyond a long is null (beyond 38 digits it is held at 38 digits); an empty table gives no rows; extra columns are not read.
"""

from __future__ import annotations

import math
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window as W, functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import DecimalType, LongType, StructField, StructType

from tagwright.session import ensure_checkpoint_dir, scratch_path

SCALE = 256.0
SMALL = 1 << 55        # scores below this stay in 64-bit integers, with room for the percentages
WIDE_FIELDS = 64       # candidates per Python integer beyond that
CELLS = 1 << 20        # scores held by a task at a time
NO_ID = np.iinfo(np.int64).max
LOWEST = -(1 << 62)


def usable(vectors: DataFrame, vector: str = "embedding", label: Column | str = "label") -> DataFrame:
    """(id, label, vector, h) of the rows that take part; h tells rows of one id apart."""
    good = F.forall(F.col(vector), lambda x: x.isNotNull() & ~F.isnan(x.cast("double")) & (F.abs(x.cast("double")) < float("inf")))
    d = vectors.select(F.col("vec_id").cast("long").alias("id"), (F.col(label) if isinstance(label, str) else label).cast("long").alias("label"),
                       F.col(vector).cast("array<double>").alias("vector"), good.alias("_good"))
    return d.where(F.col("label").isNotNull() & F.col("_good")).select("id", "label", "vector", F.xxhash64("vector").alias("h"))


def _integers(column: pa.Array, length: int, wide: bool) -> np.ndarray:
    """floor(SCALE * x) of list<double> values as a matrix, short vectors padded with zeros."""
    lengths = np.diff(column.offsets.to_numpy())
    flat = column.flatten().to_numpy(zero_copy_only=False)
    out = np.zeros((len(lengths), length), dtype=object if wide else np.int64)
    at = np.arange(length)[None, :] < lengths[:, None]
    if wide:
        out[at] = [math.floor(SCALE * x) if math.isfinite(SCALE * x) else int(x) * int(SCALE) for x in flat.tolist()]
    else:
        out[at] = np.floor(SCALE * flat).astype(np.int64)
    return out


def packed_scores(a: np.ndarray, c: np.ndarray, bias: int, top: int) -> np.ndarray:
    """Inner products of the rows of ``a`` and ``c`` (components between -bias and top), several candidates per product."""
    length = a.shape[1]
    width = max(1, (length * (top + bias) ** 2).bit_length())
    fields = WIDE_FIELDS if a.dtype == object else 63 // width
    n = -(-len(c) // fields)
    full = np.zeros((n * fields, length), dtype=c.dtype)
    full[:len(c)] = c + bias
    words = np.zeros((n, length), dtype=c.dtype)
    for f in range(fields):
        words += full[f::fields] << (f * width)     # candidate i is in word i // fields, field i % fields
    sums = (a + bias) @ words.T                     # one product per word and anchor component
    out = np.empty((len(a), n * fields), dtype=c.dtype)
    for f in range(fields):
        out[:, f::fields] = (sums >> (f * width)) & ((1 << width) - 1)
    return out[:, :len(c)] - bias * (a.sum(axis=1)[:, None] + c.sum(axis=1)[None, :]) - length * bias * bias


class _Best:
    """The first k entries (score descending, id ascending, h) of each slot so far."""

    def __init__(self, slots: int, k: int, wide: bool):
        self.k, kind = k, object if wide else np.int64
        self.slot, self.id, self.h = (np.zeros(0, dtype=np.int64) for _ in range(3))
        self.score = np.zeros(0, dtype=kind)
        self.worst = np.full(slots, LOWEST, dtype=kind)   # a slot's k-th score, once it has k
        if wide:
            self.worst[:] = [-math.inf] * slots

    def add(self, slot: np.ndarray, score: np.ndarray, ident: np.ndarray, h: np.ndarray) -> None:
        if not len(slot):
            return
        slot, score = np.concatenate([self.slot, slot]), np.concatenate([self.score, score])
        ident, h = np.concatenate([self.id, ident]), np.concatenate([self.h, h])
        order = np.lexsort((h, ident))
        order = order[np.argsort(-score[order], kind="stable")]
        order = order[np.argsort(slot[order], kind="stable")]
        s = slot[order]
        starts = np.flatnonzero(np.r_[True, s[1:] != s[:-1]])
        rank = np.arange(len(s)) - np.repeat(starts, np.diff(np.r_[starts, len(s)]))
        order, last = order[rank < self.k], order[rank == self.k - 1]
        self.slot, self.score, self.id, self.h = slot[order], score[order], ident[order], h[order]
        self.worst[slot[last]] = score[last]


def _entries(best: _Best, schema: pa.Schema, wide: bool) -> pa.RecordBatch:
    limit = 10 ** 38 - 1
    score = [Decimal(max(-limit, min(limit, x))) for x in best.score.tolist()] if wide else best.score
    return pa.RecordBatch.from_arrays([pa.array(x, type=f.type) for x, f in zip((best.slot, score, best.id, best.h), schema)], schema=schema)


def _batches(batches, length: int, wide: bool, rows: int = 2048):
    for b in batches:
        for i in range(0, b.num_rows, rows):
            part = b.slice(i, rows)
            ids = part.column(0).fill_null(NO_ID).to_numpy(zero_copy_only=False)
            yield ids, part.column(1).to_numpy(zero_copy_only=False), part.column(3).to_numpy(zero_copy_only=False), \
                _integers(part.column(2), length, wide)


def _schema(wide: bool) -> StructType:
    return StructType([StructField("slot", LongType()), StructField("score", DecimalType(38, 0) if wide else LongType()),
                       StructField("id", LongType()), StructField("h", LongType())])


def _nearest(rows: DataFrame, block, k: int, bias: int, top: int, wide: bool) -> DataFrame:
    """(slot, score, id, h): each task's k best rows of the same label for each anchor of the block (slot: its place)."""
    out = _schema(wide)
    arrow = to_arrow_schema(out)

    def run(batches):
        labels, anchors = block.value["label"], block.value["vector"]
        best = _Best(len(labels), k, wide)
        for ids, label, h, c in _batches(batches, anchors.shape[1], wide):
            for x in np.intersect1d(label, labels).tolist():
                mine, at = np.flatnonzero(labels == x), np.flatnonzero(label == x)
                step = max(1, CELLS // len(at))
                for i in range(0, len(mine), step):
                    s = packed_scores(anchors[mine[i:i + step]], c[at], bias, top)
                    r, q = np.nonzero(s >= best.worst[mine[i:i + step]][:, None])
                    best.add(mine[i:i + step][r], s[r, q], ids[at][q], h[at][q])
        yield _entries(best, arrow, wide)

    return rows.mapInArrow(run, out)


def _hardest(rows: DataFrame, block, ranges, k: int, bias: int, top: int, wide: bool) -> DataFrame:
    """(slot, score, id, h): each task's k best rows of another label within each of the ranges (slot: anchor, positive)."""
    out = _schema(wide)
    arrow = to_arrow_schema(out)

    def run(batches):
        labels, anchors = block.value["label"], block.value["vector"]
        low, high = ranges.value
        best = _Best(low.size, k, wide)
        worst = best.worst.reshape(low.shape)
        for ids, label, h, c in _batches(batches, anchors.shape[1], wide):
            step = max(1, CELLS // len(ids))
            for i in range(0, len(labels), step):
                s = packed_scores(anchors[i:i + step], c, bias, top)
                other = label[None, :] != labels[i:i + step, None]
                for p in range(low.shape[1]):
                    least = np.maximum(low[i:i + step, p], worst[i:i + step, p])
                    r, q = np.nonzero((s >= least[:, None]) & (s <= high[i:i + step, p][:, None]) & other)
                    best.add((i + r) * low.shape[1] + p, s[r, q], ids[q], h[q])
        yield _entries(best, arrow, wide)

    return rows.mapInArrow(run, out)


def _first(entries: DataFrame, k: int) -> DataFrame:
    """The tasks' lists merged: the first k of each slot, with their rank."""
    order = W.partitionBy("slot").orderBy(F.col("score").desc(), "id", "h")
    return entries.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def mine(rows: DataFrame, is_anchor: Column, n_pos: int = 5, n_neg: int = 3, low: int = 50, high: int = 95,
         block_mb: int = 32) -> DataFrame:
    """Hard negatives of the anchors among ``usable`` rows: (anchor_id, positive_id, rank, negative_id, positive_score,
    negative_score) with low * positive_score <= 100 * negative_score <= high * positive_score."""
    spark = rows.sparkSession
    ensure_checkpoint_dir(spark)
    b = rows.agg(F.max(F.size("vector")).alias("d"), F.min(F.array_min("vector")).alias("lo"), F.max(F.array_max("vector")).alias("hi")).first()
    length = max(1, b["d"] or 0)
    bias, top = (max(0, math.ceil(x * SCALE) + 1 if math.isfinite(x * SCALE) else int(x) * int(SCALE) + 1) for x in (-(b["lo"] or 0.0), b["hi"] or 0.0))
    wide = length * (bias + top) ** 2 >= SMALL
    # equal anchor rows have equal results: mined once, given as often as they occur
    anchors = (rows.where(is_anchor & F.col("id").isNotNull()).groupBy("id", "label", "h")
               .agg(F.first("vector").alias("vector"), F.count(F.lit(1)).alias("copies")).checkpoint())
    most = max(1, (block_mb << 20) // (8 * length))            # anchors of a block: its proven bound
    blocks = max(1, -(-2 * anchors.count() // most))           # dealt by hash to half of that on average
    path = scratch_path(spark, "hard-negatives")
    for i in range(blocks):
        got = anchors.where(F.pmod(F.xxhash64("id", "label", "h"), F.lit(blocks)) == i).limit(most + 1).toArrow()
        if got.num_rows > most:
            raise ValueError(f"more than {most} anchors in a block of {block_mb} MB")
        vectors = got["vector"].combine_chunks() if got.num_rows else pa.array([], pa.list_(pa.float64()))
        ids, labels, hs = (got[c].to_numpy() for c in ("id", "label", "h"))
        block = spark.sparkContext.broadcast({"label": labels, "vector": _integers(vectors, length, wide)})
        near = _first(_nearest(rows, block, n_pos + 1, bias, top, wide), n_pos + 1).toPandas()   # n_pos + 1 per anchor of the block
        positives: list[list[tuple[int, int]]] = [[] for _ in ids]
        spared: set[int] = set()
        for slot, score, ident, h in near.sort_values(["slot", "rank"])[["slot", "score", "id", "h"]].itertuples(index=False):
            if slot not in spared and ident == ids[slot] and h == hs[slot]:
                spared.add(slot)                                # the anchor itself, once; a repeated row is another row
            elif len(positives[slot]) < n_pos:
                positives[slot].append((int(score), ident))
        lo, hi = (np.full((len(ids), n_pos), x, dtype=object if wide else np.int64) for x in (1, 0))
        for a, found in enumerate(positives):
            for p, (score, _) in enumerate(found):
                lo[a, p], hi[a, p] = -((-low * score) // 100), (high * score) // 100
        ranges = spark.sparkContext.broadcast((lo, hi))
        table = [(a * n_pos + p, int(ids[a]), ident if ident != NO_ID else None, score if abs(score) < 1 << 63 else None, n)
                 for a, (found, n) in enumerate(zip(positives, got["copies"].to_pylist())) for p, (score, ident) in enumerate(found)]
        pairs = spark.createDataFrame(table, "slot long, anchor_id long, positive_id long, positive_score long, copies long")
        kept = _first(_hardest(rows, block, ranges, n_neg, bias, top, wide), n_neg)
        (kept.join(F.broadcast(pairs), "slot")                  # n_pos rows per anchor of the block
         .withColumn("_copy", F.explode(F.sequence(F.lit(1).cast("long"), "copies")))
         .select("anchor_id", "positive_id", "rank", F.nullif(F.col("id"), F.lit(NO_ID)).alias("negative_id"), "positive_score",
                 F.col("score").try_cast("long").alias("negative_score"))
         .write.parquet(f"{path}/block={i}"))
        block.unpersist()
        ranges.unpersist()
    return spark.read.option("basePath", path).parquet(*[f"{path}/block={i}" for i in range(blocks)]).drop("block")
