"""Mini-batch training over epochs: synchronous gradients, a history row per epoch, stopped by its own history, resumable.

The classifier is a softmax over hashed tokens (the tokens of ``bayes``). Texts are read once, each task counts the tokens
of its own: the counts are stored in ``slots``, folders that a hash of the key fills evenly, and an epoch's order of slots
gives each step a few of them. An epoch is one Spark job, however many steps it has: all tasks read the slots, and one task
is given their rows in the order of steps, a batch at a time, sorted on disk where they don't fit. It adds up a step's
gradient as whole numbers (units of 2^-36), clips the mean gradient and takes an Adam step under a warm-up and linear decay
of the learning rate. A step needs the weights of the step before, so steps don't run side by side; the task holds the
weights, a batch and a step's sums. Whole numbers add up alike in any order, so the history does not depend on the number
of partitions.

After each epoch weights, moments and the history row are written to ``path/epoch=<n>``. A run that finds finished epochs
in its path goes on after them with the same result; it stops when the validation F1 has not improved for ``patience``
epochs, and the best epoch's weights are restored.
"""

from __future__ import annotations

import random
from collections.abc import Callable
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from tagwright import constants as K
from tagwright.operators import balance as B, metrics as M
from tagwright.operators.bayes import MAX_CLASSES, clean
from tagwright.session import ensure_checkpoint_dir, finished, scratch_path

UNIT = float(1 << 36)
CELLS = 1 << 21            # weights that a task takes out of the model at once
ROWS = 1000                # of a batch of counted texts
ASCII = 128
P1, P2, P3, P4, P5 = 0x9E3779B185EBCA87, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x85EBCA77C2B2AE63, 0x27D4EB2F165667C5   # of xxhash64


class Settings(NamedTuple):
    features: int = 1 << 12        # hashed tokens: the model has features x classes weights, which is what a step sends
    batch: int = 512               # rows of a step, on average
    epochs: int = 3
    learning_rate: float = 0.05
    warmup: float = 0.1            # share of all steps
    clip: float = 1.0              # largest norm of the mean gradient
    beta1: float = 0.9
    beta2: float = 0.999
    patience: int = K.PATIENCE
    slots_per_step: int = 4
    seed: int = K.SPLIT_SEED


class EpochRun(NamedTuple):
    history: DataFrame             # epoch, steps, learning_rate, train_loss, val_loss, val_accuracy, val_f1
    best_epoch: int
    weights: np.ndarray            # of the best epoch: (features + 1) x classes, the last row is the bias
    labels: list[int]
    settings: Settings


def _rotated(h: np.ndarray, bits: int) -> np.ndarray:
    return (h << np.uint64(bits)) | (h >> np.uint64(64 - bits))


def _utf8(c: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of code points, the first byte lowest, and their number."""
    c = c.astype(np.uint64)
    at = lambda bits: (c >> np.uint64(bits) & np.uint64(0x3F)) | np.uint64(0x80)
    two = np.uint64(0xC0) | c >> np.uint64(6) | at(0) << np.uint64(8)
    three = np.uint64(0xE0) | c >> np.uint64(12) | at(6) << np.uint64(8) | at(0) << np.uint64(16)
    four = np.uint64(0xF0) | c >> np.uint64(18) | at(12) << np.uint64(8) | at(6) << np.uint64(16) | at(0) << np.uint64(24)
    sizes = [c < 0x80, c < 0x800, c < 0x10000]
    return np.select(sizes, [c, two, three], four), np.select(sizes, [1, 2, 3], 4).astype(np.uint64)


def token_places(first: np.ndarray, second: np.ndarray, size: int) -> np.ndarray:
    """``pmod(xxhash64(token), size)`` of tokens of two code points, or of one where ``second`` is 0; a token has 8 bytes at most."""
    (word, n), (more, k) = _utf8(first), _utf8(second)
    k[second == 0] = 0
    word, n = word | more << (n * np.uint64(8)), n + k
    h = np.uint64(42 + P5) + n
    with np.errstate(over="ignore"):
        full = _rotated(h ^ _rotated(word * np.uint64(P2), 31) * np.uint64(P1), 27) * np.uint64(P1) + np.uint64(P4)
        half = _rotated(h ^ (word & np.uint64(0xFFFFFFFF)) * np.uint64(P1), 23) * np.uint64(P2) + np.uint64(P3)
        h = np.select([n == 8, n >= 4], [full, half], h)
        rest, left = np.where(n >= 4, word >> np.uint64(32), word), np.where(n == 8, 0, n % np.uint64(4))
        for i in range(3):
            h = np.where(left > i, _rotated(h ^ (rest >> np.uint64(8 * i) & np.uint64(0xFF)) * np.uint64(P5), 11) * np.uint64(P1), h)
        h = (h ^ h >> np.uint64(33)) * np.uint64(P2)
        h = (h ^ h >> np.uint64(29)) * np.uint64(P3)
        h ^= h >> np.uint64(32)
    return np.mod(h.view(np.int64), size)


def _text_places(text: str, table: np.ndarray, size: int) -> np.ndarray:
    """The place of every character and neighbouring pair; ``table`` has those of ASCII."""
    c = np.frombuffer(text.encode("utf-32-le"), dtype="<u4")
    first, second = np.r_[c, c[:-1]], np.r_[np.zeros_like(c), c[1:]]
    known = (first < ASCII) & (second < ASCII)
    if known.all():
        return table[first * ASCII + second]
    out = np.empty(len(first), dtype=np.int64)
    out[known] = table[first[known] * ASCII + second[known]]
    out[~known] = token_places(first[~known], second[~known], size)
    return out


def _counted(places: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    if size > 16 * len(places):
        return np.unique(places, return_counts=True)
    n = np.bincount(places)
    at = np.flatnonzero(n)
    return at, n[at]


def _vectors(df: DataFrame, size: int) -> DataFrame:
    """(key, label, at, n) of rows (key, label, text): a text's characters and their neighbouring pairs, counted by place."""
    kind = df.schema["key"].dataType.simpleString()

    def run(batches):
        a = np.arange(ASCII, dtype=np.uint32)
        table = token_places(a.repeat(ASCII), np.tile(a, ASCII), size)     # of the commonest tokens
        for b in (x.slice(i, ROWS) for x in batches for i in range(0, x.num_rows, ROWS)):
            each = [_counted(_text_places(x.as_py() or "", table, size), size) for x in b.column("text")]
            ends = pa.array(np.cumsum([0, *(len(at) for at, _ in each)]), pa.int32())
            at, n = (pa.array(np.concatenate([x[i] for x in each], dtype=np.int64), kind) for i, kind in enumerate((pa.int32(), pa.int64())))
            yield pa.RecordBatch.from_arrays([b.column("key"), b.column("label"), *(pa.ListArray.from_arrays(ends, x) for x in (at, n))], names=["key", "label", "at", "n"])

    return df.mapInArrow(run, f"key {kind}, label int, at array<int>, n array<bigint>")


def features(df: DataFrame, size: int, key: str, text: str, label: str) -> DataFrame:
    """(key, label, at, n): the hashed tokens of a text in ascending place and how often they occur.

    Texts are counted where they are. Rows that share a key have the counts of all their texts, a row without a key has none.
    """
    ensure_checkpoint_dir(df.sparkSession)
    d = df.select(F.col(key).alias("key"), F.col(label).cast("int").alias("label"), F.when(F.col(key).isNotNull(), clean(text)).alias("text"))
    shared = d.where("key IS NOT NULL").groupBy("key").agg(F.count(F.lit(1)).alias("c")).where("c > 1").select("key").checkpoint()
    if shared.isEmpty():
        return _vectors(d, size)
    some = d.join(shared, "key", "left_semi").select("key", "label", "text")
    each = _vectors(some, size).select("key", F.explode(F.arrays_zip("at", "n")).alias("_")).groupBy("key", "_.at").agg(F.sum("_.n").alias("n"))
    sums = each.groupBy("key").agg(F.sort_array(F.collect_list(F.struct("at", "n"))).alias("v"))   # at most ``size`` entries
    summed = some.select("key", "label").join(sums, "key", "left").select(
        "key", "label", F.coalesce("v.at", F.array().cast("array<int>")).alias("at"), F.coalesce("v.n", F.array().cast("array<bigint>")).alias("n"))
    return _vectors(d.join(shared, "key", "left_anti").select("key", "label", "text"), size).unionByName(summed)


def _rows(batch: pa.RecordBatch):
    """Labels and vectors of unit length of a batch with the columns label, at, n."""
    for y, at, n in zip(batch.column("label").to_pylist(), batch.column("at"), batch.column("n")):
        at, n = at.values.to_numpy(), n.values.to_numpy().astype(np.float64)
        yield y, at, n / np.sqrt((n * n).sum()) if len(n) else n


def _softmax(w: np.ndarray, at: np.ndarray, x: np.ndarray) -> np.ndarray:
    z = (w[at] * x[:, None]).sum(axis=0) + w[-1]
    z = np.exp(z - z.max())
    return z / z.sum()


def _entries(lists: pa.ListArray) -> np.ndarray:
    o = lists.offsets.to_numpy()
    return lists.values.to_numpy()[o[0]:o[-1]]


def _add(total: np.ndarray, rows: pa.RecordBatch, w: np.ndarray, labels: list[int], weights: list[float]) -> tuple[int, int]:
    """Adds the rows' gradient to ``total`` (classes x places); their loss and weight. All are whole numbers of 1 / UNIT."""
    k, entries = rows.num_rows, rows.column("at").offsets.to_numpy()
    at, n, row = _entries(rows.column("at")), _entries(rows.column("n")).astype(np.float64), np.repeat(np.arange(k), np.diff(entries))
    x = n / np.sqrt(np.bincount(row, n * n, k))[row]
    z = np.stack([np.bincount(row, w[at, c] * x, k) for c in range(len(labels))], axis=1) + w[-1]
    p = np.exp(z - z.max(axis=1, keepdims=True))
    p /= p.sum(axis=1, keepdims=True)
    place = {y: i for i, y in enumerate(labels)}
    c = np.array([place[y] for y in rows.column("label").to_pylist()])
    weight = np.array(weights)[c]
    loss = -np.rint(weight * np.log(np.maximum(p[np.arange(k), c], 1e-300)) * UNIT).astype(np.int64).sum()
    p[np.arange(k), c] -= 1
    p *= weight[:, None]
    for i in range(len(labels)):
        np.add.at(total[i], at, np.rint(x * p[row, i] * UNIT).astype(np.int64))
    total[:, -1] += np.rint(p * UNIT).astype(np.int64).sum(axis=0)
    return int(loss), int(np.rint(weight * UNIT).astype(np.int64).sum())


def _runs(batch: pa.RecordBatch, classes: int):
    """(step, rows) of a batch in the order of steps, in slices that bound what ``_add`` holds."""
    steps, entries = batch.column("step").to_numpy(), batch.column("at").offsets.to_numpy().astype(np.int64)
    cut = (entries[:-1] - entries[0]) * classes // CELLS
    edges = [0, *(np.flatnonzero((np.diff(steps) != 0) | (np.diff(cut) != 0)) + 1).tolist(), batch.num_rows]
    for a, b in zip(edges, edges[1:]):
        if a < b:
            yield int(steps[a]), batch.slice(a, b - a)


def _epoch(rows: DataFrame, state: tuple[np.ndarray, ...], s: Settings, epoch: int, per_epoch: int, slots: int, labels: list[int],
           weights: list[float]) -> tuple[tuple[np.ndarray, ...], float, float]:
    """Weights and moments after an epoch, its loss and weight: one Spark job. All tasks read the slots; one task gets their rows in the
    order of steps, a batch at a time, and takes the steps, since each needs the weights of the step before."""
    spark, order = rows.sparkSession, slot_order(s, epoch, slots)
    places = spark.createDataFrame([(slot, i // s.slots_per_step) for i, slot in enumerate(order)], "slot long, step int")   # a row for each folder
    dealt = rows.join(F.broadcast(places), "slot").select("step", "label", "at", "n")
    shared = spark.sparkContext.broadcast(state)       # the model: features x classes, fixed by the settings

    def run(batches):
        (w, m, v), total, now = (x.copy() for x in shared.value), np.zeros(shared.value[0].shape[::-1], dtype=np.int64), None
        sums, part = [0.0, 0.0], [0, 0]

        def step():
            loss, weight = (x / UNIT for x in part)
            sums[:] = sums[0] + loss, sums[1] + weight
            if weight:
                adam(s, w, m, v, np.ascontiguousarray(total.T) / UNIT / weight, (epoch - 1) * per_epoch + now + 1, per_epoch * s.epochs)
            total[:], part[:] = 0, (0, 0)

        for b in batches:
            for i, mine in _runs(b, len(labels)):
                if now is not None and i != now:
                    step()
                now, (loss, weight) = i, _add(total, mine, w, labels, weights)
                part[:] = part[0] + loss, part[1] + weight
        if now is not None:
            step()
        yield pa.RecordBatch.from_arrays([pa.array([x]) for x in (*(x.tobytes() for x in (w, m, v)), *sums)], names=["w", "m", "v", "loss", "weight"])

    r = dealt.repartition(1).sortWithinPartitions("step").mapInArrow(run, "w binary, m binary, v binary, loss double, weight double").collect()[0]
    shared.destroy()
    return tuple(np.frombuffer(r[c]).reshape(state[0].shape).copy() for c in ("w", "m", "v")), r["loss"], r["weight"]


def classify(rows: DataFrame, w: np.ndarray, labels: list[int]) -> DataFrame:
    """(key, true_label, predicted_label, loss) of feature rows; the loss of a label the model has not seen is null."""
    shared = rows.sparkSession.sparkContext.broadcast(w)
    place = {y: i for i, y in enumerate(labels)}

    def run(batches):
        for b in batches:
            p = [(y, _softmax(shared.value, at, x)) for y, at, x in _rows(b)]
            yield pa.RecordBatch.from_arrays([b.column("key"), b.column("label"), pa.array([labels[int(x.argmax())] for _, x in p], pa.int32()),
                                              pa.array([-float(np.log(max(x[place[y]], 1e-300))) if y in place else None for y, x in p], pa.float64())],
                                             names=["key", "true_label", "predicted_label", "loss"])

    kind = rows.schema["key"].dataType.simpleString()
    return rows.select("key", "label", "at", "n").mapInArrow(run, f"key {kind}, true_label int, predicted_label int, loss double")


def _store(df: DataFrame, path: str, *by: str) -> DataFrame:
    if not finished(df.sparkSession, path):
        (df.repartition(*by) if by else df).write.mode("overwrite").partitionBy(*by).parquet(path)   # a folder is one task's, in one file
    return df.sparkSession.read.parquet(path)


def learning_rate(s: Settings, step: int, steps: int) -> float:
    """Of a step (from 1): linear up to the end of the warm-up, then linear down to 0 after the last step."""
    up = max(1, round(s.warmup * steps))
    return s.learning_rate * (step / up if step <= up else (steps - step + 1) / (steps - up + 1))


def adam(s: Settings, w: np.ndarray, m: np.ndarray, v: np.ndarray, g: np.ndarray, step: int, steps: int) -> None:
    """One step in place, on the clipped gradient."""
    norm = float(np.sqrt((g * g).sum()))
    g = g * min(1.0, s.clip / norm) if norm > 0 else g
    m += (1 - s.beta1) * (g - m)
    v += (1 - s.beta2) * (g * g - v)
    w -= learning_rate(s, step, steps) * (m / (1 - s.beta1 ** step)) / (np.sqrt(v / (1 - s.beta2 ** step)) + 1e-8)


def slot_order(s: Settings, epoch: int, slots: int) -> list[int]:
    order = list(range(slots))
    random.Random(f"{s.seed}:{epoch}").shuffle(order)
    return order


def train_epochs(train: DataFrame, validation: DataFrame, settings: Settings = Settings(), path: str | None = None, key: str = "custom_id",
                 text: str = "message", label: str = "class", class_weighted: bool = True,
                 after_epoch: Callable[[int], None] | None = None) -> EpochRun:
    """Train on ``train``, judge every epoch on ``validation``; ``path`` (shared) makes the run resumable. Rows without a
    class take no part; the run needs at least one row with a class. A key is one text."""
    spark, s = train.sparkSession, settings
    path = path or scratch_path(spark, "epochs")
    train, validation = (d.where(F.col(label).isNotNull()) for d in (train, validation))
    classes = B.class_weights(train, label).orderBy(label).limit(MAX_CLASSES + 1).collect()   # one row per class
    if not 0 < len(classes) <= MAX_CLASSES:
        raise ValueError(f"between 1 and {MAX_CLASSES} classes are needed")
    labels, weights = [r[label] for r in classes], [float(r["weight"]) if class_weighted else 1.0 for r in classes]
    per_epoch = max(1, -(-sum(r["n"] for r in classes) // s.batch))
    slots, steps = per_epoch * s.slots_per_step, per_epoch * s.epochs
    rows = _store(features(train, s.features, key, text, label).withColumn("slot", F.pmod(F.xxhash64(F.lit(s.seed), "key"), F.lit(slots))),
                  f"{path}/train", "slot")
    held = _store(features(validation, s.features, key, text, label), f"{path}/validation")

    shape = (s.features + 1, len(labels))
    w, m, v = (np.zeros(shape) for _ in range(3))
    history: list[tuple] = []
    best, waited = 0.0, 0
    kinds = "epoch int, steps long, learning_rate double, train_loss double, val_loss double, val_accuracy double, val_f1 double"
    for epoch in range(1, s.epochs + 1):
        at = f"{path}/epoch={epoch}"
        if finished(spark, at):
            r = spark.read.parquet(at).first()
            w, m, v = (np.array(r[c]).reshape(shape) for c in ("w", "m", "v"))
            history.append(tuple(r[c] for c in ("n_epoch", "steps", "learning_rate", "train_loss", "val_loss", "val_accuracy", "val_f1")))
        else:
            (w, m, v), loss, weight = _epoch(rows, (w, m, v), s, epoch, per_epoch, slots, labels, weights)
            scored = classify(held, w, labels).checkpoint()
            f1 = M.weighted_prf(scored).first()
            # whole numbers again: the mean does not depend on the order of the rows
            val = scored.agg(F.sum(F.round(F.col("loss") * UNIT).cast("long")).alias("s"), F.count("loss").alias("n")).first()
            history.append((epoch, epoch * per_epoch, learning_rate(s, epoch * per_epoch, steps), loss / weight if weight else 0.0,
                            val["s"] / UNIT / val["n"] if val["n"] else 0.0, f1["accuracy"] if f1 and f1["accuracy"] is not None else 0.0,
                            f1["f1"] if f1 and f1["f1"] is not None else 0.0))
            (spark.createDataFrame([(*history[-1], *(x.ravel().tolist() for x in (w, m, v)))],
                                   kinds.replace("epoch int", "n_epoch int") + ", w array<double>, m array<double>, v array<double>")
             .coalesce(1).write.mode("overwrite").parquet(at))
            if after_epoch:
                after_epoch(epoch)
        # as in operators.history: an epoch improves if it is strictly better than all before, from 0 on
        best, waited = (history[-1][-1], 0) if history[-1][-1] > best else (best, waited + 1)
        if waited >= s.patience:
            break
    f1s = [h[-1] for h in history]
    best_epoch = f1s.index(max(f1s)) + 1
    r = spark.read.parquet(f"{path}/epoch={best_epoch}").select("w").first()
    return EpochRun(spark.createDataFrame(history, kinds), best_epoch, np.array(r["w"]).reshape(shape), labels, s)
