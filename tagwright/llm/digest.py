"""Document fingerprints: improbable-feature digests.

Features are the 64-byte windows of a text, one at every byte. A window's rarity is how seldom windows of its entropy are
in the whole corpus: one pass counts the entropies of all windows of all documents into ``BINS`` bins. In
each run of ``SPAN`` successive windows the rarest (of equally rare ones the one of the least hash) gets a vote, and windows
with ``VOTES`` or more in a row are the improbable features. They are inserted in text order into Bloom filters of
2048 bits with five hash functions; after 160 features the next filter is begun. Two digests are
compared by the share of common bits above what chance gives, each filter of
the shorter chain with its best match in the other.

From one window to the next one byte leaves and one enters, so entropies follow from how often these two are among the
63 bytes between: a stable sort of a block's bytes gives these counts for all its windows at once. An edited
text has the windows of its two halves, read before, and the 63 across the seam.

``with_neighbours`` puts documents in descending order of id without a global window: ids are cut
into ranges (one per ``RANGE_BYTES`` of text), each range is one partition sorted by id, and the first document of the next range
travels with the one before it.

Defined results: null texts count as empty; empty texts have the empty fingerprint, which is like itself (1)
and unlike any other (0); texts under 64 bytes are one window; rows equal in id and text are one
document; rows with equal ids follow each other by text key, null ids come last; the only
document is its own neighbour; an empty table gives no rows.
"""

from __future__ import annotations

import base64

import numpy as np
import pyarrow as pa
from pyspark.ml.feature import Bucketizer
from pyspark.sql import DataFrame, functions as F

from tagwright.llm.common import text_key, utf8

WINDOW, BINS = 64, 1000
RANGE_BYTES = 128 << 20   # text of one id range, about: what one task sorts and compares
FLUSH_CHARS = 8_000_000   # characters of edited text held before they leave the task
SPAN, VOTES = 64, 16
SHORT = 8                 # a text of fewer than SHORT spans has spans of 1/SHORT of its windows
BITS, HASHES, FILL = 2048, 5, 160
_BLOCK = 1 << 15          # windows worked on at a time
_MIX = np.uint64(0x9E3779B97F4A7C15)
_HASH_BITS = np.uint64(54)   # of a window's key; the ten above hold its rarity
_N = np.arange(WINDOW + 1)
_NLOGN = np.round(np.where(_N > 0, _N * np.log2(np.maximum(_N, 1)), 0.0) * (1 << 20)).astype(np.int64)   # whole numbers: sums are exact
_GAIN = np.diff(_NLOGN)


def _blocks(raw: np.ndarray):
    """The bytes of successive blocks of windows; a text under 64 bytes is one window, filled up with zeros."""
    if 0 < len(raw) < WINDOW:
        raw = np.concatenate([raw, np.zeros(WINDOW - len(raw), dtype=np.uint8)])
    for k in range(0, len(raw) - WINDOW + 1, _BLOCK):
        yield raw[k:k + _BLOCK + WINDOW - 1]


def _entropy_bins(part: np.ndarray) -> np.ndarray:
    """Entropy bin of each window of a block."""
    n = len(part)
    order = np.argsort(part, kind="stable")
    spot = part[order] * np.int64(n + WINDOW) + order    # ascending: positions of each byte, bytes far apart
    place = np.arange(n)
    ahead, back = np.empty(n, dtype=np.int64), np.empty(n, dtype=np.int64)
    ahead[order] = np.searchsorted(spot, spot + (WINDOW - 1), side="right") - place - 1   # equal ones among the next 63
    back[order] = place - np.searchsorted(spot, spot - (WINDOW - 1), side="left")         # and among the last 63
    total = np.empty(n - WINDOW + 1, dtype=np.int64)
    total[0] = _NLOGN[np.bincount(part[:WINDOW])].sum()
    total[1:] = _GAIN[back[WINDOW:]] - _GAIN[ahead[:n - WINDOW]]
    return np.rint((1 - np.cumsum(total) / _NLOGN[WINDOW]) * BINS).astype(np.int64)


def _hashes(part: np.ndarray) -> np.ndarray:
    """64-bit hash of each window of a block."""
    n = len(part) - WINDOW + 1
    eight = np.ascontiguousarray(np.lib.stride_tricks.sliding_window_view(part, 8)).view("<u8").ravel()
    h = np.zeros(n, dtype=np.uint64)
    for j in range(0, WINDOW, 8):
        h = (h ^ eight[j:j + n]) * _MIX
        h ^= h >> np.uint64(31)
    return h


def bin_counts(raw: np.ndarray) -> np.ndarray:
    """How many windows of a text fall into each entropy bin."""
    total = np.zeros(BINS + 1, dtype=np.int64)
    for part in _blocks(raw):
        total += np.bincount(_entropy_bins(part), minlength=BINS + 1)
    return total


def rarity(counts: np.ndarray) -> np.ndarray:
    """Per entropy bin its rank by count, as the high bits of a key; bins of equal counts have the same."""
    return np.unique(counts, return_inverse=True)[1].astype(np.uint64) << _HASH_BITS


def keys(raw: np.ndarray, rare: np.ndarray) -> np.ndarray:
    """One key per window: its rarity, then its hash. The smaller, the rarer."""
    out = [rare[_entropy_bins(part)] | (_hashes(part) >> (np.uint64(64) - _HASH_BITS)) for part in _blocks(raw)]
    return np.concatenate(out) if out else np.zeros(0, dtype=np.uint64)


def spliced_keys(raw: np.ndarray, first: np.ndarray, second: np.ndarray, cut: int, rare: np.ndarray) -> np.ndarray:
    """``keys(raw, rare)`` of a text whose first ``cut`` bytes begin the text with the keys ``first`` and whose others begin
    that of ``second``; only windows across the seam are read."""
    if len(raw) < WINDOW:
        return keys(raw, rare)
    seam = raw[max(0, cut - WINDOW + 1):cut + WINDOW - 1]
    return np.concatenate([first[:max(0, cut - WINDOW + 1)], keys(seam, rare) if len(seam) >= WINDOW else first[:0],
                           second[:max(0, len(raw) - cut - WINDOW + 1)]])


def _least(k: np.ndarray, span: int) -> np.ndarray:
    """The least of each ``span`` successive keys."""
    width = 1
    while 2 * width <= span:
        k, width = np.minimum(k[:-width], k[width:]), 2 * width
    return np.minimum(k[:width - span], k[span - width:]) if width < span else k


def improbable(k: np.ndarray) -> np.ndarray:
    """Keys of the windows that are the rarest around, in text order. In texts of fewer than SHORT * SPAN
    windows spans are shorter and fewer votes do; if no window has enough votes, those with the most stay."""
    n = len(k)
    if n == 0:
        return k
    span = min(SPAN, max(1, n // SHORT))
    votes, winners = [], []
    for s in range(0, n - span + 1, _BLOCK):
        least = _least(k[s:s + _BLOCK + span - 1], span)
        head = np.concatenate([[0], np.flatnonzero(least[1:] != least[:-1]) + 1])
        run, value = np.diff(head, append=len(least)), least[head]
        if winners and winners[-1][-1] == value[0]:   # a run that goes on from the block before
            run[0] += votes[-1][-1]
            votes[-1], winners[-1] = votes[-1][:-1], winners[-1][:-1]
            if not len(winners[-1]):
                votes.pop(), winners.pop()
        votes.append(run)
        winners.append(value)
    run, value = np.concatenate(votes), np.concatenate(winners)
    chosen = run >= max(1, span * VOTES // SPAN)
    return value[chosen if chosen.any() else run == run.max()]


def filters(chosen: np.ndarray) -> np.ndarray:
    """The chain of Bloom filters, one row of bytes each."""
    chain = []
    seen = np.array(list(dict.fromkeys(chosen.tolist())), dtype=np.uint64)
    seen = (seen ^ (seen >> np.uint64(29))) * _MIX
    seen ^= seen >> np.uint64(32)
    for k in range(0, len(seen), FILL):
        h = seen[k:k + FILL]
        bits = np.zeros(BITS, dtype=np.uint8)
        for j in range(HASHES):
            bits[((h >> np.uint64(12 * j)) % np.uint64(BITS)).astype(np.int64)] = 1
        chain.append(np.packbits(bits))
    return np.array(chain, dtype=np.uint8).reshape(len(chain), BITS // 8)


def raw_bytes(text: str | None) -> np.ndarray:
    return np.frombuffer(utf8(text), dtype=np.uint8)


def digest(text: str | None, counts: np.ndarray) -> np.ndarray:
    return filters(improbable(keys(raw_bytes(text), rarity(counts))))


def to_string(chain: np.ndarray) -> str:
    return base64.b64encode(chain.tobytes()).decode()


def from_string(s: str) -> np.ndarray:
    return np.frombuffer(base64.b64decode(s), dtype=np.uint8).reshape(-1, BITS // 8)


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    """0 to 1: mean over the shorter chain of the best normalised bit overlap."""
    if len(a) == 0 or len(b) == 0:
        return float(len(a) == len(b))
    if len(a) > len(b) or (len(a) == len(b) and a.tobytes() > b.tobytes()):
        a, b = b, a
    na, nb = np.bitwise_count(a).sum(1).astype(float), np.bitwise_count(b).sum(1).astype(float)
    best = []
    for i in range(len(a)):
        common = np.bitwise_count(a[i] & b).sum(1)
        chance, most = na[i] * nb / BITS, np.minimum(na[i], nb)
        score = (common - chance) / np.maximum(most - chance, 1e-9)
        best.append(float(np.clip(score, 0, 1).max()))
    return float(np.mean(best))


def entropy_counts(docs: DataFrame) -> np.ndarray:
    """How many windows of the whole corpus fall into each entropy bin (BINS + 1 numbers)."""
    return corpus_counts(docs)[0]


def corpus_counts(docs: DataFrame) -> tuple[np.ndarray, int]:
    """The entropy counts and the corpus's size in bytes, in one pass."""
    def count(source):
        total = np.zeros(BINS + 2, dtype=np.int64)   # the last one counts bytes
        for batch in source:
            for text in batch.column(0).to_pylist():
                raw = raw_bytes(text)
                total[:-1] += bin_counts(raw)
                total[-1] += len(raw)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], names=["bin", "n"])

    rows = docs.select("text").mapInArrow(count, "bin long, n long").groupBy("bin").agg(F.sum("n").alias("n")).collect()
    out = np.zeros(BINS + 2, dtype=np.int64)
    for r in rows:   # at most BINS + 2
        out[r["bin"]] = r["n"]
    return out[:-1], int(out[-1])


def range_count(n_bytes: int, least: int) -> int:
    """Id ranges for a corpus of ``n_bytes``: they grow in number with it, not in size."""
    return max(least, -(-n_bytes // RANGE_BYTES))


def ranges(docs: DataFrame, n_bytes: int = 0) -> DataFrame:
    """Documents dealt into id ranges (``_part``, descending ids), each followed by the first one of the next range."""
    spark = docs.sparkSession
    parts = range_count(n_bytes, int(spark.conf.get("spark.sql.shuffle.partitions")))
    d = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    d = d.withColumn("_key", text_key("text")).withColumn("_neg", F.coalesce(-F.col("doc_id").cast("double"), F.lit(float("inf"))))
    probs = [(i + 1) / parts for i in range(parts - 1)]
    bounds = sorted({b for b in d.where("doc_id is not null").approxQuantile("_neg", probs, 0.2 / parts)}) if probs else []
    d = Bucketizer(splits=[-float("inf"), *bounds, float("inf")], inputCol="_neg", outputCol="_part").transform(d) \
        if bounds else d.withColumn("_part", F.lit(0.0))
    d = d.withColumn("_part", F.col("_part").cast("int")).drop("_neg")
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), (-F.col("doc_id")).alias("neg"), F.col("_key").alias("key"))).alias("f")
    firsts = [(r["_part"], r["f"]["neg"], r["f"]["key"]) for r in d.groupBy("_part").agg(first).orderBy("_part").collect()]  # one per range
    if not firsts:
        return d.withColumn("_guest", F.lit(False))
    # the range before each one, the first after the last
    calls = [(firsts[i - 1][0], None if neg is None else -neg, key) for i, (_, neg, key) in enumerate(firsts)]
    asked = F.broadcast(spark.createDataFrame(calls, "_to int, _id long, _text string"))   # one row per range
    guests = (d.join(asked, F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("_key") == F.col("_text")))
              .dropDuplicates(["_to"]).select("doc_id", "text", "_key", F.col("_to").alias("_part"), F.lit(True).alias("_guest")))
    every = d.select("doc_id", "text", "_key", "_part", F.lit(False).alias("_guest")).unionByName(guests)
    dealt = every.repartitionById(parts, F.col("_part")) if hasattr(every, "repartitionById") else every.repartition(parts, "_part")
    return dealt.sortWithinPartitions("_part", "_guest", F.col("doc_id").desc_nulls_last(), "_key")


OUT = ("doc_id long, n_chars long, edited string, fingerprint string, edited_fingerprint string, "
       "near_edited double, near_next double")


def with_neighbours(docs: DataFrame) -> DataFrame:
    """Every document's digest, its edited text (the last half of its code points replaced by as many first ones of the
    next document) with that text's digest, and the likeness to the edited text and to the next document."""
    counts, n_bytes = corpus_counts(docs)
    held = docs.sparkSession.sparkContext.broadcast(counts)   # BINS + 1 numbers

    def run(source):
        rare = rarity(held.value)
        now, out, waiting = None, {n.split()[0]: [] for n in OUT.split(", ")}, 0

        def close(doc, following):
            nonlocal waiting
            half = len(doc["text"]) // 2
            start = doc["text"][:len(doc["text"]) - half]
            edited = start + following["text"][:half]
            mark = filters(improbable(spliced_keys(raw_bytes(edited), doc["keys"], following["keys"], len(utf8(start)), rare)))
            row = (doc["doc_id"], len(doc["text"]), edited, to_string(doc["mark"]), to_string(mark),
                   likeness(doc["mark"], mark), likeness(doc["mark"], following["mark"]))
            for _ in range(doc["times"]):
                for column, v in zip(out.values(), row):
                    column.append(v)
                waiting += len(edited) + len(row[3]) + len(row[4])
                if len(out["doc_id"]) >= 500 or waiting >= FLUSH_CHARS:
                    yield flush()

        def flush():
            nonlocal waiting
            waiting = 0
            batch = pa.RecordBatch.from_arrays(
                [pa.array(v, t) for v, t in zip(out.values(), (pa.int64(), pa.int64(), *[pa.string()] * 3, *[pa.float64()] * 2))],
                names=list(out))
            for v in out.values():
                v.clear()
            return batch

        for batch in source:
            for doc_id, text, part, guest in zip(*(batch.column(i).to_pylist() for i in (0, 1, 3, 4))):
                if now is not None and not guest and (now["doc_id"], now["part"], now["text"]) == (doc_id, part, text):
                    now["times"] += 1
                    continue
                found = keys(raw_bytes(text), rare)
                following = {"doc_id": doc_id, "text": text, "part": part, "times": 1, "keys": found, "mark": filters(improbable(found))}
                if now is not None:
                    yield from close(now, following)
                now = None if guest else following   # a guest is the last row of its range
        if out["doc_id"]:
            yield flush()

    return ranges(docs, n_bytes).mapInArrow(run, OUT)
