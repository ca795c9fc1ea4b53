"""Substring dedup: difference-cover anchors.

A passage of ``WINDOW`` = 13 words that also stands in a document with a smaller id is
removed there. Hashing the 13 words at every position would move a row per word.
Instead 7-word anchors are hashed only at positions whose remainder modulo 7 lies in
the difference cover {1, 2, 4}: for any two positions i, j some d < 7 puts both
i + d and j + d on cover positions, and the anchor there lies inside the 13
words. So equal passages share an aligned anchor, wherever they begin.

0. A text that a smaller id has too is removed as a whole and takes no part in what follows.
1. Anchors that occur in two documents or more (by hash) mark candidates.
2. Around its marked anchors a document extends to all windows that hold one; these are
   grouped by a 128-bit hash, and those that a smaller id has too are removed.

Grouping sorts the rows of a hash by document within a partition and streams over them, with
one row of memory. Before the shuffle each task keeps one row per hash and batch
(the smallest document of the batch); the others are decided where they are and travel
spread by document, so a passage in a third of all documents is no hot key.

Defined results: a null text has no words; a null id is larger than any other; rows with
equal ids are judged alike, against smaller ids only; an empty table gives no rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from tagwright.llm.common import text_key, words_of
from tagwright.session import ensure_checkpoint_dir

WINDOW, PERIOD, COVER = 13, 7, (1, 2, 4)
ANCHOR = WINDOW - PERIOD + 1
LAST = (1 << 63) - 1         # stands for a null id
_A, _B = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93)
_BATCH_CHARS = 8_000_000     # texts whose hashes are combined together before the shuffle


def word_hashes(words: list[bytes]) -> np.ndarray:
    digest = xxhash.xxh64_intdigest
    return np.fromiter((digest(w) for w in words), dtype=np.uint64, count=len(words))


def run_hashes(h: np.ndarray, size: int, at: np.ndarray, factor: np.uint64) -> np.ndarray:
    """Hashes of the ``size`` words from each position in ``at``."""
    out = np.zeros(len(at), dtype=np.uint64)
    for k in range(size):
        out = (out ^ h[at + k]) * factor
        out ^= out >> np.uint64(29)
    return out


def anchor_positions(n: int) -> np.ndarray:
    if n < WINDOW:
        return np.zeros(0, dtype=np.int64)
    at = np.arange(n - ANCHOR + 1)
    return at[np.isin(at % PERIOD, COVER)]


def _combined(keys: list[np.ndarray], doc: np.ndarray, mark_first: bool) -> dict[str, np.ndarray]:
    """Rows of one batch: per key its smallest document to be compared (known 0), the others as known.

    With ``mark_first`` the smallest document of a key with several is known as well.
    """
    order = np.lexsort((doc, *keys[::-1]))
    keys, doc = [k[order] for k in keys], doc[order]
    new = np.ones(len(doc), dtype=bool)
    same = np.ones(max(0, len(doc) - 1), dtype=bool)
    for k in keys:
        same &= k[1:] == k[:-1]
    new[1:] = ~same
    group = np.cumsum(new) - 1
    first = doc[new][group] if len(doc) else doc
    later = doc > first
    repeat = np.zeros(len(doc), dtype=bool)
    repeat[1:] = same & (doc[1:] == doc[:-1])
    later &= ~repeat
    known_first = np.zeros(0, dtype=np.int64)
    if mark_first and len(doc):
        known_first = np.flatnonzero(new)[np.bincount(group, later) > 0]
    pick = np.concatenate([np.flatnonzero(new), np.flatnonzero(later), known_first])
    known = np.ones(len(pick), dtype=bool)
    known[:int(new.sum())] = False
    return {**{f"k{i}": k[pick].view(np.int64) for i, k in enumerate(keys)}, "doc": doc[pick], "known": known}


def _schema(n_keys: int) -> str:
    return ", ".join(f"k{i} long" for i in range(n_keys)) + ", doc long, known boolean"


def _rows(out: dict[str, np.ndarray]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(v) for v in out.values()], names=list(out))


def _batches(source, per_doc, n_keys: int, mark_first: bool):
    """Collect (keys, document) of many texts, then combine them."""
    keys, docs, held = [[] for _ in range(n_keys)], [], 0
    for batch in source:
        cols = batch.to_pydict()
        for i in range(batch.num_rows):
            got = per_doc({c: v[i] for c, v in cols.items()})
            if got is not None and len(got[0]):
                for k, g in zip(keys, got):
                    k.append(g)
                docs.append(np.full(len(got[0]), cols["doc"][i], dtype=np.int64))
            held += len(cols["text"][i] or "")
            if held >= _BATCH_CHARS and docs:
                yield _rows(_combined([np.concatenate(k) for k in keys], np.concatenate(docs), mark_first))
                keys, docs, held = [[] for _ in range(n_keys)], [], 0
    if docs:
        yield _rows(_combined([np.concatenate(k) for k in keys], np.concatenate(docs), mark_first))


def _repeated(rows: DataFrame, n_keys: int, with_first: bool) -> DataFrame:
    """(doc, k0) for every key of a document that a smaller document has too; ``with_first``: that smallest one as well.

    Rows of a key meet in one partition, sorted by document, and are streamed: only the key in hand and its first
    document are remembered.
    """
    names = [f"k{i}" for i in range(n_keys)]
    spread = F.when(F.col("known"), F.xxhash64("doc", "k0")).otherwise(F.col("k0"))
    dealt = rows.repartition(spread).sortWithinPartitions("known", *names, "doc")

    def stream(source):
        held = None   # key, first document, whether it was given out
        for batch in source:
            keys = np.stack([batch.column(i).to_numpy() for i in range(n_keys)])
            doc = batch.column(n_keys).to_numpy()
            known = batch.column(n_keys + 1).to_numpy(zero_copy_only=False)
            out_doc, out_key = [doc[known]], [keys[0][known]]
            keys, doc = keys[:, ~known], doc[~known]
            if len(doc):
                given = np.zeros(len(doc) + (held is not None), dtype=bool)
                if held is not None:
                    keys = np.concatenate([held[0][:, None], keys], axis=1)
                    doc = np.concatenate([[held[1]], doc])
                    given[0] = held[2]
                new = np.ones(len(doc), dtype=bool)
                new[1:] = (keys[:, 1:] != keys[:, :-1]).any(axis=0)
                group = np.cumsum(new) - 1
                heads = np.flatnonzero(new)
                later = doc > doc[heads][group]
                if held is not None:
                    later[0] = False
                give = later.copy()
                if with_first:
                    give[heads] |= (np.bincount(group, later) > 0) & ~given[heads]
                out_doc.append(doc[give])
                out_key.append(keys[0][give])
                end = heads[-1]
                held = (keys[:, end].copy(), int(doc[end]), bool(given[end] or give[end]))
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(out_doc)), pa.array(np.concatenate(out_key))], names=["doc", "k0"])

    return dealt.mapInArrow(stream, "doc long, k0 long")


def _by_doc(rows: DataFrame, name: str) -> DataFrame:
    """At most one entry per word of a document."""
    return rows.groupBy("doc").agg(F.collect_set("k0").alias(name)).withColumnRenamed("doc", "_doc")


def _texts(docs: DataFrame) -> DataFrame:
    """doc, text, copy: whether an equal text has a smaller id. Such a copy is removed as a whole, whatever else repeats,
    and its windows are those of that text: the steps below leave it out.

    Texts are shuffled once, by document; every later join on the document reuses that shuffle.
    """
    ensure_checkpoint_dir(docs.sparkSession)
    every = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(LAST)).alias("doc"), "text")
    keys = every.select("doc", text_key("text").alias("key"))
    # stored: texts with several ids only; a text with any number of copies is pre-aggregated, the join may be split
    shared = (keys.groupBy("key").agg(F.min("doc").alias("low"), F.max("doc").alias("high"))
              .where("low < high").select("key", "low").checkpoint())
    copies = (keys.join(shared, "key").where(F.col("doc") > F.col("low"))
              .groupBy(F.col("doc").alias("_copy")).agg(F.collect_set("key").alias("_keys")).checkpoint())
    same = F.coalesce(F.array_contains("_keys", text_key("text")), F.lit(False))
    return every.join(copies, F.col("doc") == F.col("_copy"), "left").select("doc", "text", same.alias("copy"))


def removed_windows(texts: DataFrame) -> DataFrame:
    """(doc, k0): hashes of the windows of a document that a smaller document has too."""
    def anchors(row):
        h = word_hashes(words_of(row["text"]))
        at = anchor_positions(len(h))
        return [np.unique(run_hashes(h, ANCHOR, at, _A))] if len(at) else None

    def windows(row):
        h = word_hashes(words_of(row["text"]))
        at = anchor_positions(len(h))
        hit = at[np.isin(run_hashes(h, ANCHOR, at, _A), np.array(row["marks"], dtype=np.int64).view(np.uint64))]
        near = np.zeros(len(h) - WINDOW + 1, dtype=bool)
        for d in range(PERIOD):
            start = hit - d
            near[start[(start >= 0) & (start < len(near))]] = True
        start = np.flatnonzero(near)
        a, b = (run_hashes(h, WINDOW, start, f) for f in (_A, _B))
        _, one = np.unique(a, return_index=True)
        return [a[one], b[one]]

    texts = texts.where(~F.col("copy")).select("doc", "text")
    marked = _repeated(texts.mapInArrow(lambda s: _batches(s, anchors, 1, True), _schema(1)), 1, with_first=True)
    held = texts.join(_by_doc(marked, "marks"), F.col("doc") == F.col("_doc")).select("doc", "text", "marks")
    return _repeated(held.mapInArrow(lambda s: _batches(s, windows, 2, False), _schema(2)), 2, with_first=False)


def dedup_passages(docs: DataFrame) -> DataFrame:
    """doc_id, n_words, n_removed and ``kept`` (the words that stay, joined by one space) of every document."""
    texts = _texts(docs)
    held = (texts.join(_by_doc(removed_windows(texts), "gone"), F.col("doc") == F.col("_doc"), "left")
            .select("doc", "text", "copy", "gone"))

    def cut(source):
        for batch in source:
            out = {"doc_id": [], "n_words": [], "n_removed": [], "kept": []}
            for doc, text, copy, gone in zip(*(batch.column(i).to_pylist() for i in range(4))):
                words = words_of(text)
                n = len(words)
                if copy and n >= WINDOW:
                    words = []
                elif gone and n >= WINDOW:
                    a = run_hashes(word_hashes(words), WINDOW, np.arange(n - WINDOW + 1), _A)
                    start = np.flatnonzero(np.isin(a, np.array(gone, dtype=np.int64).view(np.uint64)))
                    depth = np.zeros(n + 1, dtype=np.int64)
                    np.add.at(depth, start, 1)
                    np.add.at(depth, start + WINDOW, -1)
                    covered = np.cumsum(depth[:n]) > 0
                    words = [w for w, c in zip(words, covered.tolist()) if not c]
                out["doc_id"].append(None if doc == LAST else doc)
                out["n_words"].append(n)
                out["n_removed"].append(n - len(words))
                out["kept"].append(b" ".join(words).decode("utf-8"))
            yield pa.RecordBatch.from_arrays([pa.array(out["doc_id"], pa.int64()), pa.array(out["n_words"], pa.int64()),
                                              pa.array(out["n_removed"], pa.int64()), pa.array(out["kept"], pa.string())], names=list(out))

    return held.mapInArrow(cut, "doc_id long, n_words long, n_removed long, kept string")
