import hashlib
import itertools
import math
import random

import numpy as np

from tagwright.llm import digest


def neighbours(docs):
    """(id, chars, edited) in descending id order (text key within an id, null last), cyclic; equal rows are one document."""
    def key(d):
        i, t = d
        return (i is None, -(i or 0), hashlib.md5(t.encode()).hexdigest())
    order = sorted({(i, t or "") for i, t in docs}, key=key)
    out = {}
    for k, (i, t) in enumerate(order):
        half = len(t) // 2
        out[(i, t)] = t[:len(t) - half] + order[(k + 1) % len(order)][1][:half]
    return sorted(((i, len(t or ""), out[(i, t or "")]) for i, t in docs), key=str)


def prose(rng, n):
    return " ".join("".join(rng.choice("etaoinshrdlu") for _ in range(rng.randrange(2, 9))) for _ in range(n))


def test_edited_texts_match_brute_force(spark, docs_of):
    rng = random.Random(8)
    docs = [(i, prose(rng, rng.randrange(0, 60)) + rng.choice(["", "é日😀"])) for i in rng.sample(range(10**12), 90)]
    docs += docs[:2] + [(docs[0][0], "same id, other text"), (None, "no id"), (None, None), (-5, ""), (-6, "x")]
    for parts in ("1", "13"):
        spark.conf.set("spark.sql.shuffle.partitions", parts)
        got = digest.with_neighbours(docs_of(docs)).collect()
        assert sorted(((r["doc_id"], r["n_chars"], r["edited"]) for r in got), key=str) == neighbours(docs)
    spark.conf.set("spark.sql.shuffle.partitions", "8")
    assert all(0 <= r["near_edited"] <= 1 and 0 <= r["near_next"] <= 1 for r in got)


def test_likeness_of_copies_edits_and_strangers(spark, docs_of):
    rng = random.Random(9)
    docs = [(i, prose(rng, 400)) for i in range(40)] + [(100, "copy " + prose(rng, 300))] * 1
    docs.append((99, docs[-1][1]))   # the next document of 100 is a copy
    got = {r["doc_id"]: r for r in digest.with_neighbours(docs_of(docs)).collect()}
    assert got[100]["fingerprint"] == got[99]["fingerprint"] and got[100]["near_next"] == 1
    strangers = [got[i]["near_next"] for i in range(40)]
    edits = [got[i]["near_edited"] for i in range(40)]
    assert max(strangers) < 0.2 and min(edits) > 0.25
    near = docs[5][1].replace("e", "e", 1)[:-30] + " a changed end of it"
    f = digest.entropy_counts(docs_of(docs))
    assert digest.likeness(digest.digest(docs[5][1], f), digest.digest(near, f)) > 0.8


def brute_bin(w):
    return -sum(w.count(c) / 64 * math.log2(w.count(c) / 64) for c in set(w)) / 6 * digest.BINS


def brute_chosen(k):
    """Runs of spans with the same least key, span by span."""
    span = min(64, max(1, len(k) // 8))
    runs = [(key, len(list(g))) for key, g in itertools.groupby(min(k[i:i + span]) for i in range(len(k) - span + 1))]
    need = max(1, span // 4)
    return [key for key, n in runs if n >= need] or [key for key, n in runs if n == max(m for _, m in runs)]


def test_entropy_and_selection_match_brute_force(monkeypatch):
    rng = random.Random(3)
    counts = np.array([rng.randrange(50) for _ in range(digest.BINS + 1)])
    rare = digest.rarity(counts)
    assert all((rare[i] < rare[j]) == (counts[i] < counts[j]) for i in range(0, 1000, 37) for j in range(1001))
    for block in (1 << 15, 50):   # one block, and many
        monkeypatch.setattr(digest, "_BLOCK", block)
        for n in (1, 40, 64, 65, 100, 180, 191, 192, 700):
            text = bytes(rng.choice(b"abcdefg hij\x00\xff") for _ in range(n))
            raw = np.frombuffer(text, dtype=np.uint8)
            padded = text.ljust(64, b"\x00")
            every = [padded[i:i + 64] for i in range(len(padded) - 63)]
            bins = np.concatenate([digest._entropy_bins(part) for part in digest._blocks(raw)])
            assert len(bins) == len(every) and all(abs(brute_bin(w) - b) <= 0.501 for w, b in zip(every, bins.tolist()))
            assert digest.bin_counts(raw).tolist() == np.bincount(bins, minlength=digest.BINS + 1).tolist()
            k = digest.keys(raw, rare)
            assert (k >> np.uint64(54)).tolist() == (rare[bins] >> np.uint64(54)).tolist()
            alone = [int(digest.keys(np.frombuffer(w, dtype=np.uint8), rare)[0]) for w in every]   # a key follows from its window alone
            assert k.tolist() == alone and len(set(alone)) == len(set(every))
            assert digest.improbable(k).tolist() == brute_chosen(k.tolist())
    flat = digest.keys(np.zeros(500, dtype=np.uint8), rare)
    assert digest.improbable(flat).tolist() == [int(flat[0])]


def test_keys_of_a_spliced_text_are_those_of_its_halves():
    rng = np.random.default_rng(5)
    rare = digest.rarity(np.arange(digest.BINS + 1))
    sizes = (0, 1, 30, 62, 63, 64, 65, 127, 128, 300)
    for a, b in itertools.product(sizes, sizes):
        first, second = (rng.integers(97, 110, n).astype(np.uint8) for n in (a + 70, b + 5))
        for cut in {a, a + 70}:
            raw = np.concatenate([first[:cut], second[:b]])
            got = digest.spliced_keys(raw, digest.keys(first, rare), digest.keys(second, rare), cut, rare)
            assert got.tolist() == digest.keys(raw, rare).tolist()


def test_ranges_follow_the_size_and_long_texts_leave_the_task_early(spark, docs_of, monkeypatch):
    assert digest.range_count(10, 8) == 8 and digest.range_count(100 * digest.RANGE_BYTES + 1, 8) == 101
    docs = docs_of([(i, prose(random.Random(i), 200)) for i in range(30)] + [(7, "twice"), (7, "twice"), (31, None)])
    counts, n_bytes = digest.corpus_counts(docs)
    assert counts.tolist() == digest.entropy_counts(docs).tolist()
    assert n_bytes == sum(len((r["text"] or "").encode()) for r in docs.collect())
    plain = digest.with_neighbours(docs)
    rows = sorted(map(tuple, plain.collect()))
    monkeypatch.setattr(digest, "RANGE_BYTES", n_bytes // 12)   # more ranges
    monkeypatch.setattr(digest, "FLUSH_CHARS", 1)               # every row at once
    assert sorted(map(tuple, digest.with_neighbours(docs).collect())) == rows and len(rows) == 33


def test_hostile_rows_and_small_tables(spark, hostile, docs_of):
    got = digest.with_neighbours(hostile)
    assert got.count() == 12
    empty = [r for r in got.collect() if r["n_chars"] == 0]
    assert all(r["fingerprint"] == "" for r in empty)
    assert digest.with_neighbours(hostile.limit(0)).count() == 0
    alone = digest.with_neighbours(docs_of([(1, "just one document")])).collect()
    assert alone[0]["near_next"] == 1 and alone[0]["edited"] == "just one just one"[:9] + "just one"
