import random

import numpy as np

from tagwright.llm import minhash


def shingles(text, k=4):
    words = [w for w in "".join(" " if c in "\t\n\x0b\x0c\r " else c for c in text or "").split(" ") if w]
    words = ["".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in w) for w in words]
    return {" ".join(words[i:i + k]) for i in range(max(1, len(words) - k + 1))} if words else set()


def brute(rows, k=4, percent=80):
    """rows: (id, text) -> list of (id, set size, smallest id reachable), compared pair by pair."""
    sets = [shingles(t, k) for _, t in rows]
    group = list(range(len(rows)))

    def find(i):
        while group[i] != i:
            i = group[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= percent * len(sets[i] | sets[j]):
                group[find(i)] = find(j)
    out = []
    for i, (d, _) in enumerate(rows):
        ids = [rows[j][0] for j in range(len(rows)) if find(j) == find(i) and rows[j][0] is not None]
        c = min(ids) if ids else None
        out.append((d, len(sets[i]), c, d == c))
    return sorted(out, key=str)


def grouped(docs):
    return sorted((tuple(r) for r in minhash.near_copies(docs).select("doc_id", "n_shingles", "component_id", "kept").collect()), key=str)


def edited(rng, words, changes):
    words = list(words)
    for _ in range(changes):
        words[rng.randrange(len(words))] = f"new{rng.randrange(10**6)}"
    return words


def sample(seed, bases=30):
    rng = random.Random(seed)
    vocabulary = [f"Wörd{i}" for i in range(2000)]
    texts = []
    for _ in range(bases):
        base = [rng.choice(vocabulary) for _ in range(rng.choice([1, 3, 4, 40, 120, 400]))]
        for _ in range(rng.randrange(1, 5)):
            texts.append(rng.choice([" ", "\n", "  "]).join(edited(rng, base, rng.randrange(len(base) // 16 + 1))))
    return texts


def test_matches_brute_force(spark, docs_of):
    texts = sample(1) + ["", None, " \x0b\x0c", "a b C", "A B c", "A B c"]
    got = grouped(docs_of(texts))
    assert got == brute(list(enumerate(texts))) and any(not r[3] for r in got)


def test_one_large_group_of_near_copies_and_chains(spark, docs_of):
    """A group in which most pairs are under the threshold: chains of small edits, far ends unlike each other."""
    rng = random.Random(2)
    texts, words = [], [f"w{i}" for i in range(200)]
    for _ in range(120):
        words = edited(rng, words, 2)
        texts.append(" ".join(words))
    texts += [" ".join(edited(rng, [f"v{i}" for i in range(100)], 3)) for _ in range(150)]
    assert grouped(docs_of(texts)) == brute(list(enumerate(texts)))


def test_small_tiles_give_the_same_components(spark, docs_of, monkeypatch):
    monkeypatch.setattr(minhash, "TILE", 3)
    monkeypatch.setattr(minhash, "TILE_SHINGLES", 500)
    texts = sample(3, 15)
    assert grouped(docs_of(texts)) == brute(list(enumerate(texts)))


def test_hostile_and_empty_tables(spark, hostile):
    rows = [(r["doc_id"], r["text"]) for r in hostile.collect()]
    assert grouped(hostile) == brute(rows)
    assert grouped(hostile.limit(0)) == []


def test_threshold_is_exact(spark, docs_of):
    """36 of 45 shingles in common are linked, 35 of 45 are not."""
    rows = []
    for common in (36, 35):
        a = [f"c{common}w{i}" for i in range(common + 3)]
        rows += [" ".join(a + [f"a{common}{i}" for i in range(5)]), " ".join(a + [f"b{common}{i}" for i in range(45 - common - 5)])]
    got = grouped(docs_of(rows))
    assert got == brute(list(enumerate(rows)))
    assert [r[2] for r in got] == [0, 0, 2, 3]


def test_bands_find_pairs_at_the_threshold():
    """Sets of similarity 0.8 share a band in both collections, practically always."""
    rng = np.random.default_rng(5)
    missed = 0
    for _ in range(1500):
        x = rng.integers(0, 1 << 63, 180, dtype=np.uint64)
        a, b = (minhash.signature(s).reshape(2, minhash.BANDS, minhash.ROWS) for s in (x[:162], x[18:]))   # 144 of 180 in common
        missed += not (a == b).all(axis=2).any(axis=1).all()
    assert missed <= 2


def pairs_in_one_key(spark, pairs, unlike=5):
    """Nodes 2 i and 2 i + 1 have signatures that agree in 80 of 84 places, others in few; all share one table key."""
    rng = np.random.default_rng(8)
    nodes = []
    for i in range(pairs):
        s = rng.integers(0, 256, 84, dtype=np.uint8)
        t = s.copy()
        t[:4] += 1
        nodes += [(2 * i, 100, bytearray(s.tobytes())), (2 * i + 1, 110, bytearray(t.tobytes()))]
    nodes += [(2 * pairs + i, 100, bytearray(rng.integers(0, 256, 84, dtype=np.uint8).tobytes())) for i in range(unlike)]
    df = spark.createDataFrame(nodes, "node long, n long, short binary")
    return df, df.selectExpr("7L as key", "node")


def test_every_pair_of_a_key_is_compared(spark, docs_of, monkeypatch):
    """Sets unlike the key's centres still meet each other, in one tile or many."""
    minhash.ensure_checkpoint_dir(spark)
    nodes, keys = pairs_in_one_key(spark, 40)
    for tile in (minhash.KEY_TILE, 7):
        monkeypatch.setattr(minhash, "KEY_TILE", tile)
        groups = {}
        for r in minhash.clusters(nodes, keys).collect():
            groups.setdefault(r["root"], set()).add(r["node"])
        assert sorted(map(sorted, groups.values())) == [[2 * i, 2 * i + 1] for i in range(40)]


def test_pairs_beside_a_common_passage_match_brute_force(spark, docs_of):
    """Texts that share half of their shingles crowd the same keys; only the pairs among them are links."""
    rng = random.Random(9)
    passage, texts = [f"p{i}" for i in range(110)], []
    for _ in range(60):
        own = [f"o{rng.randrange(10**9)}" for _ in range(60)]
        texts += [" ".join(passage + own), " ".join(passage + edited(rng, own, 2))]
    got = grouped(docs_of(texts))
    assert got == brute(list(enumerate(texts))) and sum(r[3] for r in got) == 60


def near_group(seed, size, words=80):
    """Near copies of one text, and texts that share half of it with them."""
    rng = random.Random(seed)
    base, texts = [f"b{i}" for i in range(words)], []
    for i in range(size):
        texts.append(" ".join(edited(rng, base, 2)))
        if i % 3 == 0:
            texts.append(" ".join(base[:words // 2] + [f"x{rng.randrange(10**9)}" for _ in range(words // 3)]))
    return texts


def test_a_group_of_near_copies_has_one_key_per_band(spark, docs_of):
    """Rows that are joined by key follow the sets and their bands, not the bands' combinations."""
    minhash.ensure_checkpoint_dir(spark)
    sets = [minhash.shingle_set(t, 4) for t in near_group(12, 60)]
    rows = [(i, minhash.band_hashes(minhash.signature(h))) for i, h in enumerate(sets)]
    keys, *_ = minhash.tables(spark.createDataFrame(rows, "node long, bands array<bigint>"))
    assert 0 < keys.count() <= minhash.BANDS * len(rows)


def test_bands_larger_than_a_tile_are_cut_and_match_brute_force(spark, docs_of, monkeypatch):
    texts = near_group(13, 45) + sample(14, 8)
    want = brute(list(enumerate(texts)))
    for tile in (minhash.KEY_TILE, 5):
        monkeypatch.setattr(minhash, "KEY_TILE", tile)
        assert grouped(docs_of(texts)) == want
