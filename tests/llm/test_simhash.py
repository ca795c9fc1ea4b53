import random

import xxhash
from pyspark.sql import functions as F

from tagwright.llm import simhash


def brute_print(text, k=3):
    words = [w for w in "".join(c if c not in "\t\n\x0b\x0c\r " else " " for c in text or "").split(" ") if w]
    words = ["".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in w) for w in words]
    if not words:
        return 0
    shingles = [" ".join(words[i:i + k]) for i in range(max(1, len(words) - k + 1))]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_components(prints, distance=2):
    ids = sorted(prints)
    root = {i: i for i in ids}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in ids:
        for j in ids:
            if i < j and bin(prints[i] ^ prints[j]).count("1") <= distance:
                a, b = sorted((find(i), find(j)))
                root[b] = a
    return {i: find(i) for i in ids}


def test_groups_match_brute_force(spark, docs_of):
    rng = random.Random(1)
    vocabulary = [f"Wörd{i}" for i in range(300)]
    texts = []
    for _ in range(40):
        base = [rng.choice(vocabulary) for _ in range(rng.choice([1, 2, 3, 40, 200]))]
        for _ in range(rng.randrange(1, 4)):
            copy = list(base)
            if len(copy) > 50:
                copy[rng.randrange(len(copy))] = "changed"
            texts.append(" ".join(copy) + rng.choice(["", " ", "\n"]))
    texts += ["", None, " \x0b\x0c", "A b C", "a B c"]
    docs = docs_of(texts)
    got = {r["doc_id"]: r for r in simhash.near_groups(docs).withColumn("hex", simhash.hex16("fp")).collect()}
    prints = {i: brute_print(t) for i, t in enumerate(texts)}
    assert {i: r["hex"] for i, r in got.items()} == {i: f"{p:016x}" for i, p in prints.items()}
    assert {i: r["component_id"] for i, r in got.items()} == brute_components(prints)


def test_many_fingerprints_of_one_key(spark):
    """More than PAIRS_UP_TO fingerprints share every key: the way by variants gives the same components."""
    rng = random.Random(2)
    fps = {rng.getrandbits(14) << 20 for _ in range(400)} | {rng.getrandbits(64) for _ in range(50)}
    signed = [(p - (1 << 64) if p >= 1 << 63 else p,) for p in fps]
    df = spark.createDataFrame(signed, "fp long").repartition(5)
    roots = simhash.components(simhash.links(df)).collect()
    mask = (1 << 64) - 1
    found = {p: p for (p,) in signed} | {r["node"]: r["root"] for r in roots}
    want = brute_components({p: p & mask for (p,) in signed})
    assert len(set(want.values())) < len(want) - simhash.PAIRS_UP_TO
    assert found == want


def test_components_of_chains_and_hubs(spark):
    chain = [(i, i + 1) for i in range(100, 160)] + [(500, 500 + i) for i in range(1, 80)] + [(579, 700)]
    random.Random(3).shuffle(chain)
    got = {r["node"]: r["root"] for r in simhash.components(spark.createDataFrame(chain, "a long, b long")).collect()}
    assert got == {**{i: 100 for i in range(101, 161)}, **{500 + i: 500 for i in range(1, 80)}, 700: 500}
    assert simhash.components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_hostile_rows(spark, hostile):
    got = simhash.near_groups(hostile).collect()
    assert len(got) == 12
    empty = [r for r in got if r["fp"] == 0]
    assert len(empty) == 4 and {r["component_id"] for r in empty} == {2}   # two nulls, an empty and a blank text
    kept = simhash.one_per_group(hostile)
    assert kept.columns == hostile.columns
    rows = kept.collect()
    assert sorted(str(r["doc_id"]) for r in rows) == ["1", "1", "2", "5", "7", "8", "None"]
    assert simhash.near_groups(hostile.limit(0)).count() == 0
    assert simhash.one_per_group(hostile.limit(0)).count() == 0


def test_same_on_any_partitioning(spark, docs_of):
    texts = [f"word{i % 7} and some more words to be shingled {i % 5}" for i in range(60)]
    one = simhash.one_per_group(docs_of(texts, 1)).select("doc_id").orderBy("doc_id").collect()
    assert one == simhash.one_per_group(docs_of(texts, 7)).select("doc_id").orderBy("doc_id").collect()
