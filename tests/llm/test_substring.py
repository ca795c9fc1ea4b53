import random

from pyspark.sql import functions as F

from tagwright.llm import substring


def brute(docs):
    first = {}
    split = [(i, [w for w in "".join(" " if c in "\t\n\x0b\x0c\r " else c for c in t or "").split(" ") if w]) for i, t in docs]
    for i, w in split:
        for k in range(len(w) - 12):
            key = tuple(w[k:k + 13])
            first[key] = min(first.get(key, 1 << 70), 1 << 65 if i is None else i)
    out = []
    for i, w in split:
        gone = {k + d for k in range(len(w) - 12) if first[tuple(w[k:k + 13])] < (1 << 65 if i is None else i) for d in range(13)}
        out.append((i, len(w), len(gone), " ".join(x for k, x in enumerate(w) if k not in gone)))
    return sorted(out, key=str)


def test_cover_aligns_any_two_positions():
    for i in range(substring.PERIOD):
        for j in range(substring.PERIOD):
            assert any((i + d) % substring.PERIOD in substring.COVER and (j + d) % substring.PERIOD in substring.COVER
                       for d in range(substring.PERIOD))
    assert substring.ANCHOR + substring.PERIOD - 1 == substring.WINDOW


def rows():
    rng = random.Random(7)
    passages = [[f"p{rng.randrange(40)}" for _ in range(rng.randrange(10, 40))] for _ in range(12)]
    docs = []
    for i in rng.sample(range(1000), 120):
        words = []
        for _ in range(rng.randrange(0, 5)):
            words += [f"w{rng.randrange(3000)}" for _ in range(rng.randrange(0, 9))] + rng.choice(passages)
        docs.append((i, rng.choice([" ", "\n", " \t"]).join(words)))
    docs += [(2000 + i, docs[i][1]) for i in range(20)]
    docs += [(None, docs[3][1]), (None, "only here " * 20), (5000, None), (5001, ""), (5002, "a " * 13), (5003, "a " * 200), (5003, "a " * 12),
             (5004, "b " * 12), (5004, "b " * 12)]
    return docs


def test_against_brute_force(spark, docs_of, monkeypatch):
    docs = rows()
    for parts in (1, 7):
        got = substring.dedup_passages(docs_of(docs, parts)).collect()
        assert sorted(((r["doc_id"], r["n_words"], r["n_removed"], r["kept"]) for r in got), key=str) == brute(docs)


def test_common_passage_across_batches(spark, docs_of):
    """A passage in every document, more rows than one Arrow batch and many task batches."""
    common = " ".join(f"c{i}" for i in range(15))
    docs = [(i, f"x{i} {common} y{i}") for i in range(800)]
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "37")
    try:
        got = substring.dedup_passages(docs_of(docs, 9)).select("doc_id", "n_removed").collect()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert {r["doc_id"]: r["n_removed"] for r in got} == {i: 15 * (i > 0) for i in range(800)}


def test_hostile_rows(spark, hostile):
    got = substring.dedup_passages(hostile)
    assert got.count() == 12 and substring.dedup_passages(hostile.limit(0)).count() == 0
    r = {x["doc_id"]: x for x in got.where("doc_id > 4").collect()}
    assert r[6]["n_removed"] == r[6]["n_words"] and r[6]["kept"] == "" and r[5]["n_removed"] == 0
