"""The pipeline's last three stages, one after the other on a planted table, against plain Python."""

import collections
import hashlib
import math
import random
import unicodedata

import corpus_pipeline as P
from tagwright.llm import spm

from .conftest import SF
from .test_mixing import brute_targets
from .test_simhash import brute_components, brute_print

STAGES = dict(P.STAGES)
SF01 = "/root/testdata/sf0.01"


def planted():
    """(id, text, source): own texts, exact copies under larger and smaller ids, near copies, empty and null texts."""
    rng = random.Random(11)
    vocabulary = [f"{a}{b}" for a in ("Ta", "ko", "mi", "é", "7") for b in ("ra", "lun", "7", "so", "日")]
    rows = []
    for i in range(60):
        words = [rng.choice(vocabulary) for _ in range(rng.choice([1, 4, 30, 200]))]
        source = rng.choice(["a", "b", "c", "d", None])
        rows.append((1000 - i, " ".join(words), source))
        if i % 5 == 0:
            rows.append((2000 + i, " ".join(words), source))
        if i % 7 == 0 and len(words) > 100:
            rows.append((3000 + i, " ".join([*words[:-1], "other"]), "b"))
    return rows + [(1, "", "a"), (2, None, "b"), (3, " \n", None)]


def brute_copies(rows):
    """Whole epochs, then documents by their exponential keys while half of each still fits."""
    size = {i: len((t or "").split()) for i, t, _ in rows}
    of = collections.defaultdict(list)
    for i, t, s in rows:
        letters = sum(unicodedata.category(c)[0] == "L" for c in t or "")
        weight = max(0.05, letters / len(t) if t else 0.0)
        key = "null" if t is None else hashlib.md5(t.encode()).hexdigest()
        u = (int(hashlib.md5(f"mix:{i}:{key}".encode()).hexdigest()[:13], 16) + 0.5) / 2 ** 52
        of[s].append((-math.log(u) / weight, i))
    target = brute_targets({s: sum(size[i] for _, i in docs) for s, docs in of.items()})
    copies = {}
    for s, docs in of.items():
        total, upto = sum(size[i] for _, i in docs), 0
        epochs = math.floor(target[s] / total) if total else 0
        rest = target[s] - epochs * total
        for _, i in sorted(docs):
            copies[i] = epochs + (rest > 0 and upto + size[i] / 2 <= rest)
            upto += size[i]
    return {i: n for i, n in copies.items() if n}


def test_near_dedup_mixing_and_encoding(spark, docs_of):
    rows = planted()
    near = STAGES["simhash near-dedup"](spark, docs_of(rows), SF)
    component = brute_components({i: brute_print(t) for i, t, _ in rows})
    kept = [(i, t, s) for i, t, s in rows if component[i] == i]
    assert len(kept) < len(rows) - 12
    assert sorted((r["doc_id"], r["text"], r["source"]) for r in near.collect()) == sorted(kept, key=lambda r: r[0])

    mixed = STAGES["mixing sources"](spark, docs_of(kept), SF)
    got = mixed.collect()
    assert collections.Counter(r["doc_id"] for r in got) == brute_copies(kept)
    text = {i: t for i, t, _ in kept}
    assert all(r["text"] == text[r["doc_id"]] for r in got)

    encoded = STAGES["sentencepiece encoding"](spark, mixed, SF).collect()
    table = spm.decode_table(spm.read_model())
    assert len(encoded) == len(got) and all(r["n_tokens"] == len(r["ids"]) for r in encoded)
    assert all(spm.decode_ids(r["ids"], table) == (text[r["doc_id"]] or "") for r in encoded)


def test_toxic_documents_go_and_clean_ones_stay(spark):
    """All labelled rows, those that the model learnt from included."""
    docs, labels = (spark.read.parquet(f"{SF01}/{n}.parquet") for n in ("documents", "labels"))
    toxic = {r["doc_id"]: r["toxic"] for r in labels.select("doc_id", "toxic").collect()}
    left = {r["doc_id"] for r in STAGES["toxicity"](spark, docs, SF01).select("doc_id").collect()}
    by = collections.Counter((t, i in left) for i, t in toxic.items())
    assert by[(1, False)] > 0.9 * (by[(1, False)] + by[(1, True)]) and by[(0, True)] > 0.97 * (by[(0, True)] + by[(0, False)])


def test_line_dedup_takes_planted_copies(spark):
    docs = spark.read.parquet(f"{SF01}/documents.parquet")
    one = docs.where("n_chars > 3000").orderBy("doc_id").limit(20)
    copies = one.selectExpr("doc_id + 10000000 as doc_id", "text", "lang", "source", "n_chars")
    left = STAGES["line dedup"](spark, one.unionByName(copies), SF01).collect()
    assert not [r for r in left if r["doc_id"] >= 10_000_000] and len(left) >= 18
