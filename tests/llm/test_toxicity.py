import random
import tracemalloc
import zlib

import numpy as np
from pyspark.sql import functions as F

from tagwright.llm import toxicity
from tagwright.llm.common import bounded_labels
from tagwright.sources.tables import load

FAST = toxicity.Config(buckets=1 << 14, epochs=15)


def brute_grams(text, config):
    """N-grams of each word with its ends, by passages of words, spelled out."""
    words = "".join(" " if c in "\t\n\x0b\x0c\r " else c for c in text.lower()).split(" ")
    words = [w for w in words if w]
    passages = max(1, len(words) // config.passage_words)
    out = [[] for _ in range(passages)]
    for i, w in enumerate(words):
        marked = f" {w} "
        for n in config.sizes:
            out[min(i // config.passage_words, passages - 1)] += [marked[k:k + n] for k in range(len(marked) - n + 1)]
    return out


def test_ngrams_match_brute_force():
    config = toxicity.Config(passage_words=3)
    texts = ["A bc def\nghij k l m n", "", " ", "x", "Ünï 日本語 😀 end", "one two three four five six seven"]
    grams, owner, head = toxicity.ngrams(texts, config)
    want = [p for t in texts for p in brute_grams(t, config)]
    assert len(want) == head[-1] and [len(brute_grams(t, config)) for t in texts] == np.diff(head).tolist()
    assert np.bincount(owner, minlength=len(want)).tolist() == [len(p) for p in want]
    name = {}   # equal n-grams fall into equal buckets, wherever they stand
    for p, passage in enumerate(want):
        assert len(set(grams[owner == p])) <= len(set(passage))
    a, _, _ = toxicity.ngrams(["foo bar"], config)
    b, _, _ = toxicity.ngrams(["zz\nfoo  bar."], config)
    assert set(toxicity.ngrams(["foo"], config)[0]) <= set(a) & set(b)


def test_scores_match_the_unfolded_model():
    texts = ["you idiot of a word"] * 3 + ["a calm word of peace"] * 3 + ["", "idiots!"]
    model = toxicity.fit(texts[:6], [1, 1, 1, 0, 0, 0], FAST)
    table, bias = model.folded()
    for t, z in zip(texts, toxicity.text_logits(texts, table, bias, FAST)):
        grams, owner, head = toxicity.ngrams([t], FAST)
        logits = []
        for p in range(int(head[-1])):
            v = model.vectors[grams[owner == p]]
            logit = (v.mean(0) if len(v) else np.zeros(FAST.dim)) @ model.weights + model.bias
            logits.append(logit[1] - logit[0])
        assert abs(max(logits) - z) < 1e-4
    assert toxicity.text_logits(["idiot", "peace"], table, bias, FAST).tolist() == sorted(
        toxicity.text_logits(["idiot", "peace"], table, bias, FAST).tolist(), reverse=True)


def test_held_out_accuracy_and_unseen_misspellings(spark):
    sf = "/root/testdata/sf0.1"
    docs, labels = load(spark, sf, "documents").select("doc_id", "text"), load(spark, sf, "labels")
    model = toxicity.train(docs, labels, ~toxicity.held_out(), toxicity.Config(epochs=15))
    got = toxicity.score(docs.where(toxicity.held_out()).join(labels, "doc_id"), model).select("doc_id", "toxic", "score").collect()
    assert all(zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0 for r in got)
    assert sum((r["score"] >= 0.5) == (r["toxic"] == 1) for r in got) / len(got) > 0.93
    table, bias = model.folded()
    plain, spelled = toxicity.text_logits(["the of and thing", "the of idiott and idiots"], table, bias, model.config)
    assert spelled > plain


def test_one_class_empty_and_hostile_rows(spark, hostile):
    labels = spark.createDataFrame([(1, 1), (5, 1), (None, 0), (8, None), (3, 1), (3, 1)], "doc_id long, toxic int")
    one = toxicity.train(hostile, labels, config=FAST)
    got = toxicity.score(hostile, one).collect()
    assert len(got) == 12 and all(r["score"] > 0.9 for r in got)
    none = toxicity.train(hostile.limit(0), labels.limit(0), config=FAST)
    assert all(0 < r["score"] < 1 for r in toxicity.score(hostile, none).collect())
    assert toxicity.score(hostile.limit(0), none).count() == 0
    mixed = spark.createDataFrame([(5, 0), (6, 0), (7, 1), (8, 1)], "doc_id long, toxic int")
    kept = toxicity.reject_toxic(hostile, mixed, config=FAST)
    assert kept.columns == hostile.columns and {5, 6} <= {r["doc_id"] for r in kept.collect()}


def test_sample_takes_8000_labelled_rows(spark):
    labels = spark.range(10_000).selectExpr("id AS doc_id", "CAST(id % 2 AS int) AS toxic")
    chosen = bounded_labels(labels, "toxic", toxicity.Config().max_rows).groupBy("label").count()
    assert {r["label"]: r["count"] for r in chosen.collect()} == {0: 4000, 1: 4000}


def test_sample_holds_words_not_ngrams():
    config = toxicity.Config(passage_words=3)
    rng = np.random.default_rng(3)
    texts = ["", " ", "A bc\u00a0d def\nghij k l m n", "\ud800 x", "\u03a3\u03a3 \u0130 \u03a3", *(" ".join(f"Wort{i}" for i in rng.integers(0, 40, n)) for n in (1, 2, 3, 400))]
    sample, table = toxicity.Sample.of(texts, config), rng.normal(size=config.buckets)
    grams, owner, head = toxicity.ngrams(texts, config)
    assert np.allclose(sample.scores(table), toxicity.passage_scores(grams, owner, int(head[-1]), table))
    assert (np.cumsum(sample.passages) == head[1:]).all()
    flat, sizes = sample.grams_of(np.arange(int(head[-1])))
    assert (sizes == np.bincount(owner, minlength=int(head[-1]))).all()
    assert all(sorted(got) == sorted(grams[owner == i]) for i, got in enumerate(np.split(flat, np.cumsum(sizes)[:-1])))
    assert len(sample.grams) < len(grams) / 4


def test_words_cut_in_a_task_give_the_same_model(spark, docs_of):
    rng = random.Random(9)
    words = [f"w{i}" for i in range(60)] + ["Straße", "日本", "ÉTÉ"]
    texts = [" ".join(rng.choice(words) for _ in range(rng.randrange(40))) for _ in range(80)] + ["", None]
    y = [rng.randrange(2) for _ in texts]
    labels = spark.createDataFrame(list(enumerate(y)), "doc_id long, toxic int")
    got, want = toxicity.train(docs_of(texts, 4), labels, None, FAST), toxicity.fit(texts, y, FAST)
    assert (got.vectors == want.vectors).all() and (got.weights == want.weights).all() and (got.bias == want.bias).all()


def test_scoring_holds_the_ngrams_of_a_few_texts():
    """A batch of 2,000,000 characters is cut piece by piece, with the logits of each text cut alone."""
    config, rng = toxicity.Config(), random.Random(11)
    vocabulary = [f"wörd{i}" for i in range(500)]
    texts = [" ".join(rng.choices(vocabulary, k=300)) for _ in range(900)] + [None, ""]
    assert sum(len(t or "") for t in texts) > 2_000_000
    table = np.random.default_rng(1).normal(size=config.buckets).astype(np.float32)
    tracemalloc.start()
    got = toxicity.logits(texts, table, 0.5, config)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 60_000_000
    assert got.tolist() == [toxicity.text_logits([t or ""], table, 0.5, config)[0] for t in texts]
    assert toxicity.logits([], table, 0.5, config).tolist() == []
