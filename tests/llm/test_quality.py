import numpy as np
import pytest
from pyspark.sql import functions as F

from tagwright.llm import quality
from tagwright.sources.tables import load

from .conftest import SF


def brute_counts(text):
    text = text or ""
    words = [w for w in "".join(" " if c in "\t\n\x0b\x0c\r " else c for c in text).split(" ") if w]
    lines = text.split("\n")
    solid = [x for x in lines if x.strip("\t\n\x0b\x0c\r ")]
    windows = [tuple(words[i:i + 3]) for i in range(len(words) - 2)]
    covered = {i + k for i, w in enumerate(windows) if windows.count(w) > 1 for k in range(3)}
    dup = sum(1 for i, x in enumerate(solid) if x in solid[:i])
    return [len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), dup, len(covered)]


def test_counts_match_brute_force(spark):
    texts = [r["text"] for r in load(spark, SF, "documents").where("n_chars < 3000").collect()]
    texts += ["", None, " \n\x0b", "a a a a", "a b c a b c", "x\nx\n x\n\n\n", "é| é|\té|", "a b a b a b a"]
    for t in texts:
        assert quality.statistics(t)[0] == brute_counts(t), t


def test_trees_learn_and_are_monotone():
    rng = np.random.default_rng(0)
    x = rng.uniform(size=(3000, 3))
    y = ((x[:, 0] < 0.6) & (x[:, 1] > 0.3) ^ (rng.uniform(size=3000) < 0.05)).astype(float)
    trees = quality.boost(x[:2000], y[:2000], [-1, 0, 0])
    assert ((trees.logits(x[2000:]) > 0) == (y[2000:] > 0)).mean() > 0.9
    for row in x[2000:2050]:
        line = np.repeat(row[None], 50, axis=0)
        line[:, 0] = np.linspace(0, 1, 50)
        assert (np.diff(trees.logits(line)) <= 1e-12).all()
    walked = [trees.base + sum(_walk(trees, r, row) for r in trees.roots) for row in x[:50]]
    assert walked == pytest.approx(trees.logits(x[:50]).tolist())


def _walk(t, node, row):
    while t.left[node] != node:
        node = t.left[node] if row[t.feature[node]] <= t.threshold[node] else t.right[node]
    return t.value[node]


def test_query_rules_and_held_out_accuracy(spark):
    docs, labels = load(spark, "/root/testdata/sf0.01", "documents"), load(spark, "/root/testdata/sf0.01", "labels")
    seen = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 != 0
    got = quality.apply_rules(docs, quality.train(docs, labels, seen)).join(labels, "doc_id").where(~seen).collect()
    assert all(r["base_failed"] == (r["n_words"] < 50 or 100 * r["n_repeat_words"] > 50 * r["n_words"]) for r in got)
    assert not any(r["kept"] and r["base_failed"] for r in got)
    right = [(r["score"] >= 0.5) == (r["quality"] == 1) for r in got]
    assert sum(right) / len(right) > 0.95


def test_sample_is_counted_in_tasks(spark, docs_of):
    """The features of the bounded sample equal those counted here, in the order of ids, repeated rows and null texts included."""
    docs = docs_of([(i, f"word {i} # again\nword {i}") for i in range(40)] + [(3, None), (3, None)])
    labels = spark.createDataFrame([(i, i % 2) for i in range(30)], "doc_id long, quality int")
    x, y = quality.sample_features(docs, labels)
    want = sorted([(i, f"word {i} # again\nword {i}") for i in range(30)] + [(3, ""), (3, "")], key=lambda r: r[0])
    assert len(x) == 32 and y.tolist() == [i % 2 for i, _ in want]
    assert sorted(map(tuple, x.tolist())) == sorted(tuple(quality.statistics(t)[1]) for _, t in want)
    few, _ = quality.sample_features(docs, labels, config=quality.Config(max_rows=10))
    assert len(few) <= 20


def test_one_class_and_hostile_rows(spark, hostile):
    labels = spark.createDataFrame([(1, 1), (5, 1), (None, 0), (8, None), (1, 1)], "doc_id long, quality int")
    got = quality.apply_rules(hostile, quality.train(hostile, labels)).collect()
    assert len(got) == 12 and all(r["score"] > 0.9 and r["base_failed"] for r in got if r["doc_id"] in (5, 6))
    assert all(r["base_failed"] for r in got if r["n_words"] == 0)
    none = quality.train(hostile.limit(0), labels.limit(0))
    assert quality.apply_rules(hostile.limit(0), none).count() == 0 and quality.apply_rules(hostile, none).count() == 12
