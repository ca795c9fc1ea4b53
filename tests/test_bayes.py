"""The table model against plain Python, and what holds for any rows."""

import math
import random
from collections import Counter

from tagwright.operators import bayes as NB


def tokens(text):
    c = [x for x in (text or "").lower() if x.isalpha() or x.isnumeric()]
    return Counter(c + [a + b for a, b in zip(c, c[1:])])


def brute(train, test, alpha):
    labels = sorted({y for _, _, y in train if y is not None})
    n = {y: sum(r[2] == y for r in train) for y in labels}
    counts = {y: sum((tokens(t) for _, t, x in train if x == y), Counter()) for y in labels}
    vocabulary = set().union(*counts.values())
    w = {y: sum(n.values()) / (n[y] * len(labels)) for y in labels}
    out = {}
    for k, t, _ in test:
        s = [math.log(n[y] * w[y] / sum(n[x] * w[x] for x in labels)) + sum(
            m * math.log((w[y] * counts[y][g] + alpha) / (w[y] * sum(counts[y].values()) + alpha * len(vocabulary)))
            for g, m in tokens(t).items() if g in vocabulary) for y in labels]
        out[k] = (labels[s.index(max(s))], [1 / sum(math.exp(min(700, b - a)) for b in s) for a in s])
    return out


def rows(seed, n):
    rng = random.Random(seed)
    words = {0: "gut sehr schön", 1: "meh okay 不错", 5: "schlecht 差 übel nie"}
    out = []
    for i in range(n):
        y = rng.choice([0, 0, 0, 1, 5])
        out.append((f"k{i}", rng.choice([" ", "", ", "]).join(rng.choice((words[y] + " der die 12").split()) for _ in range(rng.randrange(5))), y))
    return out


SCHEMA = "custom_id string, message string, class int"


def test_matches_plain_python_on_any_number_of_partitions(spark):
    train, test = rows(1, 120), rows(2, 60) + [("null", None, 0), ("new", "@@ ЖЖЖ", 1), ("none", "gut", None)]
    want = brute(train, test, 0.5)
    for parts in (1, 7):
        model = NB.fit(spark.createDataFrame(train + [("x", "without class", None)], SCHEMA).repartition(parts))
        got = {r["custom_id"]: r for r in NB.classify(model, spark.createDataFrame(test, SCHEMA).repartition(parts), smoothing=0.5).collect()}
        assert {k: r["predicted_label"] for k, r in got.items()} == {k: y for k, (y, _) in want.items()}
        for k, (_, p) in want.items():
            assert all(abs(got[k][f"prob_class_{c}"] - x) < 2e-6 for c, x in zip((0, 1, 5), p)) and got[k]["confidence"] == max(got[k][f"prob_class_{c}"] for c in (0, 1, 5))
    assert got["none"]["true_label"] is None


def test_model_is_a_distribution_per_class(spark):
    model = NB.fit(spark.createDataFrame(rows(3, 80), SCHEMA))
    sums = {}
    for r in model.relation(0.3).collect():
        sums[r["class"]] = sums.get(r["class"], 0) + math.exp(r["log_prob"])
    assert set(sums) == {0, 1, 5} and all(abs(x - 1) < 1e-6 for x in sums.values())


def test_selection_takes_the_best_and_empty_tables_give_no_rows(spark):
    train, validation = spark.createDataFrame(rows(4, 100), SCHEMA), spark.createDataFrame(rows(5, 50), SCHEMA)
    s = NB.select_smoothing(train, validation, (0.01, 1.0, 1e6))
    t = {r["candidate"]: r for r in s.table.collect()}
    assert sum(r["chosen"] for r in t.values()) == 1 and max(t.values(), key=lambda r: r["val_f1"])["val_f1"] == [r for r in t.values() if r["chosen"]][0]["val_f1"]
    for i, x in enumerate((0.01, 1.0, 1e6)):
        hits = [r["true_label"] == r["predicted_label"] for r in NB.classify(s.model, validation, smoothing=x).collect()]
        assert abs(sum(hits) / len(hits) - t[i]["val_accuracy"]) < 1e-9
    empty = train.limit(0)
    assert NB.fit(empty).classes == [] and NB.fit(empty).relation().count() == 0
    assert NB.classify(s.model, empty).count() == 0
