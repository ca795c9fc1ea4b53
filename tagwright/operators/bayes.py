"""A Naive Bayes text classifier whose model is a table: fitted by one aggregate, applied by a join and a sum.

Tokens are the letters and digits of a text in lower case and their neighbouring pairs, which fits texts with and without
spaces between words. Training counts tokens per class, ``(token, n)`` with one count per class; the model's log
probabilities follow from these counts, so candidates that differ in smoothing share them. Log probabilities are held
in units of 1e-9 as whole numbers: a text's score is a sum of whole numbers, the same in any order and on any number of
partitions.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, functions as F

from tagwright.operators import metrics as M
from tagwright.session import ensure_checkpoint_dir

UNIT = 1e9
MAX_CLASSES = 1000     # checked: the classes are columns of the model


class BayesClass(NamedTuple):
    label: int
    rows: int
    weight: float       # inverse frequency, or 1
    tokens: int         # occurrences in its texts


class BayesTable(NamedTuple):
    counts: DataFrame   # token, n: its occurrences per class, in the order of ``classes``
    classes: list[BayesClass]
    vocabulary: int

    def log_prob(self, place: int, smoothing: float) -> Column:
        """ln P(token | class) in units of 1e-9."""
        c = self.classes[place]
        whole = c.weight * c.tokens + smoothing * self.vocabulary
        return F.round(F.log((F.lit(c.weight) * F.get("n", F.lit(place)) + F.lit(smoothing)) / F.lit(whole)) * UNIT).cast("long")

    def prior(self, place: int) -> int:
        c = self.classes[place]
        return round(math.log(c.rows * c.weight / sum(x.rows * x.weight for x in self.classes)) * UNIT)

    def relation(self, smoothing: float = 1.0) -> DataFrame:
        """The model as (class, token, log_prob): one row per class and token of the vocabulary."""
        each = F.array(*[F.struct(F.lit(c.label).alias("class"), (self.log_prob(i, smoothing) / UNIT).alias("log_prob"))
                         for i, c in enumerate(self.classes)]).cast("array<struct<class:int,log_prob:double>>")
        return self.counts.select("token", F.explode(each).alias("_")).select("_.class", "token", "_.log_prob")


def clean(text: str) -> Column:
    """The letters and digits of a text in lower case."""
    return F.regexp_replace(F.lower(F.coalesce(F.col(text), F.lit(""))), "[^\\p{L}\\p{N}]", "")


def token_counts(df: DataFrame, text: str, *by: str) -> DataFrame:
    """Occurrences of each token per group, combined in the map tasks before they are shuffled."""
    chars = df.select(*by, clean(text).alias("_clean")).where("_clean <> ''").select(*by, F.split("_clean", "").alias("_c"))
    pairs = F.zip_with(F.slice("_c", 1, F.size("_c") - 1), F.slice("_c", 2, F.size("_c") - 1), lambda a, b: F.concat(a, b))
    return chars.select(*by, F.explode(F.concat("_c", pairs)).alias("token")).groupBy(*by, "token").agg(F.count(F.lit(1)).alias("n"))


def fit(train: DataFrame, text: str = "message", label: str = "class", class_weighted: bool = True) -> BayesTable:
    """Rows without a label take no part. Class weights are the inverse frequencies of ``class_weights``."""
    ensure_checkpoint_dir(train.sparkSession)
    d = train.where(F.col(label).isNotNull()).select(F.col(label).cast("int").alias("_label"), F.col(text).alias("_text"))
    rows = {r["_label"]: r["n"] for r in d.groupBy("_label").agg(F.count(F.lit(1)).alias("n")).limit(MAX_CLASSES + 1).collect()}
    if len(rows) > MAX_CLASSES:
        raise ValueError(f"more than {MAX_CLASSES} classes")
    labels, n = sorted(rows), sum(rows.values())
    per_class = [F.coalesce(F.sum(F.when(F.col("_label") == c, F.col("n"))), F.lit(0)).cast("long") for c in labels]
    one = token_counts(d, "_text", "_label").groupBy("token").agg(F.array(*per_class).alias("n")) if labels else \
        d.select(F.col("_text").alias("token"), F.array().cast("array<bigint>").alias("n")).limit(0)
    counts = one.checkpoint()
    totals = counts.agg(F.count(F.lit(1)), *[F.sum(F.get("n", F.lit(i))) for i in range(len(labels))]).first()   # one row
    classes = [BayesClass(c, rows[c], n / (rows[c] * len(labels)) if class_weighted else 1.0, totals[1 + i] or 0) for i, c in enumerate(labels)]
    return BayesTable(counts, classes, totals[0])


def _scores(model: BayesTable, df: DataFrame, key: str, text: str, label: str, smoothings: Sequence[float]) -> DataFrame:
    """key, true_label and, per smoothing, ``s<i>``: the scores of the classes in units of 1e-9."""
    known = token_counts(df, text, key).withColumnRenamed("n", "_times").join(model.counts, "token")
    sums = [F.sum(F.col("_times") * model.log_prob(c, s)).alias(f"_{i}_{c}") for i, s in enumerate(smoothings) for c in range(len(model.classes))]
    rows = df.select(key, F.col(label).cast("int").alias("true_label"))
    if not sums:
        return rows.select("*", *[F.array().cast("array<bigint>").alias(f"s{i}") for i in range(len(smoothings))])
    d = rows.join(known.groupBy(key).agg(*sums), key, "left")   # a text without a known token has the priors
    return d.select(key, "true_label", *[
        F.array(*[F.coalesce(f"_{i}_{c}", F.lit(0).cast("long")) + F.lit(model.prior(c)).cast("long") for c in range(len(model.classes))]).alias(f"s{i}")
        for i in range(len(smoothings))])


def _predicted(model: BayesTable, scores: str) -> Column:
    """The class of the largest score, the smallest of equal ones."""
    return F.get(F.array(*[F.lit(c.label) for c in model.classes]), (F.array_position(scores, F.array_max(scores)) - 1).cast("int"))


def classify(model: BayesTable, df: DataFrame, key: str = "custom_id", text: str = "message", label: str = "class",
             smoothing: float = 1.0) -> DataFrame:
    """key, true_label, predicted_label, confidence and prob_class_<label> of every row (a key is one text)."""
    def prob(i: int) -> Column:
        far = [F.exp(F.least(F.lit(700.0), (F.get("s0", F.lit(j)) - F.get("s0", F.lit(i))) / UNIT)) for j in range(len(model.classes))]
        return F.round(1 / sum(far[1:], far[0]), 6)

    d = _scores(model, df, key, text, label, [smoothing])
    probs = [prob(i).alias(f"prob_class_{c.label}") for i, c in enumerate(model.classes)]
    d = d.select(key, "true_label", _predicted(model, "s0").alias("predicted_label"), *probs)
    best = F.greatest(*[F.col(f"prob_class_{c.label}") for c in model.classes]) if len(probs) > 1 else F.lit(1.0)
    return d.select(key, "true_label", "predicted_label", best.alias("confidence"), *[c for c in d.columns if c.startswith("prob_class_")])


class BayesSelection(NamedTuple):
    table: DataFrame    # candidate, smoothing, val_accuracy, val_f1, chosen
    model: BayesTable
    smoothing: float    # the chosen one


def select_smoothing(train: DataFrame, validation: DataFrame, smoothings: Sequence[float] = (0.1, 0.5, 1.0), key: str = "custom_id",
                     text: str = "message", label: str = "class") -> BayesSelection:
    """The smoothing of the largest weighted F1 on validation rows, the first of equal ones: one table of counts, one join
    and one grouped report for all candidates."""
    model = fit(train, text, label)
    s = _scores(model, validation.where(F.col(label).isNotNull()), key, text, label, smoothings)
    each = F.array(*[F.struct(F.lit(i).alias("candidate"), F.lit(float(x)).alias("smoothing"), _predicted(model, f"s{i}").alias("predicted_label"))
                     for i, x in enumerate(smoothings)])
    scored = s.select("true_label", F.explode(each).alias("_")).select("true_label", "_.*")
    rows = M.weighted_prf(scored, by=["candidate", "smoothing"]).select("candidate", "smoothing", "accuracy", "f1").collect()   # one per candidate
    best = max(rows, key=lambda r: (round(r["f1"], 12), -r["candidate"]))["candidate"] if rows else 0
    table = train.sparkSession.createDataFrame([(r["candidate"], r["smoothing"], r["accuracy"], r["f1"], int(r["candidate"] == best)) for r in rows],
                                               "candidate int, smoothing double, val_accuracy double, val_f1 double, chosen int")
    return BayesSelection(table, model, float(smoothings[best]))
