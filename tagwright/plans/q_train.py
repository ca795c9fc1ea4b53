"""Registered queries: classifier training and model selection."""

from __future__ import annotations

from pyspark.sql import functions as F

from tagwright.operators import bayes as NB, epochs as EP, history as H, metrics as M
from tagwright.plans.q_metrics import prf_sql, ratio
from tagwright.plans.q_split import SPLIT, split_df
from tagwright.plans.registry import register
from tagwright.session import ensure_checkpoint_dir

SMOOTHINGS = (0.1, 0.5, 1.0)


def split_parts(spark, sf):
    """One split, several parts; checkpointed rather than cached, so that nothing has to be released."""
    ensure_checkpoint_dir(spark)
    s = split_df(spark, sf).where(F.col("split") != "quarantine").select("custom_id", "message", "class", "split").checkpoint()
    return [s.where(F.col("split") == name).drop("split") for name in ("train", "validation", "test")]


def _tokens(src: str, by: str) -> str:
    chars = f"SELECT {by}, string_split(s, '') AS cs FROM (SELECT {by}, regexp_replace(lower(message), '[^\\p{{L}}\\p{{N}}]', '', 'g') AS s FROM ({src}) q0) q1 WHERE s <> ''"
    return (f"SELECT {by}, token, count(*) AS n FROM (SELECT {by}, unnest(list_concat(cs, list_transform(range(1, len(cs)), lambda i: cs[i] || cs[i + 1]))) AS token "
            f"FROM ({chars}) q2) q3 GROUP BY {by}, token")


# scores of every class for every row of a part of the split, per smoothing, in units of 1e-9
def _scored(part: str, smoothings) -> str:
    alphas = ", ".join(f"({i}, {x}::DOUBLE)" for i, x in enumerate(smoothings))
    return f"""
s AS MATERIALIZED (SELECT * FROM ({SPLIT}) x WHERE split <> 'quarantine'),
counts AS MATERIALIZED ({_tokens("SELECT class, message FROM s WHERE split = 'train'", "class")}),
classes AS (SELECT class, rows, sum(rows) OVER () / (rows * count(*) OVER ())::DOUBLE AS w, tokens FROM (SELECT class, count(*)::DOUBLE AS rows FROM s
  WHERE split = 'train' GROUP BY class) a JOIN (SELECT class, sum(n)::DOUBLE AS tokens FROM counts GROUP BY class) b USING (class)),
vocabulary AS (SELECT DISTINCT token FROM counts),
alphas AS (SELECT * FROM (VALUES {alphas}) t(candidate, smoothing)),
model AS MATERIALIZED (SELECT candidate, c.class, v.token, CAST(round(ln((w * coalesce(n, 0) + smoothing) / (w * tokens + smoothing * (SELECT count(*) FROM vocabulary))) * 1e9) AS BIGINT) AS lp
  FROM alphas CROSS JOIN classes c CROSS JOIN vocabulary v LEFT JOIN counts k ON k.class = c.class AND k.token = v.token),
texts AS MATERIALIZED ({_tokens(f"SELECT custom_id, message FROM s WHERE split = '{part}'", "custom_id")}),
sums AS (SELECT custom_id, candidate, class, sum(n * lp)::BIGINT AS score FROM texts JOIN model USING (token) GROUP BY 1, 2, 3),
scored AS (SELECT t.custom_id, t.class AS true_label, a.candidate, a.smoothing, c.class,
    (coalesce(score, 0) + CAST(round(ln(rows * w / (SELECT sum(rows * w) FROM classes)) * 1e9) AS BIGINT))::BIGINT AS score
  FROM s t CROSS JOIN alphas a CROSS JOIN classes c LEFT JOIN sums x ON x.custom_id = t.custom_id AND x.candidate = a.candidate AND x.class = c.class WHERE t.split = '{part}'),
best AS (SELECT custom_id, true_label, candidate, smoothing, arg_min(class, struct_pack(a := -score, b := class)) AS predicted_label FROM scored GROUP BY ALL)"""


_PROBS = ", ".join(f"max(p) FILTER (class = {c}) AS prob_class_{c}" for c in range(4))


@register("train_text_classifier", f"""
WITH {_scored('test', [1.0])},
probs AS (SELECT a.custom_id, a.class, round(1 / sum(exp(least(700.0::DOUBLE, (b.score - a.score) / 1e9::DOUBLE))), 6) AS p FROM scored a JOIN scored b USING (custom_id) GROUP BY 1, 2),
wide AS (SELECT custom_id, max(p) AS confidence, {_PROBS} FROM probs GROUP BY 1)
SELECT custom_id, true_label, predicted_label, confidence, prob_class_0, prob_class_1, prob_class_2, prob_class_3 FROM best JOIN wide USING (custom_id)
""")
def q_train_text_classifier(spark, sf):
    """Predicted class and probabilities of every test row."""
    train, _, test = split_parts(spark, sf)
    return NB.classify(NB.fit(train), test)


@register("select_best_model", f"""
WITH {_scored('validation', SMOOTHINGS)},
reports AS ({' UNION ALL '.join(f"SELECT {i} AS candidate, {x}::DOUBLE AS smoothing, {ratio('sum(tp)', 'sum(support)')} AS val_accuracy, sum(f1 * support) / sum(support) AS val_f1 "
                                f"FROM ({prf_sql(f'SELECT true_label, predicted_label FROM best WHERE candidate = {i}')}) r" for i, x in enumerate(SMOOTHINGS))})
SELECT candidate, smoothing, round(val_accuracy, 6) AS val_accuracy, round(val_f1, 6) AS val_f1,
  CAST(row_number() OVER (ORDER BY round(val_f1, 12) DESC, candidate) = 1 AS INTEGER) AS chosen FROM reports
""")
def q_select_best_model(spark, sf):
    """Accuracy and F1 of each candidate on the validation rows, and which one is chosen."""
    train, validation, _ = split_parts(spark, sf)
    t = NB.select_smoothing(train, validation, SMOOTHINGS).table
    return t.withColumns({c: F.round(c, 6) for c in ("val_accuracy", "val_f1")})


def _epoch_run(spark, sf):
    train, validation, test = split_parts(spark, sf)
    return EP.train_epochs(train, validation), test


@register("train_epochs")
def q_train_epochs(spark, sf):
    """Mini-batch training: one row per epoch."""
    run, _ = _epoch_run(spark, sf)
    return run.history.withColumns({c: F.round(c, 6) for c in ("learning_rate", "train_loss", "val_loss", "val_accuracy", "val_f1")})


@register("train_early_stopped")
def q_train_early_stopped(spark, sf):
    """A run stopped by its own history, and the accuracy and F1 of the restored best epoch on the test rows."""
    run, test = _epoch_run(spark, sf)
    rows = EP.features(test.where("class is not null"), run.settings.features, "custom_id", "message", "class")
    report = M.weighted_prf(EP.classify(rows, run.weights, run.labels)).select(F.lit("run").alias("run_id"), F.col("accuracy").alias("test_accuracy"), F.col("f1").alias("test_f1"))
    stop = H.early_stopping(run.history.withColumn("run_id", F.lit("run")), run.settings.patience)
    d = stop.join(report, "run_id")
    return d.withColumns({c: F.round(c, 6) for c in ("best_metric", "test_accuracy", "test_f1")})
