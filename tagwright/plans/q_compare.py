"""Registered queries: model comparison, training history, logits/probabilities."""

from __future__ import annotations

from pyspark.sql import functions as F

from tagwright import constants as K
from tagwright.functions import vectors as V
from tagwright.operators import balance as B, compare as C, history as H, metrics as M, prepare as P
from tagwright.plans import fixtures as fx, oracle as O
from tagwright.plans.q_metrics import SCORED, VALID, base_scored, conf_sql, name_sql, ratio, report_sql, rounded, scored
from tagwright.plans.q_split import SPLIT, split_df
from tagwright.plans.registry import register
from tagwright.sources.tables import load


def both_models(spark, sf):
    """(model, true_label, predicted_label) of the base model's valid and the tuned model's predictions, one scan."""
    pair = F.array(F.struct(F.lit("base").alias("model"), F.col("base_pred").alias("predicted_label")),
                   F.struct(F.lit("tuned").alias("model"), F.col("tuned_pred").alias("predicted_label")))
    d = fx.preds(spark, sf).select("true_label", F.explode(pair).alias("p")).select("true_label", "p.*")
    return d.where((F.col("model") == "tuned") | (F.col("predicted_label") != K.UNLABELED))


def comparison(spark, sf):
    t = fx.truth(spark, sf)
    return C.compare_models(t, M.valid_predictions(base_scored(spark, sf)), scored(spark, sf))


CMP = f"""
SELECT t.custom_id, t.message, t.true_label, {name_sql('t.true_label')} AS true_class,
  b.op AS original_prediction, {name_sql('b.op')} AS original_class, b.fp AS finetuned_prediction, {name_sql('b.fp')} AS finetuned_class,
  CASE WHEN b.op IS NOT NULL THEN CAST(b.op = t.true_label AS INTEGER) END AS original_correct,
  CASE WHEN b.fp IS NOT NULL THEN CAST(b.fp = t.true_label AS INTEGER) END AS finetuned_correct,
  CAST(CASE WHEN b.op IS NULL OR b.fp IS NULL THEN NULL WHEN b.fp = t.true_label AND b.op <> t.true_label THEN 1
       WHEN b.fp <> t.true_label AND b.op = t.true_label THEN -1 ELSE 0 END AS INTEGER) AS improvement
FROM ({O.TRUTH}) t JOIN (SELECT coalesce(o.custom_id, f.custom_id) AS custom_id, o.predicted_label AS op, f.predicted_label AS fp
  FROM ({VALID}) o FULL OUTER JOIN ({SCORED}) f ON o.custom_id = f.custom_id) b ON t.custom_id = b.custom_id
"""


@register("compare_models", CMP)
def q_compare_models(spark, sf):
    return comparison(spark, sf)


@register("flag_improvement", f"SELECT custom_id, original_prediction, finetuned_prediction, true_label, improvement FROM ({CMP}) c")
def q_flag_improvement(spark, sf):
    return comparison(spark, sf).select("custom_id", "original_prediction", "finetuned_prediction", "true_label",
                                        "improvement")


@register("prediction_changes", f"""
SELECT s.improvement, s.change, CAST(coalesce(c.n, 0) AS BIGINT) AS n,
  {ratio('coalesce(c.n, 0) * 100', '(SELECT count(*) FROM (' + CMP + ') z)')} AS pct
FROM (SELECT -1 AS improvement, 'worsened' AS change UNION ALL SELECT 0, 'unchanged' UNION ALL SELECT 1, 'improved') s
LEFT JOIN (SELECT improvement, count(*) AS n FROM ({CMP}) x GROUP BY 1) c ON s.improvement = c.improvement
""")
def q_prediction_changes(spark, sf):
    return C.prediction_changes(comparison(spark, sf))


@register("join_class_reports", f"""
SELECT o.label, {name_sql('o.label')} AS class_name, o.precision AS original_precision, t.precision AS finetuned_precision,
  t.precision - o.precision AS difference
FROM ({report_sql(VALID)}) o JOIN ({report_sql(SCORED)}) t ON o.label = t.label WHERE o.row_kind = 'class' AND t.row_kind = 'class'
""")
def q_join_class_reports(spark, sf):
    r = M.classification_report(both_models(spark, sf), by=["model"])   # both models in one pass
    return C.join_class_reports(r.where(F.col("model") == "base"), r.where(F.col("model") == "tuned"))


@register("confusion_diff", f"""
SELECT o.true_label, o.predicted_label, o.n AS original_n, t.n AS finetuned_n, t.n - o.n AS diff
FROM ({conf_sql(VALID)}) o JOIN ({conf_sql(SCORED)}) t USING (true_label, predicted_label)
""".replace("o.n AS original_n, t.n AS finetuned_n, t.n - o.n AS diff", "coalesce(o.n, 0) AS original_n, coalesce(t.n, 0) AS finetuned_n, "
            "coalesce(t.n, 0) - coalesce(o.n, 0) AS diff").replace("SELECT o.true_label, o.predicted_label", "SELECT true_label, predicted_label")
            .replace("o JOIN", "o FULL JOIN"))
def q_confusion_diff(spark, sf):
    return C.confusion_diff(M.confusion_matrix(M.valid_predictions(base_scored(spark, sf))),
                            M.confusion_matrix(scored(spark, sf)))


def _metrics_sql(src: str) -> str:
    r = report_sql(src)
    parts = [f"SELECT 'accuracy' AS metric, f1 AS value FROM ({r}) a WHERE row_kind = 'accuracy'"]
    for kind, tag in (("macro avg", "macro"), ("weighted avg", "weighted")):
        for m in ("precision", "recall", "f1"):
            parts.append(f"SELECT '{tag}_{m}', {m} FROM ({r}) b WHERE row_kind = '{kind}'")
    return " UNION ALL ".join(parts)


@register("improvement_vs_baseline", f"""
SELECT b.metric, round(b.value, 6) AS baseline, round(t.value, 6) AS tuned, round((t.value - b.value) * 100, 6) AS absolute_points,
  round(CASE WHEN b.value <> 0 THEN (t.value - b.value) / b.value * 100 END, 6) AS relative_pct
FROM ({_metrics_sql(VALID)}) b JOIN ({_metrics_sql(SCORED)}) t ON b.metric = t.metric
""")
def q_improvement_vs_baseline(spark, sf):
    r = M.classification_report(both_models(spark, sf), by=["model"])
    b, t = (C.report_metrics(r.where(F.col("model") == m)) for m in ("base", "tuned"))
    return rounded(C.improvement_vs_baseline(b, t), "baseline", "tuned", "absolute_points", "relative_pct")


@register("model_stage_pivot", f"""
SELECT model, before, after, after - before AS uplift FROM (
  SELECT 'classifier/' || d.lang AS model,
    {ratio('count(*) FILTER (WHERE p.base_pred = p.true_label AND p.base_pred <> -1)', 'count(*) FILTER (WHERE p.base_pred <> -1)')} AS before,
    {ratio('count(*) FILTER (WHERE p.tuned_pred = p.true_label)', 'count(*)')} AS after
  FROM ({O.PREDS}) p JOIN documents d ON p.doc_id = d.doc_id GROUP BY 1) s
""")
def q_model_stage_pivot(spark, sf):
    d = load(spark, sf, "documents").select("doc_id", F.concat(F.lit("classifier/"), F.col("lang")).alias("model"))
    p = fx.preds(spark, sf).join(d, "doc_id")
    return C.stage_uplift(p, "model", "true_label", {"before": "base_pred", "after": "tuned_pred"})


def history(spark, sf):
    return fx.history(spark, sf).select("run_id", "epoch", F.round(F.col("m") / 100, 6).alias("val_f1"))


HIST = f"SELECT run_id, epoch, round(m / 100, 6) AS val_f1 FROM ({O.HISTORY}) h"
HBEST = f"""
SELECT run_id, epoch, val_f1, improved, best_so_far,
  CAST(epoch - coalesce(max(CASE WHEN improved = 1 THEN epoch END) OVER (PARTITION BY run_id ORDER BY epoch
       ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), 0) AS INTEGER) AS patience
FROM (SELECT *, CAST(val_f1 > greatest(coalesce(max(val_f1) OVER (PARTITION BY run_id ORDER BY epoch
        ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0.0), 0.0) AS INTEGER) AS improved,
      greatest(max(val_f1) OVER (PARTITION BY run_id ORDER BY epoch ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), 0.0) AS best_so_far
      FROM ({HIST}) h) x
"""


@register("history_best", HBEST)
def q_history_best(spark, sf):
    return H.history_best(history(spark, sf))


@register("early_stopping", f"""
WITH h AS ({HBEST}), r AS (SELECT run_id, min(CASE WHEN patience >= {K.PATIENCE} THEN epoch END) AS s, max(epoch) AS l FROM h GROUP BY 1)
SELECT h.run_id, CAST(max(h.epoch) AS INTEGER) AS stop_epoch, max(CAST(r.s IS NOT NULL AS INTEGER)) AS stopped,
  CAST(max(CASE WHEN h.improved = 1 THEN h.epoch END) AS INTEGER) AS best_epoch, greatest(max(h.val_f1), 0.0) AS best_metric
FROM h JOIN r ON h.run_id = r.run_id WHERE h.epoch <= coalesce(r.s, r.l) GROUP BY h.run_id
""")
def q_early_stopping(spark, sf):
    return H.early_stopping(history(spark, sf))


def logits(spark, sf):
    """Four logits per vector: logit c is the sum of all values at positions i with i % 4 = c."""
    e = load(spark, sf, "embeddings").withColumn("v", F.col("embedding").cast("array<double>"))
    total = lambda c: F.aggregate(F.filter("v", lambda x, i: i % 4 == c), F.lit(0.0), lambda a, x: a + x)
    return e.select("vec_id", F.array(*[total(c) for c in range(4)]).alias("logits"),
                    (F.col("label") % 4).cast("int").alias("true_label"))


_SUMS = ", ".join(f"list_sum(list_filter(CAST(embedding AS DOUBLE[]), lambda x, i: (i - 1) % 4 = {c}))" for c in range(4))
LOGITS = f"SELECT vec_id, [{_SUMS}] AS logits, CAST(label % 4 AS INTEGER) AS true_label FROM embeddings"
PROBS = (f"SELECT vec_id, true_label, logits, list_transform(ex, lambda x: x / list_sum(ex)) AS p FROM ("
         f"SELECT *, list_transform(logits, lambda x: exp(x - list_max(logits))) AS ex FROM ({LOGITS}) l) s")


@register("softmax", f"SELECT vec_id, {', '.join(f'round(p[{i + 1}], 6) AS p{i}' for i in range(4))} FROM ({PROBS}) s")
def q_softmax(spark, sf):
    p = logits(spark, sf).select("vec_id", V.softmax("logits").alias("p"))
    return p.select("vec_id", *[F.round(F.col("p")[i], 6).alias(f"p{i}") for i in range(4)])


@register("argmax", f"SELECT vec_id, CAST(list_position(logits, list_max(logits)) - 1 AS INTEGER) AS predicted_label FROM ({LOGITS}) l")
def q_argmax(spark, sf):
    return logits(spark, sf).select("vec_id", V.argmax("logits").alias("predicted_label"))


@register("confidence", f"""
SELECT vec_id, CAST(list_position(logits, list_max(logits)) - 1 AS INTEGER) AS predicted_label, round(list_max(p), 6) AS confidence,
  round(p[list_position(logits, list_max(logits))], 6) AS prob_predicted FROM ({PROBS}) s
""")
def q_confidence(spark, sf):
    d = logits(spark, sf).select("vec_id", V.softmax("logits").alias("p"), V.argmax("logits").alias("predicted_label"))
    return d.select("vec_id", "predicted_label", F.round(F.array_max("p"), 6).alias("confidence"),
                    F.round(V.prob_at("p", F.col("predicted_label")), 6).alias("prob_predicted"))


@register("spread_probs", f"""
SELECT vec_id, true_label, CAST(list_position(logits, list_max(logits)) - 1 AS INTEGER) AS predicted_label,
  CAST(list_position(logits, list_max(logits)) - 1 = true_label AS INTEGER) AS correct,
  {', '.join(f'round(p[{i + 1}], 6) AS prob_class_{i}' for i in range(4))} FROM ({PROBS}) s
""")
def q_spread_probs(spark, sf):
    d = logits(spark, sf).select("vec_id", "true_label", V.softmax("logits").alias("p"),
                                 V.argmax("logits").alias("predicted_label"))
    d = M.flag_correct(d)
    probs = [F.round(F.col(f"prob_class_{i}"), 6).alias(f"prob_class_{i}") for i in range(4)]
    return d.select("vec_id", "true_label", "predicted_label", "correct", *V.spread_probs("p")) \
        .select("vec_id", "true_label", "predicted_label", "correct", *probs)


# one row in 97 has logits so far apart that the true class's probability is 0 in floating point
FAR = 4000


@register("log_loss", f"""
WITH z AS (SELECT vec_id, true_label, list_transform(logits, lambda x: x * CASE WHEN vec_id % 97 = 0 THEN {FAR} ELSE 1 END) AS z FROM ({LOGITS}) l),
s AS (SELECT vec_id, true_label, list_max(z) + ln(list_sum(list_transform(z, lambda x: exp(x - list_max(z))))) - z[true_label + 1] AS nll,
  row_number() OVER (ORDER BY vec_id) - 1 AS rn FROM z),
w AS (SELECT true_label, CAST(sum(n) OVER () AS DOUBLE) / (CAST(n AS DOUBLE) * count(*) OVER ()) AS weight
      FROM (SELECT true_label, count(*) AS n FROM s GROUP BY 1) c),
b AS (SELECT floor(rn / {K.CLASSIFIER_BATCH}) AS batch_id, sum(w.weight * s.nll) / sum(w.weight) AS bl, sum(s.nll) AS sn, count(*) AS bn
      FROM s JOIN w ON s.true_label = w.true_label GROUP BY 1)
SELECT CAST(sum(bn) AS BIGINT) AS n_rows, count(*) AS n_batches, round(avg(bl), 6) AS weighted_batch_loss,
  round(sum(sn) / sum(bn), 6) AS mean_loss FROM b
""")
def q_log_loss(spark, sf):
    from tagwright.operators.score import log_loss
    far = F.when(F.col("vec_id") % 97 == 0, float(FAR)).otherwise(1.0)
    d = logits(spark, sf).withColumn("logits", F.transform("logits", lambda x: x * far))
    d = P.assign_batches(P.assign_row_id(d, ["vec_id"]), K.CLASSIFIER_BATCH)
    w = B.class_weights(d, "true_label")
    return rounded(log_loss(B.attach_class_weight(d, w, "true_label")), "weighted_batch_loss", "mean_loss")


@register("attach_predictions", f"""
SELECT s.custom_id, s.class AS true_label, p.predicted_label, p.confidence FROM ({SPLIT}) s
JOIN ({SCORED}) p ON s.custom_id = p.custom_id WHERE s.split = 'test'
""")
def q_attach_predictions(spark, sf):
    test = split_df(spark, sf).where(F.col("split") == "test").select("custom_id", F.col("class").alias("true_label"))
    return test.join(scored(spark, sf).select("custom_id", "predicted_label", "confidence"), "custom_id")


@register("class_spine", f"""
SELECT s.class AS true_label, CAST(coalesce(c.n, 0) AS BIGINT) AS n_errors
FROM (SELECT CAST(range AS INTEGER) AS class FROM range({K.NUM_CLASSES + 1})) s LEFT JOIN (
  SELECT true_label, count(*) AS n FROM ({SCORED}) x WHERE true_label <> predicted_label GROUP BY 1) c ON s.class = c.true_label
""")
def q_class_spine(spark, sf):
    """Errors of each class over all rows, on a spine of the known classes and one id that no row has."""
    errors = (scored(spark, sf).where(F.col("true_label") != F.col("predicted_label"))
              .groupBy("true_label").agg(F.count(F.lit(1)).alias("n")))
    spine = M.class_spine(spark, K.NUM_CLASSES + 1, "true_label")
    return spine.join(errors, "true_label", "left").select("true_label", F.coalesce("n", F.lit(0)).cast("bigint").alias("n_errors"))
