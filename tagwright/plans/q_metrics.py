"""Registered queries: evaluation tables over scored rows (E2/E3 metrics)."""

from __future__ import annotations

from pyspark.sql import functions as F

from tagwright import constants as K
from tagwright.operators import metrics as M
from tagwright.plans import fixtures as fx, oracle as O
from tagwright.plans.registry import register


def scored(spark, sf):
    """Tuned-model predictions: custom_id, message, true_label, predicted_label, confidence."""
    return fx.preds(spark, sf).select("custom_id", "message", "true_label",
                                      F.col("tuned_pred").alias("predicted_label"), "confidence")


def base_scored(spark, sf):
    """Base-model predictions, -1 where the output could not be parsed."""
    return fx.preds(spark, sf).select("custom_id", "message", "true_label",
                                      F.col("base_pred").alias("predicted_label"), "confidence")


SCORED = f"SELECT custom_id, message, true_label, tuned_pred AS predicted_label, confidence FROM ({O.PREDS}) p"
BASE = f"SELECT custom_id, message, true_label, base_pred AS predicted_label, confidence FROM ({O.PREDS}) p"
VALID = f"SELECT * FROM ({BASE}) b WHERE predicted_label <> -1"
NAMES = "[" + ", ".join(O.lit(n) for n in K.CLASS_NAMES) + "]"


def name_sql(x: str) -> str:
    return f"(CASE WHEN {x} BETWEEN 0 AND 3 THEN {NAMES}[{x} + 1] ELSE 'class ' || CAST({x} AS VARCHAR) END)"


def ratio(a: str, b: str) -> str:
    return f"coalesce(CAST({a} AS DOUBLE) / NULLIF(CAST({b} AS DOUBLE), 0), 0.0)"


CELLS = "SELECT CAST(range // 4 AS INTEGER) AS true_label, CAST(range % 4 AS INTEGER) AS predicted_label FROM range(16)"


def conf_sql(src: str) -> str:
    return (f"SELECT true_label, predicted_label, CAST(sum(n) AS BIGINT) AS n FROM (SELECT true_label, predicted_label, 0 AS n FROM ({CELLS}) c "
            f"UNION ALL SELECT true_label, predicted_label, count(*) FROM ({src}) s GROUP BY 1, 2) x GROUP BY 1, 2")


def per_class_sql(src: str) -> str:
    return (f"SELECT label, CAST(sum(tp) AS BIGINT) AS tp, CAST(sum(support) AS BIGINT) AS support, CAST(sum(predicted) AS BIGINT) AS predicted FROM ("
            f"SELECT CAST(range AS INTEGER) AS label, 0 AS tp, 0 AS support, 0 AS predicted FROM range(4) "
            f"UNION ALL SELECT true_label, count(*) FILTER (WHERE true_label = predicted_label), count(*), 0 FROM ({src}) a GROUP BY 1 "
            f"UNION ALL SELECT predicted_label, 0, 0, count(*) FROM ({src}) b GROUP BY 1) u GROUP BY label")


def prf_sql(src: str) -> str:
    return (f"SELECT *, {ratio('2 * precision * recall', 'precision + recall')} AS f1 FROM ("
            f"SELECT *, {ratio('tp', 'predicted')} AS precision, {ratio('tp', 'support')} AS recall FROM ({per_class_sql(src)}) q) r")


def report_sql(src: str) -> str:
    prf = prf_sql(src)
    return f"""
SELECT 'class' AS row_kind, label, precision, recall, f1, support FROM ({prf}) a
UNION ALL SELECT 'accuracy', NULL, NULL, NULL, {ratio('sum(tp)', 'sum(support)')}, CAST(sum(support) AS BIGINT) FROM ({prf}) b
UNION ALL SELECT 'macro avg', NULL, avg(precision), avg(recall), avg(f1), CAST(sum(support) AS BIGINT) FROM ({prf}) c
UNION ALL SELECT 'weighted avg', NULL, sum(precision * support) / sum(support), sum(recall * support) / sum(support),
  sum(f1 * support) / sum(support), CAST(sum(support) AS BIGINT) FROM ({prf}) d
"""


def rounded(df, *cols):
    return df.withColumns({c: F.round(c, 6) for c in cols})


@register("flag_correct", f"SELECT custom_id, true_label, predicted_label, CAST(predicted_label = true_label AS INTEGER) AS correct FROM ({SCORED}) s")
def q_flag_correct(spark, sf):
    return M.flag_correct(scored(spark, sf)).select("custom_id", "true_label", "predicted_label", "correct")


@register("error_rows", f"SELECT custom_id, true_label, predicted_label, confidence FROM ({SCORED}) s WHERE predicted_label <> true_label")
def q_error_rows(spark, sf):
    d = M.flag_correct(scored(spark, sf))
    return d.where(F.col("correct") == 0).select("custom_id", "true_label", "predicted_label", "confidence")


@register("label_names", f"""
SELECT custom_id, true_label, predicted_label, {name_sql('true_label')} AS true_label_name,
  {name_sql('predicted_label')} AS predicted_label_name FROM ({BASE}) s
""")
def q_label_names(spark, sf):
    return M.with_label_names(base_scored(spark, sf)).select(
        "custom_id", "true_label", "predicted_label", "true_label_name", "predicted_label_name")


@register("valid_predictions", f"SELECT custom_id, true_label, predicted_label FROM ({VALID}) v")
def q_valid_predictions(spark, sf):
    return M.valid_predictions(base_scored(spark, sf)).select("custom_id", "true_label", "predicted_label")


@register("accuracy", f"""
SELECT count(*) AS n, CAST(count(*) FILTER (WHERE true_label = predicted_label) AS BIGINT) AS correct,
  {ratio('count(*) FILTER (WHERE true_label = predicted_label)', 'count(*)')} AS accuracy FROM ({VALID}) v
""")
def q_accuracy(spark, sf):
    return M.accuracy(M.valid_predictions(base_scored(spark, sf)))


@register("weighted_prf", f"""
SELECT round({ratio('sum(tp)', 'sum(support)')}, 6) AS accuracy, round(sum(precision * support) / sum(support), 6) AS precision,
  round(sum(recall * support) / sum(support), 6) AS recall, round(sum(f1 * support) / sum(support), 6) AS f1 FROM ({prf_sql(SCORED)}) r
""")
def q_weighted_prf(spark, sf):
    return rounded(M.weighted_prf(scored(spark, sf)), "accuracy", "precision", "recall", "f1")


@register("classification_report", f"SELECT * REPLACE (round(precision, 6) AS precision, round(recall, 6) AS recall, round(f1, 6) AS f1) FROM ({report_sql(VALID)}) r")
def q_classification_report(spark, sf):
    return rounded(M.classification_report(M.valid_predictions(base_scored(spark, sf))), "precision", "recall", "f1")


@register("confusion_matrix", conf_sql(SCORED))
def q_confusion_matrix(spark, sf):
    return M.confusion_matrix(scored(spark, sf))


@register("confusion_matrix_pivot", f"""
SELECT true_label, {', '.join(f'CAST(coalesce(sum(n) FILTER (WHERE predicted_label = {j}), 0) AS BIGINT) AS pred_{j}' for j in range(4))},
  CAST(coalesce(sum(n) FILTER (WHERE predicted_label NOT BETWEEN 0 AND 3), 0) AS BIGINT) AS pred_other
FROM ({conf_sql(VALID)}) c GROUP BY true_label
""")
def q_confusion_pivot(spark, sf):
    return M.confusion_pivot(M.valid_predictions(base_scored(spark, sf)))


@register("class_accuracy", f"""
SELECT label AS true_label, support AS samples, tp AS correct, {ratio('tp', 'support')} AS accuracy FROM ({per_class_sql(SCORED)}) p
""")
def q_class_accuracy(spark, sf):
    return M.class_accuracy(scored(spark, sf))


@register("error_by_class", f"""
SELECT label AS true_label, support AS samples, support - tp AS errors, {ratio('support - tp', 'support')} AS error_rate
FROM ({per_class_sql(SCORED)}) p
""")
def q_error_by_class(spark, sf):
    return M.error_by_class(scored(spark, sf))


@register("error_transitions", f"""
SELECT true_label, predicted_label, {name_sql('true_label')} AS true_name, {name_sql('predicted_label')} AS predicted_name,
  {name_sql('true_label')} || ' -> ' || {name_sql('predicted_label')} AS transition, n,
  {ratio('n * 100', 'sum(n) OVER ()')} AS pct_of_errors
FROM (SELECT true_label, predicted_label, count(*) AS n FROM ({SCORED}) s WHERE true_label <> predicted_label GROUP BY 1, 2) w
""")
def q_error_transitions(spark, sf):
    return M.error_transitions(scored(spark, sf))


@register("error_summary", f"""
SELECT count(*) AS n, count(*) FILTER (WHERE true_label <> predicted_label) AS errors,
  {ratio('count(*) FILTER (WHERE true_label <> predicted_label) * 100', 'count(*)')} AS pct_of_set FROM ({SCORED}) s
""")
def q_error_summary(spark, sf):
    return M.error_summary(scored(spark, sf))


@register("valid_rate", f"""
SELECT count(*) AS n, count(*) FILTER (WHERE predicted_label <> -1) AS valid,
  {ratio('count(*) FILTER (WHERE predicted_label <> -1) * 100', 'count(*)')} AS valid_pct FROM ({BASE}) s
""")
def q_valid_rate(spark, sf):
    return M.valid_rate(base_scored(spark, sf))


@register("high_confidence_mistakes", f"""
SELECT custom_id, true_label, predicted_label, confidence FROM ({SCORED}) s WHERE true_label <> predicted_label
ORDER BY confidence DESC, custom_id LIMIT {K.TOP_MISTAKES}
""")
def q_high_confidence_mistakes(spark, sf):
    return M.high_confidence_mistakes(scored(spark, sf)).select("custom_id", "true_label", "predicted_label", "confidence")


@register("class_distribution", f"""
SELECT class, n, {ratio('n * 100', 'sum(n) OVER ()')} AS pct FROM (SELECT class, count(*) AS n FROM ({O.GOLD}) g GROUP BY 1) c
""")
def q_class_distribution(spark, sf):
    return M.class_distribution(fx.gold(spark, sf))
