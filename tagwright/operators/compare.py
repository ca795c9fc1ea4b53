"""Model-against-model comparison tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from tagwright import constants as K
from tagwright.operators import metrics as M

T = "true_label"


def flag_improvement(orig, tuned, true) -> "F.Column":
    """1 tuned right & original wrong; -1 tuned wrong & original right; 0 otherwise."""
    o_ok, t_ok = orig == true, tuned == true
    return (F.when(orig.isNull() | tuned.isNull(), F.lit(None))
            .when(t_ok & ~o_ok, F.lit(1)).when(~t_ok & o_ok, F.lit(-1)).otherwise(F.lit(0))).cast("int")


def compare_models(rows: DataFrame, original: DataFrame, finetuned: DataFrame, key: str = "custom_id",
                   pred: str = "predicted_label") -> DataFrame:
    """Rows with both models' predictions side by side.

    The two prediction tables are full-outer joined on the key, so a model
    that produced nothing for a row (or failed entirely) leaves its columns
    null while the other side is still reported.
    """
    o = original.select(key, F.col(pred).cast("int").alias("original_prediction"))
    f = finetuned.select(key, F.col(pred).cast("int").alias("finetuned_prediction"))
    both = o.join(f, key, "full_outer")
    d = rows.select(key, "message", F.col(T).cast("int").alias(T)).join(both, key, "inner")
    op, fp, t = F.col("original_prediction"), F.col("finetuned_prediction"), F.col(T)
    return d.select(
        key, "message", T, M.label_name(T).alias("true_class"),
        "original_prediction", M.label_name("original_prediction").alias("original_class"),
        "finetuned_prediction", M.label_name("finetuned_prediction").alias("finetuned_class"),
        F.when(op.isNotNull(), (op == t).cast("int")).alias("original_correct"),
        F.when(fp.isNotNull(), (fp == t).cast("int")).alias("finetuned_correct"),
        flag_improvement(op, fp, t).alias("improvement"))


def single_model_results(rows: DataFrame, predictions: DataFrame, key: str = "custom_id",
                         pred: str = "predicted_label") -> DataFrame:
    """``message, true_label, predicted_label, correct`` for the one model that produced output."""
    d = rows.select(key, "message", F.col(T).cast("int").alias(T)).join(
        predictions.select(key, F.col(pred).cast("int").alias("predicted_label")), key)
    return d.withColumn("correct", (F.col("predicted_label") == F.col(T)).cast("int"))


def compare_or_single(rows: DataFrame, original: DataFrame | None, finetuned: DataFrame | None,
                      key: str = "custom_id", pred: str = "predicted_label") -> tuple[str, DataFrame] | None:
    """Both models -> ("comparison", compare_models); one -> ("original"|"finetuned", single_model_results)."""
    if original is not None and finetuned is not None:
        return "comparison", compare_models(rows, original, finetuned, key, pred)
    if original is not None:
        return "original", single_model_results(rows, original, key, pred)
    if finetuned is not None:
        return "finetuned", single_model_results(rows, finetuned, key, pred)
    return None


def prediction_changes(comparison: DataFrame) -> DataFrame:
    """Improved / worsened / unchanged counts and percent of all rows (A13), on a 3-row spine."""
    spark = comparison.sparkSession
    counts = comparison.groupBy("improvement").agg(F.count(F.lit(1)).alias("n"))
    # percent of all compared rows, rows lacking one model's prediction included
    counts = counts.withColumn("_total", F.sum("n").over(Window.partitionBy()))  # <= 4 rows
    spine = spark.range(-1, 2).select(F.col("id").cast("int").alias("improvement"),
                                      F.element_at(F.array(F.lit("worsened"), F.lit("unchanged"), F.lit("improved")),
                                                   (F.col("id") + 2).cast("int")).alias("change"))
    j = spine.join(F.broadcast(counts), "improvement", "left").withColumn("n", F.coalesce("n", F.lit(0)).cast("bigint"))
    total = F.max("_total").over(Window.partitionBy())  # three rows
    return j.select("improvement", "change", "n", M.safe_ratio(F.col("n") * 100, total).alias("pct"))


def join_class_reports(orig_report: DataFrame, tuned_report: DataFrame) -> DataFrame:
    """Per-class precision of both models and the difference."""
    o = orig_report.where(F.col("row_kind") == "class").select("label", F.col("precision").alias("original_precision"))
    t = tuned_report.where(F.col("row_kind") == "class").select("label", F.col("precision").alias("finetuned_precision"))
    return (o.join(t, "label", "full_outer")
            .select("label", M.label_name("label").alias("class_name"), "original_precision", "finetuned_precision",
                    (F.col("finetuned_precision") - F.col("original_precision")).alias("difference")))


def confusion_diff(orig_conf: DataFrame, tuned_conf: DataFrame) -> DataFrame:
    """Cell-by-cell confusion(tuned) - confusion(original)."""
    keys = [T, "predicted_label"]
    o = orig_conf.select(*keys, F.col("n").alias("original_n"))
    t = tuned_conf.select(*keys, F.col("n").alias("finetuned_n"))
    j = o.join(t, keys, "full_outer")
    on, tn = F.coalesce("original_n", F.lit(0)), F.coalesce("finetuned_n", F.lit(0))
    return j.select(*keys, on.cast("bigint").alias("original_n"), tn.cast("bigint").alias("finetuned_n"),
                    (tn - on).cast("bigint").alias("diff"))


def improvement_vs_baseline(baseline: DataFrame, tuned: DataFrame) -> DataFrame:
    """Metric tables ``(metric, value)`` of two runs joined on the metric name.

    Absolute change in points ((new - old) * 100) and relative change in
    percent of the old value; a zero baseline gives null, not an error.
    """
    b = baseline.select("metric", F.col("value").alias("baseline"))
    t = tuned.select("metric", F.col("value").alias("tuned"))
    j = b.join(t, "metric", "full_outer")
    diff = F.col("tuned") - F.col("baseline")
    return j.select("metric", "baseline", "tuned", (diff * 100).alias("absolute_points"),
                    (F.try_divide(diff, F.col("baseline")) * 100).alias("relative_pct"))


def report_metrics(report: DataFrame) -> DataFrame:
    """Long report -> ``(metric, value)``: accuracy, macro and weighted precision/recall/F1 (one pass)."""
    kind = F.col("row_kind")
    tag = F.when(kind == "macro avg", F.lit("macro")).otherwise(F.lit("weighted"))
    entry = lambda name, v: F.struct(name.alias("metric"), F.col(v).alias("value"))
    entries = F.when(kind == "accuracy", F.array(entry(F.lit("accuracy"), "f1"))).otherwise(F.array(
        *[entry(F.concat(tag, F.lit(f"_{m}")), m) for m in ("precision", "recall", "f1")]))
    return (report.where(kind.isin("accuracy", "macro avg", "weighted avg"))
            .select(F.explode(entries).alias("e")).select("e.metric", "e.value"))


def model_stage_pivot(long_df: DataFrame, stages=("before", "after")) -> DataFrame:
    """``(model, stage, accuracy)`` -> one row per model, a column per stage, and the uplift."""
    wide = long_df.groupBy("model").pivot("stage", list(stages)).agg(F.first("accuracy"))
    return wide.withColumn("uplift", F.col(stages[-1]) - F.col(stages[0]))


def stage_uplift(df: DataFrame, model: str, true: str, stages: dict[str, str]) -> DataFrame:
    """As ``model_stage_pivot`` from one row per example with a prediction column per stage: one conditional aggregate.

    Accuracy of a stage is over its valid predictions.
    """
    aggs = []
    for stage, pred in stages.items():
        valid = F.col(pred) != K.UNLABELED
        aggs.append(M.safe_ratio(F.count_if(valid & (F.col(pred) == F.col(true))), F.count_if(valid)).alias(stage))
    names = list(stages)
    return df.groupBy(model).agg(*aggs).withColumn("uplift", F.col(names[-1]) - F.col(names[0]))
