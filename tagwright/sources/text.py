"""Whole-text files (prompt templates) and metric report lines."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from tagwright import constants as K
from tagwright.functions.text import strip_ws
from tagwright.session import ensure_checkpoint_dir


def read_prompt_template(spark: SparkSession, path: str, strip: bool = False) -> DataFrame:
    """One row per file with its whole text (S4); the request builder strips it, chat prompts do not."""
    t = spark.read.text(path, wholetext=True).select(F.col("value").alias("template"))
    return t.select(strip_ws("template").alias("template")) if strip else t


def template_text(spark: SparkSession, path: str, strip: bool = True) -> str:
    """The prompt template as one string (a single small file; stripped as the request builder does)."""
    row = read_prompt_template(spark, path, strip).first()
    if row is None:
        raise ValueError(f"empty template: {path}")
    return row.template


def percent_format(c, decimals: int = 2) -> Column:
    """Share in percent as text, e.g. ``42.33%``."""
    return F.concat(_num(c, decimals), F.lit("%"))


def _num(c, digits: int = 4) -> Column:
    """A number as text, rounded half up first so that the text doesn't depend on a formatter's rounding."""
    return F.format_string(f"%.{digits}f", F.round(c, digits))


def report_text(report: DataFrame) -> DataFrame:
    """``(section, k, value)`` lines of a classification report: accuracy, weighted metrics, classes, averages."""
    from tagwright.operators.metrics import label_name

    kind = F.col("row_kind")
    prf = F.concat(F.lit("Precision="), _num("precision"), F.lit(", Recall="), _num("recall"), F.lit(", F1="), _num("f1"))
    support = F.concat(F.lit(", Support="), F.col("support").cast("string"))
    line = lambda cond, section, value: F.when(cond, F.array(F.struct(F.lit(section).alias("section"), value.alias("value"))))
    lines = line(kind == "accuracy", 2, F.concat(F.lit("Accuracy: "), _num("f1")))
    lines = F.coalesce(
        lines, line(kind == "class", 10, F.concat(F.coalesce(label_name("label"), F.lit("no label")), F.lit(": "), prf, support)),
        line(kind == "macro avg", 11, F.concat(F.lit("Macro avg: "), prf, support)),
        F.array(F.struct(F.lit(3).alias("section"), F.concat(F.lit("Weighted: "), prf).alias("value")),
                F.struct(F.lit(12).alias("section"), F.concat(F.lit("Weighted avg: "), prf, support).alias("value"))))
    return report.select(F.coalesce(F.col("label"), F.lit(-2)).cast("bigint").alias("k"), F.explode(lines).alias("l")).select(
        F.col("l.section").alias("section"), "k", F.col("l.value").alias("value"))


def metrics_summary_lines(scored: DataFrame, true: str = "true_label", pred: str = "predicted_label") -> DataFrame:
    """The evaluation summary as text lines (S8): totals, valid share, accuracy, weighted metrics, per-class report, averages,
    confusion rows, accuracy inside each class, total errors and transitions.

    ``section`` and ``k`` order the lines. The scored rows are aggregated once into confusion counts (checkpointed, at most
    one row per pair of labels); every line derives from them.
    """
    from tagwright.operators import metrics as M

    ensure_checkpoint_dir(scored.sparkSession)
    counts = M.confusion(scored, true, pred).checkpoint()
    valid = counts.where(F.col(M.P) != K.UNLABELED)
    text = lambda d, section, k, value: d.select(F.lit(section).alias("section"), k.cast("bigint").alias("k"), value.alias("value"))
    name = lambda c: F.coalesce(M.label_name(c), F.lit("no label"))
    n, ok = F.coalesce(F.sum("n"), F.lit(0)), F.coalesce(F.sum(F.when(F.col(M.P) != K.UNLABELED, F.col("n"))), F.lit(0))
    totals = counts.agg(n.alias("n"), ok.alias("valid"))
    share = F.concat(F.lit("Valid predictions: "), F.col("valid").cast("string"), F.lit(" ("),
                     percent_format(M.safe_ratio(F.col("valid") * 100, F.col("n"))), F.lit(")"))
    per = M.per_class(valid)
    label = F.coalesce(F.col("label"), F.lit(-2))
    inside = F.concat(name("label"), F.lit(" accuracy: "), _num(M.safe_ratio(F.col("tp"), F.col("support"))), F.lit(" ("),
                      F.col("tp").cast("string"), F.lit("/"), F.col("support").cast("string"), F.lit(")"))
    cells = F.concat_ws(" ", *[F.col(f"pred_{j}").cast("string") for j in range(K.NUM_CLASSES)], F.col("pred_other").cast("string"))
    errors = valid.agg(F.coalesce(F.sum(F.when(F.col(M.T) != F.col(M.P), F.col("n"))), F.lit(0)).alias("e"), n.alias("n"))
    wrong = M.transitions_of(valid)
    parts = [
        text(totals, 0, F.lit(0), F.concat(F.lit("Total samples: "), F.col("n").cast("string"))),
        text(totals, 1, F.lit(0), share),
        report_text(M.report_of(valid)),
        text(M.pivot_of(valid), 20, F.coalesce(F.col(M.T), F.lit(-2)), F.concat(name(M.T), F.lit(": ["), cells, F.lit("]"))),
        text(per, 30, label, inside),
        text(errors, 40, F.lit(0), F.concat(F.lit("Total errors: "), F.col("e").cast("string"), F.lit(" ("),
                                            percent_format(M.safe_ratio(F.col("e") * 100, F.col("n"))), F.lit(")"))),
        # most frequent first, then by label
        text(wrong, 50, F.row_number().over(Window.orderBy(F.col("n").desc(), *[F.coalesce(c, F.lit(-2)) for c in (M.T, M.P)])),
             F.concat("transition", F.lit(": "), F.col("n").cast("string"), F.lit(" ("), percent_format("pct_of_errors"), F.lit(")")))]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def improvement_text(improvement: DataFrame) -> DataFrame:
    """``(section, k, value)`` lines ``metric: old -> new (points, relative)`` of an improvement table."""
    relative = F.when(F.col("relative_pct").isNull(), F.lit("n/a")).otherwise(percent_format("relative_pct"))
    value = F.concat(F.col("metric"), F.lit(": "), _num("baseline"), F.lit(" -> "), _num("tuned"), F.lit(" ("),
                     _num("absolute_points", 2), F.lit(" points, "), relative, F.lit(")"))
    return improvement.select(F.lit(60).alias("section"), F.xxhash64("metric").alias("k"), value.alias("value"))


def comparison_text(original: DataFrame, finetuned: DataFrame, improvement: DataFrame, changes: DataFrame,
                    throughputs: dict[str, DataFrame]) -> DataFrame:
    """The comparison summary (S8): both models' reports, the improvement, the changed predictions, the speeds."""
    spark = original.sparkSession
    head = spark.createDataFrame([(0, 0, "Original model"), (100, 0, "Finetuned model"), (200, 0, "Improvement"), (300, 0, "Changes")],
                                 "section int, k bigint, value string")
    shift = lambda d, by: d.withColumn("section", F.col("section") + by)
    moved = changes.select(F.lit(301).alias("section"), F.col("improvement").cast("bigint").alias("k"), F.concat(
        F.col("change"), F.lit(": "), F.col("n").cast("string"), F.lit(" ("), percent_format("pct"), F.lit(")")).alias("value"))
    out = head.unionByName(report_text(original)).unionByName(shift(report_text(finetuned), 100))
    out = out.unionByName(shift(improvement_text(improvement), 200)).unionByName(moved)
    for i, (model, t) in enumerate(throughputs.items()):
        speed = F.concat(F.lit(f"{model}: "), F.col("rows").cast("string"), F.lit(" rows, "), _num("rows_per_second", 2), F.lit(" rows per second"))
        out = out.unionByName(t.select(F.lit(400).alias("section"), F.lit(i).cast("bigint").alias("k"), speed.alias("value")))
    return out


def write_metrics_report(lines: DataFrame, path: str, mode: str = "overwrite") -> None:
    """Text report, one line per row."""
    lines.select("value").write.mode(mode).text(path)


def accuracy_from_report(value: Column) -> Column:
    """``Accuracy: x.xxxx`` re-read from a report line (S9); 1.0000 included."""
    return F.regexp_extract(value, r"Accuracy: ([01]\.\d+)", 1)


def read_metrics_back(spark: SparkSession, path: str) -> DataFrame:
    lines = spark.read.text(path)
    acc = accuracy_from_report(F.col("value"))
    return lines.where(acc != "").select(acc.cast("double").alias("accuracy"))
