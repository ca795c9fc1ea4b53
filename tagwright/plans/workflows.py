"""End-to-end workflows: the operators chained the way the labelling and evaluation steps use them.

Each step takes and leaves files. Between steps rows travel as parquet; CSV, JSONL and text are written
at the edge, for people and other tools.
"""

from __future__ import annotations

from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame, SparkSession, functions as F

from tagwright import constants as K, schemas
from tagwright.functions.labels import parse_label_lenient
from tagwright.functions.text import prompt_infer
from tagwright.operators import compare as C, labels as L, metrics as M, prepare as P, score as SC, split as SP, train as TR
from tagwright.sources import csv as CSV, jsonl as J, text as TX


def _p(base: str, name: str) -> str:
    return f"{base.rstrip('/')}/{name}"


def _stored(df: DataFrame, path: str) -> DataFrame:
    """The rows as they are in a parquet folder: written once, whatever is derived from them later."""
    df.write.mode("overwrite").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def write_label_requests(comments: DataFrame, out_path: str, template: str = K.DEFAULT_TEMPLATE,
                         order_cols=None, template_path: str | None = None) -> DataFrame:
    """Comments ``(username, comment[, custom_id])`` -> one JSON request per line.

    Without a custom_id rows are numbered: in file order for comments from ``csv.read_comments`` (which brings each row's
    place), else by ``order_cols`` (default: name and comment). Rows whose name or comment is null get no request;
    they are stored in ``<out_path>_quarantine`` with their number. ``template_path`` reads the template from a text file
    (whole file, stripped).
    """
    if template_path:
        template = TX.template_text(comments.sparkSession, template_path)
    if order_cols is None and set(CSV.PLACE) <= set(comments.columns):
        order_cols = CSV.PLACE
    elif "custom_id" not in comments.columns:  # a row number at the end: equal comments don't share one range
        comments = comments.withColumn(CSV.PLACE[-1], F.monotonically_increasing_id())
        order_cols = (*(order_cols or ("username", "comment")), CSV.PLACE[-1])
    c = P.ensure_custom_id(comments, list(order_cols or ())).drop(*CSV.PLACE)
    req = P.build_request(c, template)
    J.write_requests_jsonl(req, out_path)
    P.without_request(c).write.mode("overwrite").parquet(f"{out_path.rstrip('/')}_quarantine")
    return req


def build_labeled_dataset(spark: SparkSession, requests_path: str, responses_path: str, out_dir: str,
                          marker: str = K.PROMPT_MARKER) -> dict[str, DataFrame]:
    """Requests + labeller answers -> unlabeled / labeled / purged CSV, quarantine and counts.

    The message is recovered from the request text; the last valid answer per
    id wins; unknown ids are dropped; rows still at -1 are purged. Answers are parsed once and stored.
    """
    req = spark.read.schema(schemas.REQUEST).option("mode", "FAILFAST").json(requests_path)
    unlabeled = _stored(P.unlabeled_from_requests(req, marker).select("custom_id", "message", "class"), _p(out_dir, "_unlabeled"))
    parsed = _stored(L.parse_responses(J.read_response_lines(spark, responses_path), order_col="line_key"), _p(out_dir, "_answers"))
    labeled = _stored(L.merge_labels(unlabeled, L.last_valid_per_key(parsed)).select("custom_id", "message", "class"),
                      _p(out_dir, "_labeled"))
    purged = L.purge_unlabeled(labeled)
    CSV.write_csv_quote_all(unlabeled, _p(out_dir, "unlabeled"))
    CSV.write_csv_quote_all(labeled, _p(out_dir, "labeled"))
    CSV.write_csv_quote_all(purged, _p(out_dir, "purged_labeled"))
    errors = _stored(L.response_errors(parsed.withColumn("line_no", F.lit(None).cast("bigint")), unlabeled),
                     _p(out_dir, "response_errors"))
    counts = labeled.agg(F.count(F.lit(1)).alias("total"), F.count_if(F.col("class") != K.UNLABELED).alias("kept"),
                         *[F.count_if(F.col("class") == c).alias(f"class_{c}") for c in range(K.NUM_CLASSES)])
    return {"labeled": labeled, "purged": purged, "errors": errors, "counts": counts}


def split_dataset(spark: SparkSession, labeled: DataFrame, out_dir: str, seed=K.SPLIT_SEED) -> dict[str, DataFrame]:
    """Purged labelled rows -> train / validation / test CSV (70/10/20, stratified, exact sizes); rows without a class go
    to quarantine."""
    s = SP.stratified_split(labeled.select("custom_id", "message", "class"), seed=seed)
    s.write.mode("overwrite").partitionBy("split").parquet(_p(out_dir, "_split"))
    s = spark.read.parquet(_p(out_dir, "_split"))
    out = {}
    for name in ("train", "validation", "test", "quarantine"):
        out[name] = s.where(F.col("split") == name).select("custom_id", "message", "class")
        CSV.write_csv_minimal(out[name], _p(out_dir, name))
    out["distribution"] = SP.split_distribution(s)
    return out


def evaluate_predictions(results: DataFrame, out_dir: str, valid_only: bool = True) -> dict[str, DataFrame]:
    """Results ``(custom_id, message, true_label, predicted_label[, confidence])`` -> evaluation tables and files.

    The results are stored once; every table and file derives from the stored rows.
    """
    results = _stored(results, _p(out_dir, "_results"))
    valid = M.valid_predictions(results) if valid_only else results
    named = M.with_label_names(M.flag_correct(results))
    tables = {
        "results": named,
        "report": M.classification_report(valid),
        "confusion": M.confusion_matrix(valid),
        "class_accuracy": M.class_accuracy(valid),
        "error_by_class": M.error_by_class(valid),
        "transitions": M.error_transitions(valid),
        "valid_rate": M.valid_rate(results),
    }
    if "confidence" in results.columns:
        tables["high_confidence_mistakes"] = M.high_confidence_mistakes(valid)
    CSV.write_csv_minimal(named, _p(out_dir, "evaluation_results"))
    for k in ("report", "confusion", "class_accuracy", "error_by_class", "transitions"):
        tables[k] = _stored(tables[k], _p(out_dir, k))
    if "high_confidence_mistakes" in tables:
        CSV.write_csv_minimal(tables["high_confidence_mistakes"], _p(out_dir, "high_confidence_mistakes"))
    TX.write_metrics_report(TX.metrics_summary_lines(results).orderBy("section", "k"), _p(out_dir, "metrics_summary"))
    return tables


def run_model_evaluation(test: DataFrame, scorer: SC.Scorer, out_dir: str,
                         system_message: str = K.DEFAULT_SYSTEM_MESSAGE, batch_size: int = K.LLM_BATCH,
                         on_error: str = "batch") -> dict[str, DataFrame]:
    """Test rows ``(custom_id, message, class)`` -> prompts -> batched scorer -> lenient parse -> evaluation.

    The scorer sees every row once (a failed task is run again): its outputs are stored in ``<out_dir>/_scored`` and all
    tables, files and the throughput derive from there.
    """
    t = test.select("custom_id", "message", F.col("class").cast("int").alias("true_label"))
    out = SC.batch_score_ordered(t, scorer, ["custom_id"], batch_size=batch_size, on_error=on_error,
                                 text=prompt_infer("message", system_message))
    scored = _stored(out, _p(out_dir, "_scored"))
    results = scored.withColumn("predicted_label", parse_label_lenient("model_output"))
    tables = evaluate_predictions(results.select("custom_id", "message", "true_label", "predicted_label",
                                                 "model_output"), out_dir)
    tables["throughput"] = SC.throughput(scored)
    return tables


def train_and_evaluate(train: DataFrame, validation: DataFrame, test: DataFrame, out_dir: str, **params) -> dict:
    """Fit the candidates, keep the best on validation, save it, score the test rows and evaluate them.

    Leaves ``best_model`` (reload with ``PipelineModel.load``), ``candidates``, ``detailed_test_predictions`` and
    ``prediction_errors`` (CSV) and the evaluation files. Returns the tables and the reloaded model.
    """
    best = TR.select_best_model(train, validation, **params)
    best.model.write().overwrite().save(_p(out_dir, "best_model"))
    model = PipelineModel.load(_p(out_dir, "best_model"))
    tables = {"candidates": _stored(best.table, _p(out_dir, "candidates"))}
    scored = _stored(TR.score_classifier(model, test).join(test.select("custom_id", "message"), "custom_id"), _p(out_dir, "_predictions"))
    detailed = M.with_label_names(M.flag_correct(scored))
    CSV.write_csv_minimal(detailed, _p(out_dir, "detailed_test_predictions"))
    CSV.write_csv_minimal(detailed.where(F.col("correct") == 0), _p(out_dir, "prediction_errors"))
    tables |= evaluate_predictions(scored, out_dir, valid_only=False)
    return tables | {"model": model}


def improvement_over_stored(results: DataFrame, baseline_report: str, out_dir: str) -> DataFrame:
    """Accuracy of a run against the accuracy that an earlier run's text report states (S9, J8); stored in ``out_dir``."""
    spark = results.sparkSession
    stored = TX.read_metrics_back(spark, baseline_report).select(F.lit("accuracy").alias("metric"), F.col("accuracy").alias("value"))
    now = M.accuracy(M.valid_predictions(results)).select(F.lit("accuracy").alias("metric"), F.col("accuracy").alias("value"))
    table = _stored(C.improvement_vs_baseline(stored, now), _p(out_dir, "improvement_over_baseline"))
    TX.write_metrics_report(TX.improvement_text(table).orderBy("section", "k"), _p(out_dir, "improvement_summary"))
    return table


def compare_two_models(test: DataFrame, original: DataFrame | None, finetuned: DataFrame | None,
                       out_dir: str, throughputs: dict[str, DataFrame] | None = None) -> dict[str, DataFrame]:
    """Two prediction tables ``(custom_id, predicted_label)`` on the same test rows -> comparison tables and summary.

    With one table missing, the other's results and metrics. ``throughputs`` (``original`` / ``finetuned`` ->
    ``score.throughput``) adds the speeds to the summary.
    """
    rows = test.select("custom_id", "message", F.col("class").cast("int").alias("true_label"))
    res = C.compare_or_single(rows, original, finetuned)
    if res is None:
        return {}
    kind, table = res
    name = "model_comparison" if kind == "comparison" else f"{kind}_model_results"
    table = _stored(table, _p(out_dir, f"_{name}"))
    CSV.write_csv_minimal(table, _p(out_dir, name))
    out = {kind: table}
    if kind != "comparison":
        out["report"] = M.classification_report(M.valid_predictions(table))
        TX.write_metrics_report(TX.metrics_summary_lines(table).orderBy("section", "k"), _p(out_dir, "metrics_summary"))
        return out
    # both models in one pass: a row per model and example, one report grouped by model
    pair = F.array(F.struct(F.lit("original").alias("model"), F.col("original_prediction").alias("predicted_label")),
                   F.struct(F.lit("finetuned").alias("model"), F.col("finetuned_prediction").alias("predicted_label")))
    each = table.select("true_label", F.explode(pair).alias("p")).select("true_label", "p.*").where("predicted_label is not null")
    report = _stored(M.classification_report(each, by=["model"]), _p(out_dir, "class_reports"))
    conf = M.confusion(each, by=["model"])
    o, f = (report.where(F.col("model") == m).drop("model") for m in ("original", "finetuned"))
    co, cf = (M.matrix_of(conf.where(F.col("model") == m).drop("model")) for m in ("original", "finetuned"))
    out.update({
        "changes": _stored(C.prediction_changes(table), _p(out_dir, "changes")),
        "class_performance": _stored(C.join_class_reports(o, f), _p(out_dir, "class_performance")),
        "confusion_diff": _stored(C.confusion_diff(co, cf), _p(out_dir, "confusion_diff")),
        "improvement": _stored(C.improvement_vs_baseline(C.report_metrics(o), C.report_metrics(f)), _p(out_dir, "improvement")),
    })
    lines = TX.comparison_text(o, f, out["improvement"], out["changes"], throughputs or {})
    TX.write_metrics_report(lines.orderBy("section", "k"), _p(out_dir, "comparison_summary"))
    return out
