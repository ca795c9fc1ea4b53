"""End to end on sf0.001: requests -> (answers) -> labeled dataset -> split -> scored evaluation -> comparison."""

from pyspark.sql import functions as F

import __spark_entry__ as E
from tagwright import constants as K
from tagwright.operators import score as SC
from tagwright.plans import fixtures as fx, workflows as W
from tagwright.session import scratch_path

from conftest import SF001


def test_end_to_end(spark):
    base = scratch_path(spark, "t-e2e")
    comments = fx.comments(spark, SF001).select("custom_id", "username", "comment")
    W.write_label_requests(comments, f"{base}/requests")
    fx.responses(spark, SF001).orderBy("line_no").select(F.col("raw").alias("value")).write.text(f"{base}/responses")
    ds = W.build_labeled_dataset(spark, f"{base}/requests", f"{base}/responses", f"{base}/data")
    expected = {r["class"]: r.n for r in E.entry(spark).collect()}
    c = ds["counts"].first()
    assert {k: c[f"class_{k}"] for k in range(4)} == expected
    assert c.total == comments.count()
    sp = W.split_dataset(spark, ds["purged"], f"{base}/split")
    n = ds["purged"].count()
    assert sp["train"].count() + sp["validation"].count() + sp["test"].count() == n
    ev = W.run_model_evaluation(sp["test"], SC.length_stub_scorer, f"{base}/eval")
    assert ev["report"].where("row_kind = 'class'").count() == K.NUM_CLASSES + 1  # an answer [7] is a class of its own
    assert ev["results"].count() == sp["test"].count()
    lines = spark.read.text(f"{base}/eval/metrics_summary").collect()
    assert any(r.value.startswith("Total samples:") for r in lines)
    p = fx.preds(spark, SF001)
    cmp = W.compare_two_models(sp["test"], p.select("custom_id", F.col("base_pred").alias("predicted_label")),
                               p.select("custom_id", F.col("tuned_pred").alias("predicted_label")), f"{base}/cmp")
    assert set(cmp) >= {"comparison", "changes", "class_performance", "confusion_diff", "improvement"}
    one = W.compare_two_models(sp["test"], None, p.select("custom_id", F.col("tuned_pred").alias("predicted_label")),
                               f"{base}/cmp1")
    assert list(one) == ["finetuned", "report"]


def test_scorer_sees_every_row_once(spark, tmp_path):
    """40 rows in batches of 8: five calls; the stored results, the report and the throughput agree for a random scorer."""
    calls = spark.sparkContext.accumulator(0)
    rows = spark.createDataFrame([(f"row-{i:02d}", f"text {i}", i % 4) for i in range(40)], "custom_id string, message string, class int")

    def scorer(texts):
        import random
        calls.add(len(texts))
        return [f"[{random.randrange(4)}]" for _ in texts]

    out = W.run_model_evaluation(rows, scorer, str(tmp_path), batch_size=8)
    accuracy = [r.f1 for r in out["report"].where("row_kind = 'accuracy'").collect()][0]
    results = spark.read.option("header", True).csv(str(tmp_path / "evaluation_results"))
    assert abs(results.selectExpr("avg(double(correct)) AS a").first().a - accuracy) < 1e-9
    line = [r.value for r in spark.read.text(str(tmp_path / "metrics_summary")).collect() if r.value.startswith("Accuracy")][0]
    assert line == f"Accuracy: {accuracy:.4f}"
    t = out["throughput"].first()
    assert (t["rows"], t["batches"]) == (40, 5) and calls.value == 40


def test_none_outputs_stay_null(spark):
    rows = spark.createDataFrame([("a", "x"), ("b", "fail"), ("c", "none")], "custom_id string, prompt string").coalesce(1)

    def scorer(texts):
        if "fail" in texts:
            raise RuntimeError("stub failure")
        return [None if t == "none" else t for t in texts]

    got = {r.custom_id: r.model_output for r in SC.batch_score(rows, scorer, on_error="row").collect()}
    assert got == {"a": "x", "b": K.ERROR_OUTPUT, "c": None}


def test_requests_follow_the_file_and_null_comments_are_set_aside(spark, tmp_path):
    from tagwright.sources import csv as CSV
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.csv").write_text('username,comment\nzed,"two\nlines"\namy,hi\nbob,\n,orphan\nzed,last\n')
    W.write_label_requests(CSV.read_comments(spark, str(tmp_path / "in")), str(tmp_path / "out"))
    req = spark.read.json(str(tmp_path / "out"))
    got = {r.custom_id: r.c for r in req.selectExpr("custom_id", "body.messages[1].content AS c").collect()}
    assert set(got) == {"row-0", "row-1", "row-4"} and got["row-1"].endswith("amy+hi") and all(got.values())
    aside = {r.custom_id: r.reason for r in spark.read.parquet(str(tmp_path / "out_quarantine")).collect()}
    assert aside == {"row-2": "null_comment", "row-3": "null_username"}


def test_training_leaves_a_model_that_beats_the_majority(spark, tmp_path):
    from pyspark.ml import PipelineModel
    good, bad = ["这个产品真的很好", "很好用非常喜欢", "质量很好值得买"], ["太差了不要买", "质量差退货了", "非常差很失望"]
    rows = [(f"{i}", (good if i % 2 else bad)[i % 3] + str(i % 7), i % 2) for i in range(240)]
    df = spark.createDataFrame(rows, "custom_id string, message string, class int")
    part = lambda k: df.where(F.col("custom_id").cast("int") % 10 == k)
    train = df.where(F.col("custom_id").cast("int") % 10 > 1)
    out = W.train_and_evaluate(train, part(0).unionByName(part(1)), part(0).unionByName(part(1)), str(tmp_path), reg_params=(0.5, 1.0))
    assert out["candidates"].where("chosen = 1").count() == 1
    accuracy = [r.f1 for r in out["report"].where("row_kind = 'accuracy'").collect()][0]
    assert accuracy > 0.9
    again = PipelineModel.load(str(tmp_path / "best_model"))
    from tagwright.operators import train as TR
    unseen = spark.createDataFrame([("u", "产品很好", 1), ("v", "很差", 0)], df.schema)   # no clause as a whole was seen
    assert {r.custom_id: r.predicted_label for r in TR.score_classifier(again, unseen).collect()} == {"u": 1, "v": 0}
    assert spark.read.option("header", True).csv(str(tmp_path / "detailed_test_predictions")).count() == 48


def test_stored_baseline_and_comparison_summary(spark, tmp_path):
    p = fx.preds(spark, SF001)
    rows = p.select("custom_id", "message", F.col("true_label").alias("class"))
    base, tuned = (p.select("custom_id", F.col(c).alias("predicted_label")) for c in ("base_pred", "tuned_pred"))
    res = p.select("custom_id", "message", "true_label", F.col("base_pred").alias("predicted_label"))
    W.evaluate_predictions(res, str(tmp_path / "base"))
    now = res.drop("predicted_label").join(tuned, "custom_id")
    t = W.improvement_over_stored(now, str(tmp_path / "base" / "metrics_summary"), str(tmp_path / "now")).first()
    assert t.tuned > t.baseline and abs((t.tuned - t.baseline) * 100 - t.absolute_points) < 1e-9
    W.compare_two_models(rows, base, tuned, str(tmp_path / "cmp"))
    text = [r.value for r in spark.read.text(str(tmp_path / "cmp" / "comparison_summary")).collect()]
    assert any(x.startswith("weighted_f1: ") for x in text) and sum(x.startswith("Accuracy: ") for x in text) == 2
    assert any(x.startswith("improved: ") for x in text)
    W.compare_two_models(rows, None, tuned, str(tmp_path / "one"))
    assert spark.read.text(str(tmp_path / "one" / "metrics_summary")).count() > 10


def test_null_class_goes_to_quarantine(spark):
    from tagwright.operators import split as SP
    df = spark.createDataFrame([(f"k{i}", None if i % 10 == 0 else i % 3) for i in range(1000)], "custom_id string, class int")
    s = SP.stratified_split(df)
    n = {r.split: r["count"] for r in s.groupBy("split").count().collect()}
    assert n["quarantine"] == 100 and sum(n.values()) == 1000 and n["test"] == 180
    i = SP.split_integrity(df, s).first()
    assert (i.n_input, i.n_split_rows, i.missing, i.duplicated, i.n_quarantine) == (1000, 1000, 0, 0, 100)
