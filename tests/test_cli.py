"""The command line, in process (get_spark returns the active test session)."""

from pyspark.sql import functions as F

from tagwright.__main__ import main
from tagwright.plans import fixtures as fx

from conftest import SF001


def test_cli_steps(spark, tmp_path):
    base = str(tmp_path)
    fx.comments(spark, SF001).select("custom_id", "username", "comment").write.option("header", True) \
        .option("escape", '"').option("quoteAll", True).csv(f"{base}/comments")
    fx.responses(spark, SF001).orderBy("line_no").select(F.col("raw").alias("value")).write.text(f"{base}/responses")
    assert main(["requests", f"{base}/comments", f"{base}/requests"]) == 0
    assert main(["labels", f"{base}/requests", f"{base}/responses", f"{base}/data"]) == 0
    assert main(["split", f"{base}/data/purged_labeled", f"{base}/split"]) == 0
    assert main(["train", f"{base}/split", f"{base}/model"]) == 0
    assert spark.read.parquet(f"{base}/model/candidates").where("chosen = 1").count() == 1
    p = fx.preds(spark, SF001).select("custom_id", "message", "true_label", F.col("tuned_pred").alias("predicted_label"),
                                      "confidence")
    p.write.option("header", True).option("escape", '"').option("multiLine", True).csv(f"{base}/results")
    assert main(["evaluate", f"{base}/results", f"{base}/eval"]) == 0
    assert spark.read.text(f"{base}/eval/metrics_summary").count() > 5
    assert main([]) == 2
