"""Command line: python -m tagwright <step> ...

  requests  <comments.csv|.xlsx> <out.jsonl-dir>         comments (username, comment[, custom_id]; workbook: first and third column) -> requests
  labels    <requests-dir> <responses-path> <out-dir>    answers -> unlabeled / labeled / purged CSV
  split     <labeled-csv-dir> <out-dir>                  purged labels -> train / validation / test CSV
  train     <split-dir> <out-dir>                        train / validation / test CSV -> best model, predictions, reports
  evaluate  <results-csv-dir> <out-dir>                  custom_id,message,true_label,predicted_label[,confidence]
"""

from __future__ import annotations

import sys

from pyspark.sql import types as T

from tagwright import schemas
from tagwright.plans import workflows as W
from tagwright.session import get_spark, release_scratch
from tagwright.sources import csv as CSV, workbook as WB


def main(argv: list[str]) -> int:
    if not argv or argv[0] not in {"requests", "labels", "split", "train", "evaluate"}:
        print(__doc__)
        return 2
    spark = get_spark(app=f"tagwright-{argv[0]}")
    cmd, args = argv[0], argv[1:]
    if cmd == "requests":
        source = WB if args[0].lower().endswith(".xlsx") else CSV
        W.write_label_requests(source.read_comments(spark, args[0]), args[1])
    elif cmd == "labels":
        out = W.build_labeled_dataset(spark, args[0], args[1], args[2])
        out["counts"].show(truncate=False)
    elif cmd == "split":
        out = W.split_dataset(spark, CSV.read_csv_table(spark, args[0], schemas.LABELED), args[1])
        out["distribution"].orderBy("split", "class").show(truncate=False)
    elif cmd == "train":
        parts = [CSV.read_csv_table(spark, f"{args[0].rstrip('/')}/{name}", schemas.LABELED) for name in ("train", "validation", "test")]
        out = W.train_and_evaluate(*parts, args[1])
        out["candidates"].show(truncate=False)
        out["report"].show(truncate=False)
    elif cmd == "evaluate":
        schema = T.StructType([T.StructField("custom_id", T.StringType()), T.StructField("message", T.StringType()),
                               T.StructField("true_label", T.IntegerType()),
                               T.StructField("predicted_label", T.IntegerType()),
                               T.StructField("confidence", T.DoubleType())])
        out = W.evaluate_predictions(CSV.read_csv_table(spark, args[0], schema), args[1])
        out["report"].show(truncate=False)
    release_scratch(spark)
    return 0


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))
