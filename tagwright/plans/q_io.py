"""Registered queries: CSV / JSONL / text round trips through the shared checkpoint folder."""

from __future__ import annotations

from pyspark.sql import functions as F

from tagwright import constants as K, schemas
from tagwright.operators import metrics as M, prepare as P
from tagwright.plans import fixtures as fx, oracle as O
from tagwright.plans.q_labels import merged
from tagwright.plans.q_metrics import BASE, SCORED, VALID, base_scored, conf_sql, name_sql, per_class_sql, ratio, report_sql, scored
from tagwright.plans.q_split import LABELED, labeled
from tagwright.plans.registry import register
from tagwright.session import scratch_path
from tagwright.sources import csv as CSV, jsonl as J, text as TX


@register("read_csv_table", LABELED)
def q_read_csv_table(spark, sf):
    path = scratch_path(spark, "labeled-csv")
    CSV.write_csv_quote_all(labeled(spark, sf), path)
    return CSV.read_csv_table(spark, path, schemas.LABELED)


@register("write_csv_quote_all", O.MERGED)
def q_write_csv_quote_all(spark, sf):
    path = scratch_path(spark, "merged-csv")
    CSV.write_csv_quote_all(merged(spark, sf), path)
    return CSV.read_csv_table(spark, path, schemas.LABELED)


@register("write_csv_minimal", f"SELECT custom_id, true_label, predicted_label, confidence FROM ({SCORED}) s")
def q_write_csv_minimal(spark, sf):
    from pyspark.sql import types as T
    path = scratch_path(spark, "scored-csv")
    cols = ["custom_id", "true_label", "predicted_label", "confidence"]
    CSV.write_csv_minimal(scored(spark, sf).select(*cols), path)
    schema = T.StructType([T.StructField("custom_id", T.StringType()), T.StructField("true_label", T.IntegerType()),
                           T.StructField("predicted_label", T.IntegerType()), T.StructField("confidence", T.DoubleType())])
    return CSV.read_csv_table(spark, path, schema)


def _requests_path(spark, sf):
    path = scratch_path(spark, "requests-jsonl")
    J.write_requests_jsonl(P.build_request(fx.comments(spark, sf)), path)
    return path


_USER = f"({O.lit(K.DEFAULT_TEMPLATE)} || username || '+' || comment)"


@register("read_requests_jsonl", f"SELECT custom_id, {_USER} AS full_content FROM ({O.COMMENTS}) c")
def q_read_requests_jsonl(spark, sf):
    return J.read_requests_jsonl(spark, _requests_path(spark, sf))


@register("write_requests_jsonl", f"""
SELECT custom_id, {O.lit(K.REQUEST_METHOD)} AS method, {O.lit(K.REQUEST_URL)} AS url, {O.lit(K.REQUEST_MODEL)} AS model,
  {O.lit(K.REQUEST_SYSTEM)} AS system_content, {_USER} AS user_content, true AS stream, CAST({K.REQUEST_MAX_TOKENS} AS INTEGER) AS max_tokens
FROM ({O.COMMENTS}) c
""")
def q_write_requests_jsonl(spark, sf):
    r = spark.read.schema(schemas.REQUEST).option("mode", "FAILFAST").json(_requests_path(spark, sf))
    m = F.col("body.messages")
    return r.select("custom_id", "method", "url", F.col("body.model").alias("model"),
                    F.get(m, 0)["content"].alias("system_content"), F.get(m, 1)["content"].alias("user_content"),
                    F.col("body.stream").alias("stream"), F.col("body.max_tokens").alias("max_tokens"))


@register("read_responses_jsonl", f"SELECT custom_id, content, CAST(NOT ok AS INTEGER) AS corrupt FROM ({O.PARSED}) p")
def q_read_responses_jsonl(spark, sf):
    path = scratch_path(spark, "responses-jsonl")
    fx.responses(spark, sf).orderBy("line_no").select(F.col("raw").alias("value")).write.mode("overwrite").text(path)
    return J.read_responses_jsonl(spark, path).select("custom_id", "content", "corrupt")


def _n(x: str, digits: int = 4) -> str:
    return f"printf('%.{digits}f', round({x}, {digits}))"


_PRF = f"'Precision=' || {_n('precision')} || ', Recall=' || {_n('recall')} || ', F1=' || {_n('f1')}"
_SUPPORT = "', Support=' || support"
_WIDE = " || ' ' || ".join(f"sum(CASE WHEN predicted_label = {j} THEN n ELSE 0 END)" for j in range(4))


@register("write_metrics_report", f"""
WITH r AS ({report_sql(VALID)}), c AS ({conf_sql(VALID)}), p AS ({per_class_sql(VALID)}),
w AS (SELECT *, sum(n) OVER () AS total FROM c WHERE true_label <> predicted_label AND n > 0)
SELECT 'Total samples: ' || count(*) AS value FROM ({BASE}) a
UNION ALL SELECT 'Valid predictions: ' || count(*) FILTER (WHERE predicted_label <> -1) || ' (' ||
  {_n(ratio('count(*) FILTER (WHERE predicted_label <> -1) * 100', 'count(*)'), 2)} || '%)' FROM ({BASE}) b
UNION ALL SELECT 'Accuracy: ' || {_n('f1')} FROM r WHERE row_kind = 'accuracy'
UNION ALL SELECT 'Weighted: ' || {_PRF} FROM r WHERE row_kind = 'weighted avg'
UNION ALL SELECT {name_sql('label')} || ': ' || {_PRF} || {_SUPPORT} FROM r WHERE row_kind = 'class'
UNION ALL SELECT 'Macro avg: ' || {_PRF} || {_SUPPORT} FROM r WHERE row_kind = 'macro avg'
UNION ALL SELECT 'Weighted avg: ' || {_PRF} || {_SUPPORT} FROM r WHERE row_kind = 'weighted avg'
UNION ALL SELECT {name_sql('true_label')} || ': [' || {_WIDE} || ' ' || sum(CASE WHEN predicted_label NOT BETWEEN 0 AND 3 THEN n ELSE 0 END) || ']'
  FROM c GROUP BY true_label
UNION ALL SELECT {name_sql('label')} || ' accuracy: ' || {_n(ratio('tp', 'support'))} || ' (' || tp || '/' || support || ')' FROM p
UNION ALL SELECT 'Total errors: ' || sum(CASE WHEN true_label <> predicted_label THEN n ELSE 0 END)::BIGINT || ' (' ||
  {_n(ratio('sum(CASE WHEN true_label <> predicted_label THEN n ELSE 0 END) * 100', 'sum(n)'), 2)} || '%)' FROM c
UNION ALL SELECT {name_sql('true_label')} || ' -> ' || {name_sql('predicted_label')} || ': ' || n || ' (' || {_n(ratio('n * 100', 'total'), 2)} || '%)' FROM w
""")
def q_write_metrics_report(spark, sf):
    path = scratch_path(spark, "report-txt")
    TX.write_metrics_report(TX.metrics_summary_lines(base_scored(spark, sf)).orderBy("section", "k"), path)
    return spark.read.text(path)


@register("read_metrics_back", f"""
SELECT CAST(printf('%.4f', round(f1, 4)) AS DOUBLE) AS accuracy FROM ({report_sql(SCORED)}) r WHERE row_kind = 'accuracy'
""")
def q_read_metrics_back(spark, sf):
    path = scratch_path(spark, "report-txt")
    TX.write_metrics_report(TX.report_text(M.classification_report(scored(spark, sf))), path)
    return TX.read_metrics_back(spark, path)


@register("percent_format", "SELECT lang, printf('%.2f', round(count(*) * 100.0::DOUBLE / sum(count(*)) OVER (), 2)) || '%' AS share FROM documents GROUP BY lang")
def q_percent_format(spark, sf):
    from tagwright.sources.tables import load
    d = M.class_distribution(load(spark, sf, "documents").select(F.col("lang").alias("class")), label_type="string")
    return d.select(F.col("class").alias("lang"), TX.percent_format("pct").alias("share"))


@register("read_workbook", "SELECT source AS username, text AS comment, CAST(-1 AS INTEGER) AS class FROM documents")
def q_read_workbook(spark, sf):
    """A spreadsheet of comments -> user name and comment by position, class -1: the labelling's first step."""
    from tagwright.sources import workbook as WB
    from tagwright.sources.tables import load
    path = scratch_path(spark, "workbooks")
    WB.workbooks_of(load(spark, sf, "documents").select("source", "lang", "text")).write.parquet(path)
    cells = WB.parse_workbooks(spark.read.parquet(path))
    named = cells.where(F.col("row") > 1).select(*[F.get("cells", F.lit(i)).alias(f"c{i}") for i in range(3)])
    return P.init_class(P.project_by_position(named))
