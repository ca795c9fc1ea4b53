"""Registered queries: comment preparation, requests, text functions."""

from __future__ import annotations

from pyspark.sql import functions as F

from tagwright import constants as K
from tagwright.functions import labels as FL, text as FT
from tagwright.operators import prepare as P
from tagwright.plans import fixtures as fx, oracle as O
from tagwright.plans.registry import register


@register("extract_message", f"SELECT custom_id, message, class FROM ({O.UNLABELED}) u")
def q_extract_message(spark, sf):
    return P.unlabeled_from_requests(P.build_request(fx.comments(spark, sf)))


@register("compose_message", f"""
SELECT custom_id, ({O.lit(K.DEFAULT_TEMPLATE)} || username || '+' || comment) AS user_message FROM ({O.COMMENTS}) c
""")
def q_compose_message(spark, sf):
    c = fx.comments(spark, sf)
    return c.select("custom_id", FT.compose_message(K.DEFAULT_TEMPLATE, "username", "comment").alias("user_message"))


@register("build_request", f"""
SELECT custom_id, {O.lit(K.REQUEST_METHOD)} AS method, {O.lit(K.REQUEST_URL)} AS url, {O.lit(K.REQUEST_MODEL)} AS model,
  CAST(2 AS INTEGER) AS n_messages, 'system' AS role_0, {O.lit(K.REQUEST_SYSTEM)} AS content_0, 'user' AS role_1,
  ({O.lit(K.DEFAULT_TEMPLATE)} || username || '+' || comment) AS content_1, true AS stream,
  CAST({K.REQUEST_MAX_TOKENS} AS INTEGER) AS max_tokens FROM ({O.COMMENTS}) c
""")
def q_build_request(spark, sf):
    r = P.build_request(fx.comments(spark, sf))
    m = F.col("body.messages")
    return r.select("custom_id", "method", "url", F.col("body.model").alias("model"),
                    F.size(m).cast("int").alias("n_messages"),
                    F.get(m, 0)["role"].alias("role_0"), F.get(m, 0)["content"].alias("content_0"),
                    F.get(m, 1)["role"].alias("role_1"), F.get(m, 1)["content"].alias("content_1"),
                    F.col("body.stream").alias("stream"), F.col("body.max_tokens").alias("max_tokens"))


@register("project_by_position", "SELECT doc_id AS username, lang AS comment FROM documents")
def q_project_by_position(spark, sf):
    from tagwright.sources.tables import load
    return P.project_by_position(load(spark, sf, "documents"))


@register("init_class", "SELECT source AS username, text AS comment, CAST(-1 AS INTEGER) AS class FROM documents")
def q_init_class(spark, sf):
    from tagwright.sources.tables import load
    d = load(spark, sf, "documents").select(F.col("source").alias("username"), F.col("text").alias("comment"))
    return P.init_class(d)


@register("select_features_target", f"SELECT custom_id, message, class FROM ({O.GOLD}) g")
def q_select_features_target(spark, sf):
    return P.select_features_target(fx.gold(spark, sf))


@register("assign_row_id", f"""
SELECT 'row-' || CAST(row_number() OVER (ORDER BY doc_id) - 1 AS VARCHAR) AS custom_id, doc_id,
       row_number() OVER (ORDER BY doc_id) - 1 AS row_idx FROM documents
""")
def q_assign_row_id(spark, sf):
    from tagwright.sources.tables import load
    d = P.assign_row_id(load(spark, sf, "documents").select("doc_id"), ["doc_id"])
    return d.select(P.custom_id_from_index().alias("custom_id"), "doc_id", "row_idx")


@register("assign_batches", f"""
SELECT doc_id, row_number() OVER (ORDER BY doc_id) - 1 AS row_idx,
       CAST(floor((row_number() OVER (ORDER BY doc_id) - 1) / {K.LLM_BATCH}) AS BIGINT) AS batch_id FROM documents
""")
def q_assign_batches(spark, sf):
    from tagwright.sources.tables import load
    d = P.assign_row_id(load(spark, sf, "documents").select("doc_id"), ["doc_id"])
    return P.assign_batches(d, K.LLM_BATCH)


@register("clean_text", f"""
SELECT line_no, {O.strip('content')} AS stripped, lower({O.strip('content')}) AS cleaned FROM ({O.PARSED}) p
""")
def q_clean_text(spark, sf):
    from tagwright.operators.labels import parse_responses
    p = parse_responses(fx.responses(spark, sf))
    return p.select("line_no", FT.strip_ws("content").alias("stripped"), FT.clean_text("content").alias("cleaned"))


@register("parse_label_lenient", f"""
SELECT line_no, content, {O.lenient('content')} AS predicted_label FROM ({O.PARSED}) p
""")
def q_parse_label_lenient(spark, sf):
    from tagwright.operators.labels import parse_responses
    p = parse_responses(fx.responses(spark, sf))
    return p.select("line_no", "content", FL.parse_label_lenient("content").alias("predicted_label"))


@register("prompt_infer", f"SELECT custom_id, {O.prompt_infer('message')} AS prompt FROM ({O.GOLD}) g")
def q_prompt_infer(spark, sf):
    return fx.gold(spark, sf).select("custom_id", FT.prompt_infer("message").alias("prompt"))


@register("prompt_train", f"""
SELECT custom_id, {O.prompt_train('message', 'class')} AS prompt FROM ({O.GOLD}) g WHERE class <> -1
""")
def q_prompt_train(spark, sf):
    g = fx.gold(spark, sf).where(F.col("class") != K.UNLABELED)
    return g.select("custom_id", FT.prompt_train("message", "class").alias("prompt"))
