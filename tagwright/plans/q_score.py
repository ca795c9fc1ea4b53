"""Registered queries: batch scoring with error isolation, throughput, sample prompt."""

from __future__ import annotations

from pyspark.sql import functions as F

from tagwright import constants as K
from tagwright.functions import labels as FL, text as FT
from tagwright.operators import score as SC
from tagwright.plans import fixtures as fx, oracle as O
from tagwright.plans.registry import register
from tagwright.session import scratch_path


def prompts(spark, sf):
    """custom_id, doc_id, true_label, prompt (chat prompt without answer)."""
    t = fx.truth(spark, sf)
    return t.select("custom_id", "doc_id", "true_label", FT.prompt_infer("message").alias("prompt"))


PROMPTS = f"SELECT custom_id, doc_id, true_label, {O.prompt_infer('message')} AS prompt FROM ({O.TRUTH}) t"
STUB = "'[' || CAST(length(prompt) % 4 AS VARCHAR) || ']'"


def scored_batches(spark, sf):
    t = fx.truth(spark, sf).select("custom_id", "doc_id", "true_label", "message")
    return SC.batch_score_ordered(t, SC.length_stub_scorer, ["doc_id"], batch_size=K.LLM_BATCH, text=FT.prompt_infer("message"))


BATCH_SCORE = f"""
WITH b AS (SELECT *, floor((row_number() OVER (ORDER BY doc_id) - 1) / {K.LLM_BATCH}) AS batch_id FROM ({PROMPTS}) p),
f AS (SELECT batch_id, bool_or(length(prompt) % 53 = 0) AS failed FROM b GROUP BY 1),
o AS (SELECT b.custom_id, CASE WHEN f.failed THEN '{K.ERROR_OUTPUT}' ELSE {STUB} END AS model_output FROM b JOIN f USING (batch_id))
SELECT custom_id, model_output, {O.lenient('model_output')} AS predicted_label FROM o
"""


@register("batch_score", BATCH_SCORE)
def q_batch_score(spark, sf):
    s = scored_batches(spark, sf)
    return s.select("custom_id", "model_output", FL.parse_label_lenient("model_output").alias("predicted_label"))


@register("batch_score_resumable", f"""
WITH o AS ({BATCH_SCORE}), b AS (SELECT custom_id, CAST(floor((row_number() OVER (ORDER BY doc_id) - 1) / {K.LLM_BATCH}) AS BIGINT) AS batch_id FROM ({PROMPTS}) p),
e AS (SELECT batch_id, bool_or(model_output = '{K.ERROR_OUTPUT}') AS failed FROM o JOIN b USING (custom_id) GROUP BY 1)
SELECT custom_id, batch_id, CAST(CASE WHEN failed THEN 1 ELSE 0 END AS INTEGER) AS attempt, model_output FROM o JOIN b USING (custom_id) JOIN e USING (batch_id)
""")
def q_batch_score_resumable(spark, sf):
    """A run in waves with one retry of failed batches (the stub fails again)."""
    t = fx.truth(spark, sf).select("custom_id", "doc_id", "message")
    s = SC.score_resumable(t, SC.length_stub_scorer, scratch_path(spark, "scoring"), ["doc_id"], batch_size=K.LLM_BATCH, retries=1, text=FT.prompt_infer("message"))
    return s.select("custom_id", "batch_id", "attempt", "model_output")


@register("batch_score_row_isolation", f"""
SELECT custom_id, CASE WHEN length(prompt) % 53 = 0 THEN '{K.ERROR_OUTPUT}' ELSE {STUB} END AS model_output FROM ({PROMPTS}) p
""")
def q_batch_score_row(spark, sf):
    s = SC.batch_score(prompts(spark, sf), SC.length_stub_scorer, on_error="row")
    return s.select("custom_id", "model_output")


@register("throughput", f"SELECT count(*) AS rows, CAST(ceil(count(*) / {K.LLM_BATCH}) AS BIGINT) AS batches, true AS timed FROM documents")
def q_throughput(spark, sf):
    t = SC.throughput(scored_batches(spark, sf))
    return t.select("rows", "batches", ((F.col("seconds") > 0) & (F.col("rows_per_second") > 0)).alias("timed"))


@register("sample_prompt", f"SELECT custom_id, prompt FROM ({PROMPTS}) p ORDER BY doc_id LIMIT 1")
def q_sample_prompt(spark, sf):
    return prompts(spark, sf).orderBy("doc_id").limit(1).select("custom_id", "prompt")
