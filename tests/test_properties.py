"""Properties: split is an exact stratified partition independent of partitioning, metric identities,
dense ids across partitions, encode length, round trips, batch isolation."""

import pytest
from pyspark.sql import functions as F

from tagwright import constants as K, schemas
from tagwright.functions import encode as E
from tagwright.operators import balance as B, compare as C, metrics as M, prepare as P, score as SC, split as SP
from tagwright.plans import fixtures as fx
from tagwright.session import scratch_path
from tagwright.sources import csv as CSV, jsonl as J, text as TX

from conftest import SF01


def _lineitem_classes(spark, n_parts):
    li = spark.read.parquet(f"{SF01}/lineitem.parquet")
    cls = F.when(F.col("l_returnflag") == "A", 0).when(F.col("l_returnflag") == "N", 1).otherwise(2)
    key = F.concat_ws("-", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_shipdate")
    return li.select(key.alias("custom_id"), cls.cast("int").alias("class")).distinct().repartition(n_parts)


def test_split_exact_and_partition_independent(spark):
    a = SP.stratified_split(_lineitem_classes(spark, 1)).select("custom_id", "split")
    b = SP.stratified_split(_lineitem_classes(spark, 7)).select("custom_id", "split")
    assert a.exceptAll(b).count() == 0 and b.exceptAll(a).count() == 0
    q = {r["class"]: r for r in SP.split_quotas(_lineitem_classes(spark, 3)).collect()}
    got = {(r["class"], r.split): r["count"] for r in
           SP.stratified_split(_lineitem_classes(spark, 3)).groupBy("class", "split").count().collect()}
    for c, r in q.items():
        assert got.get((c, "test"), 0) == r.n_test
        assert got.get((c, "validation"), 0) == r.n_validation
        assert got.get((c, "train"), 0) == r.n_train
    n = sum(r.n for r in q.values())
    import math
    n_test = math.ceil(0.2 * n)
    assert sum(r.n_test for r in q.values()) == n_test
    assert sum(r.n_validation for r in q.values()) == math.ceil(0.125 * (n - n_test))


def test_published_split_sizes(spark):
    # 74,243 rows -> 51,969 / 7,425 / 14,849 (published file sizes minus headers)
    df = spark.range(74243).select(F.col("id").cast("string").alias("custom_id"), (F.col("id") % 4).cast("int").alias("class"))
    q = SP.split_quotas(df).agg(F.sum("n_train").alias("tr"), F.sum("n_validation").alias("va"), F.sum("n_test").alias("te")).first()
    assert (q.tr, q.va, q.te) == (51969, 7425, 14849)


def test_metric_identities(spark):
    p = fx.preds(spark, SF01).select("custom_id", "true_label", F.col("tuned_pred").alias("predicted_label"))
    rep = {(r.row_kind, r.label): r for r in M.classification_report(p).collect()}
    acc = M.accuracy(p).first().accuracy
    assert abs(rep[("accuracy", None)].f1 - round(acc, 6)) < 1e-9
    assert abs(rep[("weighted avg", None)].recall - round(acc, 6)) < 1e-6  # weighted recall = accuracy
    cm = M.confusion_matrix(p)
    seen = p.select("true_label", "predicted_label").distinct()
    outside = seen.where("true_label > 3 or predicted_label > 3").count()
    assert cm.agg(F.sum("n")).first()[0] == p.count() and cm.count() == 16 + outside > 16


def test_improved_minus_worsened(spark):
    t = fx.truth(spark, SF01)
    pr = fx.preds(spark, SF01)
    base = pr.select("custom_id", F.col("base_pred").alias("predicted_label"))
    tuned = pr.select("custom_id", F.col("tuned_pred").alias("predicted_label"))
    cmp = C.compare_models(t, base, tuned)
    ch = {r.improvement: r.n for r in C.prediction_changes(cmp).collect()}
    d = cmp.agg(F.sum("finetuned_correct").alias("f"), F.sum("original_correct").alias("o")).first()
    assert ch[1] - ch[-1] == d.f - d.o


def test_dense_row_id_many_partitions(spark):
    df = spark.range(0, 5000, 1, 13).select((F.col("id") * 7 % 5000).alias("k")).repartition(5)
    ids = P.assign_row_id(df, ["k"])
    bad = ids.where(F.col("row_idx") != F.col("k")).count()
    assert bad == 0 and ids.count() == 5000


def test_encode_length(spark):
    docs = spark.createDataFrame([("a", "héllo wörld"), ("b", ""), ("c", "x" * 500)], "custom_id string, message string")
    vocab = E.vocabulary_dict(E.char_vocabulary(docs))
    enc = docs.select("custom_id", E.encode_fixed_length(E.token_ids("message", vocab), 16).alias("e")).collect()
    by = {r.custom_id: r.e for r in enc}
    for e in by.values():
        assert len(e.input_ids) == 16 and len(e.attention_mask) == 16 and len(e.token_type_ids) == 16
    assert by["b"].input_ids[:3] == [K.START_ID, K.END_ID, K.PAD_ID] and sum(by["b"].attention_mask) == 2
    assert sum(by["c"].attention_mask) == 16


def test_csv_round_trip_quotes_newlines_spaces(spark):
    rows = [("row-1", ' lead and trail ', 0), ("row-2", 'has "quotes", commas\nand newline', 3), ("row-3", "中文，全角", -1)]
    df = spark.createDataFrame(rows, schemas.LABELED)
    for writer in (CSV.write_csv_quote_all, CSV.write_csv_minimal):
        path = scratch_path(spark, "t-csv")
        writer(df, path)
        back = CSV.read_csv_table(spark, path, schemas.LABELED)
        assert sorted(back.collect()) == sorted(df.collect())


def test_jsonl_round_trip_non_ascii(spark):
    c = spark.createDataFrame([("row-0", "用户", "评论，带逗号")], "custom_id string, username string, comment string")
    path = scratch_path(spark, "t-jsonl")
    J.write_requests_jsonl(P.build_request(c), path)
    raw = spark.read.text(path).first().value
    assert "评论" in raw  # non-ASCII kept raw
    r = J.read_requests_jsonl(spark, path).first()
    assert r.full_content == K.DEFAULT_TEMPLATE + "用户+评论，带逗号"
    un = P.unlabeled_from_requests(P.build_request(c)).first()
    assert un.message == "用户+评论，带逗号" and un["class"] == -1


def test_responses_file_line_order(spark):
    path = scratch_path(spark, "t-resp")
    lines = ['{"custom_id": "a", "response": {"body": {"choices": [{"message": {"content": "[1]"}}]}}}', "{bad",
             '{"custom_id": "a", "response": {"body": {"choices": [{"message": {"content": "[2]"}}]}}}']
    spark.createDataFrame([(x,) for x in lines], "value string").coalesce(1).write.mode("overwrite").text(path)
    r = J.read_responses_jsonl(spark, path)
    assert r.where("corrupt = 1").count() == 1
    last = r.where("corrupt = 0").orderBy(F.desc("line_key")).first()
    assert last.content == "[2]"


def test_prompt_template_reader(spark):
    path = scratch_path(spark, "t-tpl")
    spark.createDataFrame([("  Label this.\n" + K.PROMPT_MARKER + "\n",)], "value string").coalesce(1).write.text(path)
    t = TX.read_prompt_template(spark, path, strip=True).first().template
    assert t == ("  Label this.\n" + K.PROMPT_MARKER + "\n").strip()
    raw = TX.read_prompt_template(spark, path).first().template
    assert raw == "  Label this.\n" + K.PROMPT_MARKER + "\n\n"  # not stripped: chat prompts keep it as is
    from tagwright.plans import workflows as W
    c = spark.createDataFrame([("u", "hello")], "username string, comment string")
    req = W.write_label_requests(c, scratch_path(spark, "t-req"), template_path=path)
    assert req.select(F.get("body.messages", 1)["content"].alias("m")).first().m == t + "u+hello"


def test_batch_isolation(spark):
    texts = [("r%d" % i, "x" * (53 if i == 5 else i + 1), i) for i in range(12)]
    df = spark.createDataFrame(texts, "custom_id string, prompt string, row_idx bigint")
    df = P.assign_batches(df, 4)
    out = {r.custom_id: r.model_output for r in SC.batch_score(df, SC.length_stub_scorer, batch_col="batch_id").collect()}
    assert [out["r%d" % i] for i in range(4, 8)] == [K.ERROR_OUTPUT] * 4  # whole batch 1 failed
    assert out["r0"] == "[1]" and out["r8"] == f"[{9 % 4}]"
    rowwise = {r.custom_id: r.model_output for r in SC.batch_score(df, SC.length_stub_scorer, on_error="row").collect()}
    assert rowwise["r5"] == K.ERROR_OUTPUT and rowwise["r4"] == "[1]"


def test_balanced_resample_exact_n(spark):
    df = spark.range(1000).select(F.col("id").cast("string").alias("custom_id"),
                                  F.when(F.col("id") < 10, 0).when(F.col("id") < 900, 1).otherwise(2).alias("class"))
    r = B.balanced_resample(df)
    assert r.agg(F.sum("draws")).first()[0] == 1000
    per = {x["class"]: x["s"] for x in r.groupBy("class").agg(F.sum("draws").alias("s")).collect()}
    assert all(250 < v < 420 for v in per.values())  # class-uniform
    assert B.explode_draws(r).count() == 1000


@pytest.mark.parametrize("parts", [1, 7])
def test_merge_independent_of_partitions(spark, parts):
    from tagwright.operators import labels as L
    from tagwright.plans import q_labels as QL
    raw = fx.responses(spark, SF01).repartition(parts)
    got = L.merge_labels(QL.unlabeled(spark, SF01).repartition(parts), L.last_valid_per_key(L.parse_responses(raw)))
    ref = QL.merged(spark, SF01)
    assert got.exceptAll(ref).count() == 0 and ref.exceptAll(got).count() == 0


def test_batch_score_independent_of_partitions(spark):
    t = fx.truth(spark, SF01).select("custom_id", "doc_id", F.col("message").alias("prompt"))
    outs = []
    for parts in (1, 7):
        p = P.assign_batches(P.assign_row_id(t.repartition(parts), ["doc_id"]), K.LLM_BATCH)
        outs.append(SC.batch_score(p, SC.length_stub_scorer, batch_col="batch_id").select("custom_id", "model_output"))
    assert outs[0].exceptAll(outs[1]).count() == 0 and outs[0].count() == t.count()
    assert outs[0].where(F.col("model_output") == K.ERROR_OUTPUT).count() % K.LLM_BATCH == 0


def test_ensure_custom_id(spark):
    df = spark.createDataFrame([("b", 2), ("a", 1), ("c", 3)], "comment string, k int")
    got = {r.comment: r.custom_id for r in P.ensure_custom_id(df, ["k"]).collect()}
    assert got == {"a": "row-0", "b": "row-1", "c": "row-2"}
    keep = spark.createDataFrame([("x", "id-9")], "comment string, custom_id string")
    assert P.ensure_custom_id(keep, ["comment"]).first().custom_id == "id-9"


def test_published_valid_rate(spark):
    # 6,285 valid predictions of 14,849 test rows -> 42.33 %
    df = spark.range(14849).select((F.when(F.col("id") < 6285, 1).otherwise(-1)).alias("predicted_label"))
    r = M.valid_rate(df).select("valid", TX.percent_format(F.col("valid_pct")).alias("p")).first()
    assert r.valid == 6285 and r.p == "42.33%"


def test_grouped_report_equals_per_group(spark):
    p = fx.preds(spark, SF01).join(spark.read.parquet(f"{SF01}/documents.parquet").select("doc_id", "lang"), "doc_id") \
        .select("lang", "true_label", F.col("tuned_pred").alias("predicted_label"))
    grouped = M.classification_report(p, by=["lang"])
    for lang in [r.lang for r in p.select("lang").distinct().collect()]:
        digits = {c: F.round(c, 9) for c in ("precision", "recall", "f1")}   # sums in another order
        one = M.classification_report(p.where(F.col("lang") == lang)).withColumns(digits)
        g = grouped.where(F.col("lang") == lang).drop("lang").withColumns(digits)
        assert g.exceptAll(one).count() == 0 and one.exceptAll(g).count() == 0


@pytest.mark.parametrize("parts", [1, 3, 7])
def test_batch_score_ordered_equals_shuffled(spark, parts):
    t = fx.truth(spark, SF01).select("custom_id", "doc_id", F.col("message").alias("prompt")).repartition(parts)
    ref = SC.batch_score(P.assign_batches(P.assign_row_id(t, ["doc_id"]), K.LLM_BATCH), SC.length_stub_scorer,
                         batch_col="batch_id").select("custom_id", "model_output").collect()
    old = spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")  # keep 8 range partitions: boundaries
    try:
        s = t.orderBy("doc_id").checkpoint()
        sizes = [r.n for r in s.groupBy(F.spark_partition_id().alias("p")).agg(F.count(F.lit(1)).alias("n"))
                 .orderBy("p").collect()]
        offs = [sum(sizes[:i]) for i in range(len(sizes))]
        assert parts == 1 or any(o % K.LLM_BATCH for o in offs)  # batches straddle partitions: boundary path runs
        got = SC.batch_score_ordered(t, SC.length_stub_scorer, ["doc_id"]).select("custom_id", "model_output").collect()
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", old)
    assert len(got) == t.count()
    assert sorted(got) == sorted(ref)



def test_report_all_predictions_invalid(spark):
    # every prediction is -1: no valid rows, the report is all zeros instead of failing
    df = spark.createDataFrame([(0, -1), (1, -1), (3, -1)], "true_label int, predicted_label int")
    v = M.valid_predictions(df)
    rep = {(r.row_kind, r.label): r for r in M.classification_report(v).collect()}
    assert rep[("accuracy", None)].f1 == 0.0 and rep[("weighted avg", None)].f1 == 0.0
    assert all(rep[("class", c)].support == 0 for c in range(4))
    assert M.valid_rate(df).first().valid == 0
    assert M.weighted_prf(v).first().f1 == 0.0
