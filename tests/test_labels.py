"""Answer parsing, last-valid merge, quarantine: malformed input and edge cases."""

from pyspark.sql import functions as F

from tagwright.operators import labels as L
from tagwright.plans.fixtures import response_json


def _raw(spark, rows):
    return spark.createDataFrame(rows, "line_no bigint, raw string")


def test_parse_edge_cases(spark):
    rows = [
        (1, '{"custom_id": "row-1", "response": {"body": {"choices": []}}}'),
        (2, '{"custom_id": "row-2", "response": null}'),
        (3, "{bad"),
        (4, '{"custom_id": "row-4", "response": {"body": {"choices": [{"message": {"content": "[2]"}}]}}}'),
        (5, '{"custom_id": "row-5", "response": {"body": {"choices": [{"message": {"content": "two"}}]}}}'),
    ]
    p = {r.line_no: r for r in L.parse_responses(_raw(spark, rows)).collect()}
    assert p[1].reason == "missing_content" and p[1].custom_id == "row-1"
    assert p[2].reason == "missing_content"
    assert p[3].reason == "bad_json" and p[3].custom_id is None
    assert p[4].reason is None and p[4]["class"] == 2
    assert p[5].reason == "bad_format"


def test_corrupt_lines_are_never_labels(spark):
    good = '{"custom_id": "a", "response": {"body": {"choices": [{"message": {"content": "[1]"}}]}}}'
    cases = {good: None, good + " ok": "bad_json", good + good: "bad_json", good + "," + good: "bad_json", good.replace('"', "'"): "bad_json",
             "": "bad_json", "  ": "bad_json", "[]": "bad_json", "1": "bad_json", "[" + good + "]": "bad_json", "null": "bad_json",
             good.replace('"[1]"', "1"): "not_text", good.replace('"[1]"', "null"): "missing_content", good.replace('"[1]"', '["[1]"]'): "not_text",
             good.replace('[1]"', '[99999999999]"'): "out_of_range", good.replace('"custom_id": "a", ', ""): "missing_id",
             " " + good + " ": None}
    rows = list(enumerate(cases))
    got = {r.line_no: r for r in L.parse_responses(_raw(spark, rows)).collect()}
    for i, line in rows:
        assert got[i].reason == cases[line], (line, got[i])
        assert (got[i]["class"] == 1) == (cases[line] in (None, "missing_id")), line
    kept = L.last_valid_per_key(L.parse_responses(_raw(spark, rows))).collect()
    assert [(r.custom_id, r["class"]) for r in kept] == [("a", 1)]


def test_last_valid_wins_and_invalid_does_not_erase(spark):
    def line(n, cid, content):
        return (n, f'{{"custom_id": "{cid}", "response": {{"body": {{"choices": [{{"message": {{"content": "{content}"}}}}]}}}}}}')
    rows = [line(1, "a", "[1]"), line(2, "a", "[3]"), line(3, "a", "sorry"),  # later invalid keeps [3]
            line(4, "b", "nope"), line(5, "c", "(2)"), line(6, "zzz", "[0]")]  # zzz is unknown
    labels = L.last_valid_per_key(L.parse_responses(_raw(spark, rows)))
    comments = spark.createDataFrame([("a", "ma"), ("b", "mb"), ("c", "mc"), ("d", "md")], "custom_id string, message string")
    merged = {r.custom_id: r["class"] for r in L.merge_labels(comments, labels).collect()}
    assert merged == {"a": 3, "b": -1, "c": 2, "d": -1}
    purged = L.purge_unlabeled(L.merge_labels(comments, labels))
    assert sorted(r.custom_id for r in purged.collect()) == ["a", "c"]
    errs = L.response_errors(L.parse_responses(_raw(spark, rows)), comments).collect()
    reasons = sorted((r.custom_id, r.reason) for r in errs)
    assert ("a", "bad_format") in reasons and ("b", "bad_format") in reasons and ("d", "no_answer") in reasons


def test_response_json_builder_roundtrip(spark):
    df = spark.createDataFrame([("row-9", " [3]\\n")], "cid string, content string")
    raw = df.select(F.lit(1).cast("bigint").alias("line_no"), response_json(F.col("cid"), F.col("content")).alias("raw"))
    r = L.parse_responses(raw).first()
    assert r.content == " [3]\n" and r["class"] == 3
