import pytest

import __spark_entry__ as E
import corpus_pipeline as P
from tagwright.llm import queries
from tools.oracle_check import compare, duck

from .conftest import SF


@pytest.mark.parametrize("key", sorted(queries.ORACLE_SQL))
def test_query_matches_oracle(spark, key):
    status, message = compare(spark, duck(SF), key, queries.QUERIES[key], queries.ORACLE_SQL[key], SF)
    assert status == "OK", message


def test_every_operator_is_registered():
    names = set(E.queries())
    assert {int(n[2:].split("_")[0]) for n in names if n.startswith("op") and n[2:3].isdigit()} == set(range(1, 14))
    assert "pipeline" in names and set(queries.ORACLE_SQL) <= set(E.oracle_sql())


@pytest.mark.parametrize("key", sorted(set(queries.QUERIES) - set(queries.ORACLE_SQL)))
def test_queries_return_a_row_per_document(spark, key):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    got = queries.QUERIES[key](spark, SF)
    assert got.count() == docs.count() and got.select("doc_id").distinct().count() == docs.count()


def test_stages_keep_the_documents_columns_and_shrink(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    before = {r["doc_id"] for r in docs.select("doc_id").collect()}
    for name, stage in P.STAGES[:3]:
        docs_after = stage(spark, docs, SF)
        assert docs_after.dtypes == docs.dtypes, name
        after = [r["doc_id"] for r in docs_after.select("doc_id").collect()]
        assert len(after) == len(set(after)) and set(after) <= before
        docs, before = docs_after, set(after)
    assert P.STAGES[3][1](spark, docs, SF).dtypes == docs.dtypes


def test_run_equals_the_stages_one_by_one(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    for i, (_, stage) in enumerate(P.STAGES):
        stage(spark, docs, SF).write.parquet(str(tmp_path / str(i)))
        docs = spark.read.parquet(str(tmp_path / str(i)))
    got = P.run(spark, SF)
    assert got.columns == docs.columns
    assert got.exceptAll(docs).count() == 0 and docs.exceptAll(got).count() == 0


@pytest.mark.parametrize("i", range(5))
def test_stages_take_hostile_and_empty_documents(spark, hostile, tmp_path, i):
    labels = spark.createDataFrame([(1, 0), (5, 0), (7, 1), (8, 1)], "doc_id long, toxic int")
    labels.write.parquet(str(tmp_path / "labels.parquet"))
    docs = hostile.drop("ids", "score")
    stage = P.STAGES[i][1]
    assert stage(spark, docs, str(tmp_path)).count() > 0
    assert stage(spark, docs.limit(0), str(tmp_path)).count() == 0
