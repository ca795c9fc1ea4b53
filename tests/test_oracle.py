"""Every registered query against its DuckDB oracle (sf0.001), and the entry smoke test."""

import pytest

import __spark_entry__ as E
from tools.oracle_check import compare, duck

from conftest import SF001

SQL = E.oracle_sql()


@pytest.fixture(scope="module")
def con():
    return duck(SF001)


@pytest.mark.parametrize("key", sorted(SQL))
def test_query_matches_oracle(spark, con, key):
    status, msg = compare(spark, con, key, E.queries()[key], SQL[key], SF001)
    assert status == "OK", msg


@pytest.mark.parametrize("key", sorted(set(E.queries()) - set(SQL)))
def test_rows_only_queries_run(spark, key):
    assert E.queries()[key](spark, SF001).count() >= 0


def test_entry(spark):
    df = E.entry(spark)
    assert [f.name for f in df.schema.fields] == ["class", "n"]
    assert df.count() == 4
