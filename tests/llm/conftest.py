import os
import sys

import pytest
from pyspark.sql import SparkSession

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__)))))

SF = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="session")
def docs_of(spark: SparkSession):
    """Documents from texts, or from (id, text[, source]) rows, over several partitions."""
    def make(rows, parts=3):
        rows = [r if isinstance(r, tuple) else (i, r) for i, r in enumerate(rows)]
        full = [(r[0], r[1], "en", r[2] if len(r) > 2 else "s", None) for r in rows]
        return spark.createDataFrame(full, DOCS).repartition(parts)
    return make


@pytest.fixture(scope="session")
def hostile(spark: SparkSession):
    """Nulls in every column, empty and very long texts, ties, repeated rows, and columns named like the operators' own."""
    long_text = "\n".join(f"line {i} of a very long text with password=abcdef{i:04d} in it" for i in range(4000))
    rows = [(1, "a b c"), (1, "a b c"), (1, "other text of the same id"), (None, None), (None, "text without id"), (2, None),
            (3, ""), (4, "   \n\t "), (5, long_text), (6, long_text), (7, "é ▁ 日本語 \x00 \x1f end"), (8, "x" * 5000)]
    full = [(i, t, None if i == 2 else "en", None if i in (None, 3) else "s", None, "a", 1, 2.0, 3, "b") for i, t in rows]
    schema = DOCS + ", _h string, size int, _row double, ids int, score string"
    return spark.createDataFrame(full, schema).repartition(4)
