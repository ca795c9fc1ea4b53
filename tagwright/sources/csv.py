"""CSV tables with a header, quoted fields and doubled-quote escaping."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T


MAX_RECORDS = 1_000_000


def read_csv_table(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """Header row, quoted fields that may hold newlines, ``""`` escaping, explicit schema."""
    return (spark.read.schema(schema).option("header", True).option("multiLine", True)
            .option("quote", '"').option("escape", '"').option("mode", "FAILFAST").csv(path))


def _writer(df: DataFrame, mode: str):
    # files stay small enough that reading one back (multi-line fields: one task a file) is a fair task
    return (df.write.mode(mode).option("maxRecordsPerFile", MAX_RECORDS).option("header", True).option("quote", '"').option("escape", '"')
            .option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False))


def write_csv_quote_all(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    """Every field quoted, no index (S5); ``mode`` is the overwrite switch."""
    _writer(df, mode).option("quoteAll", True).csv(path)


def write_csv_minimal(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    """Quote only where needed; empty strings stay empty fields."""
    _writer(df, mode).option("emptyValue", "").csv(path)


# columns that ``read_comments`` adds: they order rows as the files do
PLACE = ("_file", "_start", "_row")


def read_comments(spark: SparkSession, path: str) -> DataFrame:
    """Comments with a header (username, comment[, custom_id]) and each row's place in the files.

    Files are ordered by path, rows as they stand; a file with fields over several lines is read by one task.
    """
    d = spark.read.option("header", True).option("multiLine", True).option("escape", '"').csv(path)
    return d.select("*", F.col("_metadata.file_path").alias("_file"), F.col("_metadata.file_block_start").alias("_start"),
                    F.monotonically_increasing_id().alias("_row"))
