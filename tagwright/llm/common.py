"""Helpers shared by the text operators.

A word is a maximal run of characters other than space and U+0009..U+000D.
``bytes.split`` cuts at exactly these six ASCII characters, so tasks split the
UTF-8 bytes; ``WORD`` is the same rule for JVM expressions.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.types import StructField, StructType, _parse_datatype_string

WORD = "[^\\x20\\x09-\\x0D]+"
SUB_BATCH_CHARS = 2_000_000  # texts handled together by one vectorised call inside a task


def utf8(text: str | None) -> bytes:
    return b"" if text is None else text.encode("utf-8", "replace")


def words_of(text: str | None) -> list[bytes]:
    return utf8(text).split()


def n_words(text: Column | str) -> Column:
    """Number of words of a text as a JVM expression; null: 0."""
    return F.coalesce(F.regexp_count(F.col(text) if isinstance(text, str) else text, F.lit(WORD)), F.lit(0)).cast("long")


def id_order(doc_id: str = "doc_id") -> list[Column]:
    """Ascending document order with a null id last."""
    return [F.col(doc_id).asc_nulls_last()]


def text_key(text: Column | str) -> Column:
    """128-bit key of a text (null and empty differ), for grouping equal texts without shuffling them."""
    return F.coalesce(F.md5(text), F.lit("null"))


def packed(df: DataFrame) -> Column:
    """All columns of a table as one struct ``_row``: whatever their names, they can't clash with an operator's own."""
    return F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("_row")


def unpacked(df: DataFrame, without: Iterable[str] = ()) -> list[Column]:
    """The columns of the table that was packed, but for ``without`` (in any case) which the operator replaces."""
    drop = {c.lower() for c in without}
    return [F.col("_row")[c].alias(c) for c in df.columns if c.lower() not in drop]


def by_size(texts: Iterable[str | None], limit: int = SUB_BATCH_CHARS) -> Iterator[list[str]]:
    """Consecutive lists of texts of about ``limit`` characters, so that memory does not follow the batch's text length."""
    out: list[str] = []
    held = 0
    for t in texts:
        out.append(t or "")
        held += len(out[-1])
        if held >= limit:
            yield out
            out, held = [], 0
    if out:
        yield out


def map_batches(df: DataFrame, fn: Callable[[dict[str, list], ], dict[str, list]], schema: StructType | str) -> DataFrame:
    """``mapInArrow`` over record batches given and taken as ``{column: list}``."""
    from pyspark.sql.pandas.types import to_arrow_schema

    struct = _parse_datatype_string(schema) if isinstance(schema, str) else schema
    arrow = to_arrow_schema(struct)

    def run(batches):
        for b in batches:
            if b.num_rows:
                out = fn({n: b.column(i) for i, n in enumerate(b.schema.names)})
                yield pa.RecordBatch.from_arrays([pa.array(out[f.name], type=f.type) for f in arrow], schema=arrow)

    return df.mapInArrow(run, struct)


def add_column(df: DataFrame, source: str, out: str, kind: str, fn: Callable[[list], pa.Array], chars: int = 500_000) -> DataFrame:
    """Add (or replace) the column ``out`` = fn(values of ``source``), computed for a few values at a time: about ``chars``
    characters (or list entries). A narrow map; the other columns pass through as they are."""
    keep = [c for c in df.columns if c.lower() != out.lower()]
    at, places = df.columns.index(source), [df.columns.index(c) for c in keep]
    schema = StructType([*[df.schema[i] for i in places], StructField(out, _parse_datatype_string(kind))])
    names = [f.name for f in schema]

    def run(batches):
        for b in batches:
            begin = held = 0
            column = b.column(at)
            sizes = pc.fill_null((pc.list_value_length if pa.types.is_list(column.type) else pc.binary_length)(column), 0).to_pylist()
            for i, size in enumerate(sizes):
                held += size
                if held >= chars or i + 1 == b.num_rows:
                    part = b.slice(begin, i + 1 - begin)
                    yield pa.RecordBatch.from_arrays([*[part.column(k) for k in places], fn(part.column(at))], names=names)
                    begin, held = i + 1, 0

    return df.mapInArrow(run, schema)


def bounded_labels(labels: DataFrame, target: str, max_rows: int, where: Column | None = None) -> DataFrame:
    """At most ``max_rows`` labelled ids (half of them per class), chosen by a hash of the id: the same on every run.

    Null ids and null labels are left out, repeated label rows of one id count once (the largest label).
    """
    one = (labels.where(F.col("doc_id").isNotNull() & F.col(target).isNotNull())
           .groupBy("doc_id").agg(F.max(F.col(target).cast("int")).alias("label")))
    if where is not None:
        one = one.where(where)
    ranked = [one.where(F.col("label") == c).orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_rows // 2) for c in (0, 1)]
    return ranked[0].unionByName(ranked[1])


def labelled(docs: DataFrame, labels: DataFrame, target: str, max_rows: int, where: Column | None = None) -> DataFrame:
    """(text, label) of the bounded sample, in the order of id and text; ``max_rows`` bounds the rows even if ids repeat."""
    chosen = F.broadcast(bounded_labels(labels, target, max_rows, where))  # <= max_rows rows of two numbers
    return docs.select("doc_id", "text").join(chosen, "doc_id").orderBy("doc_id", "text").limit(2 * max_rows).select("text", "label")
