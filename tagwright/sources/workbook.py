"""Spreadsheet workbooks (.xlsx) as tables, read from any path that Spark reads.

Spark's binary file source hands each workbook to one task, which streams the sheet's XML and emits its rows in bounded
batches: memory holds the (compressed) file, its shared strings and one batch. A sheet is one deflate stream of at most
1,048,576 rows, so a task per row range would unpack the same bytes again; many workbooks are the unit of parallel work.

Defined results: a cell that is missing, an error, or beyond the schema is null; an empty text stays empty; texts keep
their ``_xHHHH_`` escapes' characters; booleans read as ``true`` / ``false``; numbers are the digits stored (a date is its serial number).
A row without any cell is skipped, as is the header row. A file that is no workbook fails the job.
"""

from __future__ import annotations

import io
import posixpath
import re
import zipfile
from collections.abc import Iterable, Iterator
from xml.etree import ElementTree
from xml.sax.saxutils import escape

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

MAX_SHEET_ROWS = 1_048_576        # of the format, header included
BATCH_ROWS, BATCH_CHARS = 5_000, 4_000_000
BOOK_CHARS = 64_000_000           # text in one written workbook, about
CELLS = "path string, sheet string, row long, cells array<string>"

_ESCAPED = re.compile("_x([0-9A-Fa-f]{4})_")
_TO_ESCAPE = re.compile("[\x00-\x08\x0b-\x1f￾￿]|_(?=x[0-9A-Fa-f]{4}_)")


def _local(tag: str) -> str:
    return tag.rpartition("}")[2]


def _elements(stream, name: str) -> Iterator[ElementTree.Element]:
    """Elements of one name as they end; each is dropped from the tree before the next is read."""
    above: list[ElementTree.Element] = []
    for event, e in ElementTree.iterparse(stream, ("start", "end")):
        if event == "start":
            above.append(e)
            continue
        above.pop()
        if _local(e.tag) == name:
            yield e
            if above:
                above[-1].remove(e)


def _string(node: ElementTree.Element) -> str:
    """The text of a string item: plain or in formatted runs, without phonetic hints."""
    parts = []
    for child in node:
        if _local(child.tag) == "t":
            parts.append(child.text or "")
        elif _local(child.tag) == "r":
            parts += [t.text or "" for t in child if _local(t.tag) == "t"]
    return unescape("".join(parts))


def unescape(text: str) -> str:
    return _ESCAPED.sub(lambda m: chr(int(m[1], 16)), text)


def escape_text(text: str) -> str:
    """Characters that XML can't hold, carriage returns and look-alikes of an escape, as ``_xHHHH_``."""
    return escape(_TO_ESCAPE.sub(lambda m: f"_x{ord(m[0]):04X}_", text))


def column_index(reference: str) -> int:
    """``B7`` -> 1."""
    n = 0
    for c in reference:
        if not c.isalpha():
            break
        n = n * 26 + ord(c.upper()) - 64
    return n - 1


def column_name(index: int) -> str:
    """1 -> ``B``."""
    out, n = "", index + 1
    while n:
        n, k = divmod(n - 1, 26)
        out = chr(65 + k) + out
    return out


def _related(book: zipfile.ZipFile, part: str) -> dict[str, tuple[str, str]]:
    """Relations of a part of the package: id -> (kind, path inside the package)."""
    folder, name = posixpath.split(part)
    out = {}
    rels = posixpath.join(folder, "_rels", name + ".rels")
    if rels in book.namelist():
        with book.open(rels) as f:
            for e in _elements(f, "Relationship"):
                target = e.get("Target", "")
                path = target.lstrip("/") if target.startswith("/") else posixpath.normpath(posixpath.join(folder, target))
                out[e.get("Id")] = (e.get("Type", "").rpartition("/")[2], path)
    return out


def sheet_rows(content: bytes, sheet: int | str | None = 0) -> Iterator[tuple[str, int, list[str | None]]]:
    """(sheet, row number from 1, cells) of one sheet by position or name, or of all (None)."""
    with zipfile.ZipFile(io.BytesIO(content)) as book:
        main = next(path for kind, path in _related(book, "").values() if kind == "officeDocument")
        related = _related(book, main)
        with book.open(main) as f:
            sheets = [(e.get("name"), next(v for k, v in e.attrib.items() if _local(k) == "id")) for e in _elements(f, "sheet")]
        strings: list[str] = []
        for kind, path in related.values():
            if kind == "sharedStrings":
                with book.open(path) as f:
                    strings = [_string(e) for e in _elements(f, "si")]
        for i, (name, relation) in enumerate(sheets):
            if sheet is None or sheet in (i, name):
                with book.open(related[relation][1]) as f:
                    yield from ((name, n, cells) for n, cells in _rows(f, strings))


def _rows(stream, strings: list[str]) -> Iterator[tuple[int, list[str | None]]]:
    n = 0
    for row in _elements(stream, "row"):
        n = int(row.get("r", n + 1))
        cells: list[str | None] = []
        for c in row:
            if _local(c.tag) == "c":
                at = column_index(c.get("r")) if c.get("r") else len(cells)
                cells += [None] * (at + 1 - len(cells))
                cells[at] = _value(c, strings)
        if any(v is not None for v in cells):
            yield n, cells


def _value(cell: ElementTree.Element, strings: list[str]) -> str | None:
    kind = cell.get("t", "n")
    for part in cell:
        if kind == "inlineStr" and _local(part.tag) == "is":
            return _string(part)
        if _local(part.tag) == "v" and part.text is not None:
            if kind == "s":
                return strings[int(part.text)]
            if kind == "b":
                return "true" if part.text.strip() == "1" else "false"
            return None if kind == "e" else unescape(part.text) if kind == "str" else part.text.strip()
    return None


def parse_workbooks(books: DataFrame, sheet: int | str | None = 0) -> DataFrame:
    """``(path, content)`` rows -> ``(path, sheet, row, cells)``: a narrow map, batches bounded by rows and characters."""
    names = ["path", "sheet", "row", "cells"]
    kinds = [pa.string(), pa.string(), pa.int64(), pa.list_(pa.string())]

    def run(batches):
        held, chars = [], 0

        def flush():
            nonlocal chars
            out = pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(zip(*held), kinds)], names=names)
            held.clear()
            chars = 0
            return out

        for b in batches:
            for path, content in zip(b.column(0), b.column(1)):
                for row in sheet_rows(content.as_py(), sheet):
                    held.append((path.as_py(), *row))
                    chars += sum(len(v) for v in row[2] if v)
                    if len(held) >= BATCH_ROWS or chars >= BATCH_CHARS:
                        yield flush()
        if held:
            yield flush()

    return books.select("path", "content").mapInArrow(run, CELLS)


def table_of(cells: DataFrame, schema: T.StructType, header: bool = True) -> DataFrame:
    """Cells by position as typed columns, with each row's place; the header (row 1 of a sheet) is left out.

    A cell that does not fit its type fails the job, as a malformed field does in ``read_csv_table``.
    """
    d = cells.where(F.col("row") > 1) if header else cells
    return d.select(*[F.get("cells", F.lit(i)).cast(f.dataType).alias(f.name) for i, f in enumerate(schema)],
                    F.col("path").alias("_file"), F.lit(0).cast("bigint").alias("_start"), F.col("row").alias("_row"))


def read_workbooks(spark: SparkSession, path: str, sheet: int | str | None = 0) -> DataFrame:
    """``(path, sheet, row, cells)`` of the workbooks at a path, folder or glob."""
    return parse_workbooks(spark.read.format("binaryFile").option("pathGlobFilter", "*.xlsx").load(path), sheet)


def read_workbook_table(spark: SparkSession, path: str, schema: T.StructType, sheet: int | str = 0, header: bool = True) -> DataFrame:
    """Workbooks as one table with an explicit schema (S1 for spreadsheets) and each row's place (``csv.PLACE``)."""
    return table_of(read_workbooks(spark, path, sheet), schema, header)


def read_comments(spark: SparkSession, path: str) -> DataFrame:
    """User names and comments by position (first and third column, P1) with each row's place, as ``csv.read_comments`` gives them."""
    schema = T.StructType([T.StructField(n, T.StringType()) for n in ("username", "_second", "comment")])
    return read_workbook_table(spark, path, schema).drop("_second")


_PARTS = {
    "[Content_Types].xml": '<Types xmlns="http://schemas.openxmlformats.org/package/2006/content-types">'
        '<Default Extension="rels" ContentType="application/vnd.openxmlformats-package.relationships+xml"/>'
        '<Override PartName="/xl/workbook.xml" ContentType="application/vnd.openxmlformats-officedocument.spreadsheetml.sheet.main+xml"/>'
        '<Override PartName="/xl/worksheets/sheet1.xml" ContentType="application/vnd.openxmlformats-officedocument.spreadsheetml.worksheet+xml"/></Types>',
    "_rels/.rels": '<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships"><Relationship Id="r1" '
        'Type="http://schemas.openxmlformats.org/officeDocument/2006/relationships/officeDocument" Target="xl/workbook.xml"/></Relationships>',
    "xl/workbook.xml": '<workbook xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main" '
        'xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"><sheets><sheet name="Sheet1" sheetId="1" r:id="r1"/></sheets></workbook>',
    "xl/_rels/workbook.xml.rels": '<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships"><Relationship Id="r1" '
        'Type="http://schemas.openxmlformats.org/officeDocument/2006/relationships/worksheet" Target="worksheets/sheet1.xml"/></Relationships>',
}


def _cell(reference: str, value) -> str:
    if value is None:
        return ""
    if isinstance(value, bool):
        return f'<c r="{reference}" t="b"><v>{int(value)}</v></c>'
    if isinstance(value, (int, float)):
        return f'<c r="{reference}"><v>{value!r}</v></c>'
    return f'<c r="{reference}" t="inlineStr"><is><t xml:space="preserve">{escape_text(str(value))}</t></is></c>'


def workbook(header: list[str], rows: Iterable[Iterable]) -> bytes:
    """One workbook of one sheet: a header row, then the rows as they come."""
    out = io.BytesIO()
    names = [column_name(i) for i in range(len(header))]
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as book:
        for part, xml in _PARTS.items():
            book.writestr(zipfile.ZipInfo(part), xml)
        with book.open(zipfile.ZipInfo("xl/worksheets/sheet1.xml"), "w", force_zip64=True) as f:
            f.write(b'<worksheet xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"><sheetData>')
            for n, row in enumerate((header, *rows), 1):
                f.write(f'<row r="{n}">{"".join(_cell(f"{c}{n}", v) for c, v in zip(names, row))}</row>'.encode())
            f.write(b"</sheetData></worksheet>")
    return out.getvalue()


def workbooks_of(df: DataFrame, max_rows: int = MAX_SHEET_ROWS - 1) -> DataFrame:
    """A table as workbooks, ``(path, content)``: each task packs its rows in their order, a new workbook whenever one is full."""
    header = list(df.columns)

    def run(batches):
        rows, chars, k = [], 0, 0

        def flush():
            nonlocal chars, k
            name = f"part-{TaskContext.get().partitionId():05d}-{k:05d}.xlsx"
            out = pa.RecordBatch.from_arrays([pa.array([name]), pa.array([workbook(header, rows)], pa.binary())], names=["path", "content"])
            rows.clear()
            chars, k = 0, k + 1
            return out

        for b in batches:
            for row in zip(*(c.to_pylist() for c in b.columns)):
                rows.append(row)
                chars += sum(len(v) for v in row if isinstance(v, str))
                if len(rows) >= max_rows or chars >= BOOK_CHARS:
                    yield flush()
        if rows:
            yield flush()

    plain = ("string", "tinyint", "smallint", "int", "bigint", "float", "double", "boolean")
    as_cell: list[Column] = [F.col(f"`{n}`") if t in plain else F.col(f"`{n}`").cast("string").alias(n) for n, t in df.dtypes]
    return df.select(*as_cell).mapInArrow(run, "path string, content binary")
