"""Workbooks: written and read back, and files built by hand in the forms that spreadsheet programs write."""

import io
import zipfile

import pytest
from pyspark.sql import types as T

from tagwright.plans import workflows
from tagwright.sources import workbook as WB

ROWS = [("u1", 3, "plain"), (None, None, "a\r\nb\tc  "), ("", 1, "_x000D_ kept, \x00\x1f too"), ("<&>\"'", 2, "日本 é 😀"), ("long", 5, "x" * 100_000),
        ("u1", 3, "plain")]
SCHEMA = T.StructType([T.StructField("username", T.StringType()), T.StructField("n", T.LongType()), T.StructField("comment", T.StringType())])


def _save(folder, df):
    for r in df.collect():
        (folder / r["path"]).write_bytes(bytes(r["content"]))


def test_files_round_trip_with_their_places(spark, tmp_path):
    df = spark.createDataFrame(ROWS, SCHEMA).coalesce(1)
    _save(tmp_path, WB.workbooks_of(df, max_rows=4))
    (tmp_path / "notes.txt").write_text("not read")
    assert len(list(tmp_path.glob("*.xlsx"))) == 2
    got = WB.read_workbook_table(spark, str(tmp_path), SCHEMA).orderBy("_file", "_row").collect()
    assert [tuple(r)[:3] for r in got] == ROWS
    assert [r["_row"] for r in got] == [2, 3, 4, 5, 2, 3]


def _book(sheets, strings=None):
    """A package as spreadsheet programs write it: absolute targets, prefixed names, shared strings."""
    main, rel = "http://schemas.openxmlformats.org/spreadsheetml/2006/main", "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("_rels/.rels", f'<Relationships><Relationship Id="a" Type="{rel}/officeDocument" Target="/xl/book.xml"/></Relationships>')
        z.writestr("xl/book.xml", f'<x:workbook xmlns:x="{main}" xmlns:r="{rel}"><x:sheets>' + "".join(
            f'<x:sheet name="{n}" sheetId="{i}" r:id="s{i}"/>' for i, n in enumerate(sheets)) + "</x:sheets></x:workbook>")
        z.writestr("xl/_rels/book.xml.rels", "<Relationships>" + "".join(
            f'<Relationship Id="s{i}" Type="{rel}/worksheet" Target="/xl/sheets/{i}.xml"/>' for i in range(len(sheets)))
            + f'<Relationship Id="t" Type="{rel}/sharedStrings" Target="strings.xml"/></Relationships>')
        z.writestr("xl/strings.xml", f'<sst xmlns="{main}">{strings or ""}</sst>')
        for i, xml in enumerate(sheets.values()):
            z.writestr(f"xl/sheets/{i}.xml", f'<worksheet xmlns="{main}"><sheetData>{xml}</sheetData></worksheet>')
    return out.getvalue()


def test_cells_of_every_kind():
    strings = "<si><t>one</t></si><si><r><t>ri</t></r><r><t>ch</t></r><rPh><t>hint</t></rPh></si><si><t/></si>"
    first = ('<row r="1"><c r="A1" t="s"><v>0</v></c><c r="C1" t="s"><v>1</v></c></row><row r="2"/>'
             '<row r="5"><c t="b"><v>1</v></c><c t="e"><v>#N/A</v></c><c t="str"><f>A1</f><v>x_x0041_</v></c><c><v>1.50</v></c><c t="s"><v>2</v></c></row>'
             '<row><c r="AA6" t="inlineStr"><is><t>far</t></is></c></row>')
    book = _book({"First": first, "Second": '<row><c t="n"><v>7</v></c></row>'}, strings)
    assert list(WB.sheet_rows(book)) == [("First", 1, ["one", None, "rich"]), ("First", 5, ["true", None, "xA", "1.50", ""]),
                                         ("First", 6, [None] * 26 + ["far"])]
    assert list(WB.sheet_rows(book, "Second")) == [("Second", 1, ["7"])] == list(WB.sheet_rows(book, 1))
    assert len(list(WB.sheet_rows(book, None))) == 4


def test_column_names():
    assert [WB.column_name(i) for i in (0, 25, 26, 701, 702)] == ["A", "Z", "AA", "ZZ", "AAA"]
    assert all(WB.column_index(WB.column_name(i) + "9") == i for i in range(2000))


def test_rows_leave_the_task_in_batches(spark, monkeypatch):
    monkeypatch.setattr(WB, "BATCH_ROWS", 7)
    books = spark.createDataFrame([(f"{i}.xlsx", WB.workbook(["a"], [[j] for j in range(50)])) for i in range(3)], "path string, content binary")
    cells = WB.parse_workbooks(books)
    assert cells.count() == 153
    table = WB.table_of(cells, T.StructType([T.StructField("a", T.IntegerType()), T.StructField("absent", T.StringType())]))
    assert table.count() == 150 and table.agg({"a": "sum"}).first()[0] == 3 * 1225 and table.where("absent is not null").count() == 0


def test_empty_tables_and_bad_files(spark, tmp_path):
    assert WB.workbooks_of(spark.createDataFrame([], SCHEMA)).count() == 0
    (tmp_path / "empty.xlsx").write_bytes(WB.workbook(["username", "x", "comment"], []))
    assert WB.read_comments(spark, str(tmp_path)).count() == 0
    (tmp_path / "bad.xlsx").write_bytes(b"no workbook")
    with pytest.raises(Exception, match="zip"):
        WB.read_comments(spark, str(tmp_path)).count()


def test_requests_from_a_workbook_in_the_order_of_its_rows(spark, tmp_path):
    rows = [(f"user{i}", "ignored", f"comment {i}") for i in range(20)]
    (tmp_path / "in.xlsx").write_bytes(WB.workbook(["name", "date", "text"], rows))
    workflows.write_label_requests(WB.read_comments(spark, str(tmp_path / "in.xlsx")), str(tmp_path / "out"))
    got = spark.read.json(str(tmp_path / "out"))
    assert sorted(r["custom_id"] for r in got.collect()) == sorted(f"row-{i}" for i in range(20))
    text = {r["custom_id"]: r["body"]["messages"][1]["content"] for r in got.collect()}
    assert all(text[f"row-{i}"].endswith(f"user{i}+comment {i}") for i in range(20))
