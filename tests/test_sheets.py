"""Workbooks: parts and styles, round trips of every kind of cell."""

import io
import zipfile
from xml.etree import ElementTree

import pytest

from segq.sources import sheets
from segq.sources.files import MAIN, SHEET, sheet_rows
from segq.sources.shared import shared_path


def test_a_workbook_is_styled():
    z = zipfile.ZipFile(io.BytesIO(sheets.workbook(["a", "long name"], [("x" * 80, 1), ("y", None), (None, 2.5)], sheet="A & B")))
    assert {ElementTree.fromstring(z.read(n)).tag.split("}")[1] for n in z.namelist()} == {"Types", "Relationships", "workbook", "styleSheet", "worksheet"}
    root = ElementTree.fromstring(z.read(SHEET))
    pane, table = root.find(f".//{MAIN}pane"), root.find(f"{MAIN}autoFilter")
    assert (pane.get("state"), pane.get("ySplit"), table.get("ref")) == ("frozen", "1", "A1:B4")
    assert [c.get("width") for c in root.iter(f"{MAIN}col")] == ["62", "11"]
    assert [[c.get("s") for c in r] for r in root.iter(f"{MAIN}row")] == [["1", "1"], ["3", "3"], ["2", "2"], ["3", "3"]]
    assert ElementTree.fromstring(z.read("xl/workbook.xml")).find(f".//{MAIN}sheet").get("name") == "A & B"
    assert [e.tag.split("}")[1] for e in root] == ["sheetViews", "cols", "sheetData", "autoFilter"]


def test_same_rows_same_bytes():
    assert sheets.workbook(["a"], [("x",)]) == sheets.workbook(["a"], [("x",)])


def test_letters():
    assert [sheets._letters(i) for i in (0, 25, 26, 701, 702)] == ["A", "Z", "AA", "ZZ", "AAA"]


ROWS = [(1, "<a> & \"b\"", 0.1, True), (2, None, None, None), (3, "", -1e300, False), (4, "x\x00\r\n\t\x0b_x000D_ \ufffe", 5.0, True), (2**62, " \U0001f600 " * 9000, 1 / 3, None), (4, "y" * sheets.CELL, 1.0, False), (4, "y" * sheets.CELL, 1.0, False)]
SCHEMA = "id long, text string, x double, flag boolean"


@pytest.mark.parametrize("rows", [1, 3, 1000])
def test_round_trip(spark, rows):
    df = spark.createDataFrame(ROWS, SCHEMA)
    path = sheets.write_workbooks(df, shared_path(spark, "books"), rows=rows)
    books = spark.read.parquet(path)
    assert sorted(map(repr, sheets.read_workbooks(books, SCHEMA).collect())) == sorted(map(repr, df.collect()))
    assert books.agg({"n_rows": "max"}).first()[0] <= rows and books.select("path").distinct().count() == books.count()


def test_sorted_over_all_workbooks(spark):
    books = sheets.workbooks(spark.range(100).selectExpr("(id * 37) % 100 AS n"), "n", sort_by=["n"], rows=7)
    found = [[int(r["n"]) for r in sheets.sheet_records(bytes(b.content))] for b in sorted(books.collect(), key=lambda b: b.path)]
    assert sum(found, []) == list(range(100)) and max(map(len, found)) == 7


def test_bounded_by_bytes_and_empty(spark):
    df = spark.createDataFrame([("z" * 100,)] * 10, "t string").coalesce(1)
    assert [r.n_rows for r in sheets.workbooks(df, "b", size=250).collect()] == [3, 3, 3, 1]
    assert sheets.workbooks(df.limit(0), "b").count() == 0


def test_other_types_names_and_taken_paths(spark):
    df = spark.sql("SELECT DATE'2024-01-02' AS `a.b`, CAST(1.50 AS DECIMAL(5,2)) AS `c d`, array(1, 2) AS e, double('nan') AS f")
    path = shared_path(spark, "books")
    assert sheets.write_workbooks(df, path) == path and sheets.write_workbooks(df, path) == f"{path}_v2" and sheets.write_workbooks(df, path) == f"{path}_v3"
    (book,) = spark.read.parquet(path).collect()
    assert list(sheets.sheet_records(bytes(book.content))) == [{"a.b": "2024-01-02", "c d": "1.50", "e": "[1, 2]", "f": "nan"}]
    assert list(sheet_rows(bytes(book.content)))[0] == ["a.b", "c d", "e", "f"]
    got = sheets.read_workbooks(spark.read.parquet(path), "`a.b` date, `c d` decimal(5,2), e string")
    assert got.columns == ["a.b", "c d", "e"] and got.toDF("d", "n", "e").selectExpr("string(d)", "string(n)", "e").first() == ("2024-01-02", "1.50", "[1, 2]")
    with pytest.raises(ValueError, match="names"):
        sheets.workbooks(df.withColumnRenamed("e", "e (2)"), "b")
