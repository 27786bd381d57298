"""Workbooks and archives read sheet by sheet: the rows of the whole reader, in any nesting, in bounded memory."""

import datetime
import random

import pytest
from pyspark.sql import functions as F
from test_sources_and_streams import SHEET, xlsx, zipped

from saldo.sources import books
from saldo.sources.tables import read_sheets

MAIN = "http://schemas.openxmlformats.org/spreadsheetml/2006/main"


def put(folder):
    (folder / "a.xlsx").write_bytes(xlsx())
    (folder / "b.zip").write_bytes(zipped({"in.csv": "#note\nkey;amount\nk9;3\n", "deep.zip": zipped({"x.xlsx": xlsx(), "订单.csv": "甲,乙\n1,\"二\n三\"\n".encode("gb18030")}), "y.xlsx": xlsx()}))
    (folder / "c.csv").write_bytes(b"k,v\n1,2\n")


def test_the_rows_of_the_whole_reader(spark, tmp_path):
    put(tmp_path)
    columns = ["file", "sheet", "row_no", "cells"]
    told = books.read_books(spark, str(tmp_path))
    got = sorted(tuple(r) for r in told.select(columns).collect())
    assert got == sorted(tuple(r) for r in read_sheets(spark, str(tmp_path)).select(columns).collect()) and len(got) > 12
    assert told.rdd.getNumPartitions() == 6  # a task for each sheet and delimited file
    assert books.read_books(spark, f"file:{tmp_path}/*.csv").count() == 2 and books.read_books(spark, str(tmp_path / "a.xlsx")).count() == 3


def test_what_is_refused(spark, tmp_path):
    put(tmp_path)
    for options, why in (({"depth": 1}, "nested too deep"), ({"maxFiles": 2}, "too many"), ({"maxBytes": 10}, "too many or too large")):
        with pytest.raises(Exception, match=why):
            books.read_books(spark, str(tmp_path), **options).collect()
    (tmp_path / "d.xls").write_bytes(b"x")
    with pytest.raises(Exception, match="unknown kind"):
        books.read_books(spark, str(tmp_path)).collect()
    with pytest.raises(Exception, match="no files"):
        books.read_books(spark, str(tmp_path / "*.none")).collect()
    (tmp_path / "e").mkdir()
    (tmp_path / "e" / "bomb.zip").write_bytes(zipped({"bomb.csv": "0" * 10**6}))
    with pytest.raises(Exception, match="unsafe member"):
        books.read_books(spark, str(tmp_path / "e")).collect()


def test_days_from_1904_hidden_sheets_and_profiles(spark, tmp_path):
    row = lambda r, *cells: f'<row r="{r}">' + "".join(f'<c r="{chr(65 + i)}{r}" t="inlineStr"><is><t>{c}</t></is></c>' for i, c in enumerate(cells)) + "</row>"
    sheet = f'<worksheet xmlns="{MAIN}"><sheetData>{row(1, "report")}{row(3, "Day", "Amount ")}{row(4, "0", "1,5")}{row(5, "43586.75", "2")}{row(6, "2024-05-01", "x")}</sheetData></worksheet>'
    for name, setting in (("w", ""), ("m", '<workbookPr date1904="1"/>')):
        book = f'<workbook xmlns="{MAIN}">{setting}<sheets><sheet name="S" sheetId="1"/><sheet name="H" sheetId="2" state="hidden"/></sheets></workbook>'
        (tmp_path / f"{name}.xlsx").write_bytes(zipped({"xl/workbook.xml": book, "xl/worksheets/sheet1.xml": sheet, "xl/worksheets/sheet2.xml": SHEET.replace('t="s"', "")}))
    told = books.read_books(spark, str(tmp_path))
    days = told.where("sheet = 'S' and row_no > 3").select("file", "row_no", books.dated(F.col("cells")[0], F.col("epoch")).alias("day"))
    got = {(r["file"], r["row_no"]): r["day"] for r in days.collect()}
    day = datetime.date
    assert got == {("w.xlsx", 4): day(1899, 12, 30), ("w.xlsx", 5): day(2019, 5, 1), ("w.xlsx", 6): day(2024, 5, 1), ("m.xlsx", 4): day(1904, 1, 1), ("m.xlsx", 5): day(2023, 5, 2), ("m.xlsx", 6): day(2024, 5, 1)}
    profiles = {(r["file"], r["sheet"]): r for r in books.sheet_profiles(told).collect()}
    one, hidden = profiles["m.xlsx", "S"], profiles["m.xlsx", "H"]
    assert (one["first_row"], one["last_row"], one["filled_rows"], one["width"], one["filled_cells"], one["numbers"], one["header_row"], one["headers"]) == (1, 6, 5, 2, 9, 4, 3, ["Day", "Amount"])
    assert hidden["hidden"] and not one["hidden"] and hidden["header_row"] is None and hidden["headers"] is None


def test_strings_by_number():
    texts = ["", "字" * 5, "\ud800", *(f"s{i}" for i in range(10_000))]
    strings = books.Strings(texts)
    assert all(strings[i] == texts[i] for i in random.Random(1).sample(range(len(texts)), 2_000)) and strings[len(texts) - 1] == texts[-1]
    with pytest.raises(IndexError):
        strings[len(texts)]


def test_what_is_written_is_read(spark, tmp_path, monkeypatch):
    cells = [("1", " <a> & \"b\"\n二"), ("2", None), ("3", "x\x00y"), (None, None)]
    table = spark.createDataFrame([(str(i), *c) for i, c in enumerate(cells * 500)], "n string, k string, v string").repartition(3)
    out = str(tmp_path / "new" / "books")
    for _ in range(2):  # written again, the same files
        assert books.write_books(table, out).agg(F.sum("rows")).first()[0] == 2_000
    told = books.read_books(spark, out)
    assert sorted({r["file"] for r in told.collect()}) == [f"part-{i:05d}.xlsx" for i in range(3)]
    got = {r["cells"][0]: r["cells"][1:] for r in told.where("row_no > 1").collect()}
    want = {str(i): c for i, c in enumerate([["1", '<a> & "b"\n二'], ["2"], ["3", "xy"], []] * 500)}
    assert got == want
    with monkeypatch.context() as m:  # more rows than a sheet takes, and none
        m.setattr(books, "MOST_ROWS", 4)
        with open(tmp_path / "many.xlsx", "wb") as f, open(tmp_path / "none.xlsx", "wb") as g:
            assert books._book(f, ["k"], iter([(str(i),) for i in range(6)])) == 6 and books._book(g, ["k"], iter(())) == 0
    many = [(r["sheet"], r["row_no"], r["cells"]) for r in books.read_books(spark, str(tmp_path / "many.xlsx")).collect()]
    assert many == [(s, r, [c]) for s, cells in (("Sheet1", "k012"), ("Sheet2", "k345")) for r, c in enumerate(cells, 1)]
    assert [r["cells"] for r in books.read_books(spark, str(tmp_path / "none.xlsx")).collect()] == [["k"]]
