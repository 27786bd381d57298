"""Sources lose no file, sheet or line without an error."""

import pytest
from test_sources_and_streams import SHEET, zipped

from saldo.sources.tables import SourceError, read_csv, read_sheets, workbook


def test_large_and_unknown_files_raise(spark, tmp_path):
    (tmp_path / "a.csv").write_bytes(b"k;v\n" + b"x;1\n" * 300_000)
    with pytest.raises(SourceError, match=r"a\.csv"):
        read_sheets(spark, str(tmp_path), most_mbytes=1)
    (tmp_path / "a.csv").write_bytes(b"k;v\n")
    (tmp_path / "b.xls").write_bytes(b"x")
    with pytest.raises(Exception, match="unknown kind"):
        read_sheets(spark, str(tmp_path)).collect()


@pytest.mark.parametrize("quoted", [False, True])
def test_gb18030_is_split_and_whole(spark, tmp_path, quoted):
    """Many splits, two files, a data line like the header, and (quoted) a cell with a line break in one of them."""
    lines = [f"订{i},{i}" for i in range(20_000)] + ["订单号,金额"]
    for name in "ab":
        (tmp_path / f"{name}.dat").write_bytes(("#账单\n\n订单号,金额\n" + "\n".join(lines) + ('\n"一\n二",7\n' if quoted and name == "b" else "\n")).encode("gb18030"))
    was = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "65536")
    try:
        rows = read_csv(spark, str(tmp_path))
        assert rows.rdd.getNumPartitions() > 2
        got = sorted(tuple(r) for r in rows.collect())
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", was)
    want = [(*line.split(","), f"{name}.dat") for name in "ab" for line in lines]
    assert got == sorted(want + ([("一\n二", "7", "b.dat")] if quoted else []))


def test_each_file_is_sniffed(spark, tmp_path):
    (tmp_path / "a.csv").write_bytes("单,额\n甲,1\n".encode("gb18030"))
    (tmp_path / "b.csv").write_bytes("额;单\n2;乙\n".encode())
    (tmp_path / "c[1].csv").write_bytes("单\t注\n丙\tx\n".encode())
    got = {(r["file"], r["单"], r["额"], r["注"]) for r in read_csv(spark, str(tmp_path)).collect()}
    assert {g[1:] for g in got} == {("甲", "1", None), ("乙", "2", None), ("丙", None, "x")} and len({g[0] for g in got}) == 3


def test_sheets_are_found_by_relation():
    main, rel = "http://schemas.openxmlformats.org/spreadsheetml/2006/main", "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
    book = f'<workbook xmlns="{main}" xmlns:r="{rel}"><sheets><sheet name="May" sheetId="9" r:id="rId4"/><sheet name="Chart" sheetId="3" r:id="rId5"/></sheets></workbook>'
    parts = f'<Relationships><Relationship Id="rId4" Type="{rel}/worksheet" Target="worksheets/sheet7.xml"/><Relationship Id="rId5" Type="{rel}/chartsheet" Target="chartsheets/sheet1.xml"/></Relationships>'
    strings = f'<sst xmlns="{main}"><si><t>key</t></si><si><t>amount</t></si></sst>'
    files = {"xl/workbook.xml": book, "xl/_rels/workbook.xml.rels": parts, "xl/sharedStrings.xml": strings, "xl/worksheets/sheet7.xml": SHEET}
    assert [r[:2] for r in workbook(zipped(files))] == [("May", n) for n in (1, 2, 3, 4)]
    del files["xl/worksheets/sheet7.xml"]
    with pytest.raises(SourceError):
        list(workbook(zipped(files)))


def test_merged_cells_reach_over_rows_that_are_not_there():
    main = "http://schemas.openxmlformats.org/spreadsheetml/2006/main"
    cell = lambda ref, v: f'<c r="{ref}" t="inlineStr"><is><t>{v}</t></is></c>'
    rows = f'<row r="2">{cell("A2", "a")}{cell("C2", "c")}</row><row r="3"><c r="B3"><v>7</v></c></row><row r="9">{cell("B9", "z")}</row>'
    sheet = f'<worksheet xmlns="{main}"><sheetData>{rows}</sheetData><mergeCells><mergeCell ref="B9:C10"/><mergeCell ref="A2:A5"/><mergeCell ref="D7:E7"/></mergeCells></worksheet>'
    book = f'<workbook xmlns="{main}"><sheets><sheet name="S" sheetId="1"/></sheets></workbook>'
    got = list(workbook(zipped({"xl/workbook.xml": book, "xl/worksheets/sheet1.xml": sheet})))
    assert got == [
        ("S", 2, ["a", None, "c"]), ("S", 3, ["a", "7"]), ("S", 4, ["a"]), ("S", 5, ["a"]),
        ("S", 7, [None] * 5), ("S", 9, [None, "z", "z"]), ("S", 10, [None, "z", "z"]),
    ]


@pytest.mark.parametrize("encoding", ["utf-8", "utf-8-sig", "utf-16", "utf-16-le", "utf-16-be"])
def test_merged_cells_are_found_in_every_encoding(encoding):
    """Also where the word lies across two of the chunks that are looked at."""
    main = "http://schemas.openxmlformats.org/spreadsheetml/2006/main"
    declared = f'<?xml version="1.0" encoding="{"utf-8" if encoding.startswith("utf-8") else "utf-16"}"?>'
    for pad in (0, (1 << 20) - 230, (1 << 20) - 222):
        sheet = f'{declared}<worksheet xmlns="{main}"><sheetData><row r="1"><c r="AB1" t="inlineStr"><is><t>{"x" * pad}</t></is></c></row></sheetData><mergeCells><mergeCell ref="AB1:AB2"/></mergeCells></worksheet>'
        book = f'<workbook xmlns="{main}"><sheets><sheet name="S" sheetId="1"/></sheets></workbook>'
        data = sheet.encode(encoding)
        got = list(workbook(zipped({"xl/workbook.xml": book, "xl/worksheets/sheet1.xml": data})))
        assert [(r, len(c), len(c[27])) for _, r, c in got] == [(1, 28, pad), (2, 28, pad)]
