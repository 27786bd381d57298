"""Sources, the guarded SQL surface, text helpers and streams."""

import io
import zipfile

import pytest
from pyspark.sql import functions as F

from saldo.functions import text
from saldo.functions.money import cents, half_even, ratio
from saldo.functions.predicates import PredicateError, checked
from saldo.operators import allocate, statement
from saldo.sources.guard import GuardError, run_guarded
from saldo.sources.artifacts import write_artifact
from saldo.sources.tables import ArchiveError, bound, members, read_csv, read_sheets
from saldo.streaming import ledger

SHEET = """<worksheet xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"><sheetData>
<row r="1"><c r="A1" t="s"><v>0</v></c><c r="B1" t="s"><v>1</v></c></row><row r="2"><c r="A2" t="inlineStr"><is><t>k1</t></is></c><c r="B2"><v>12.5</v></c></row>
<row r="3"><c r="B3"><v>7</v></c></row><row r="4"><c r="A4" t="inlineStr"><is><t> - </t></is></c></row></sheetData><mergeCells><mergeCell ref="A2:A3"/></mergeCells></worksheet>"""


def zipped(files):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        for name, data in files.items():
            z.writestr(name, data)
    return out.getvalue()


def xlsx():
    book = '<workbook xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"><sheets><sheet name="May" sheetId="1"/></sheets></workbook>'
    strings = '<sst xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"><si><t>key</t></si><si><t>amount</t></si></sst>'
    return zipped({"xl/workbook.xml": book, "xl/sharedStrings.xml": strings, "xl/worksheets/sheet1.xml": SHEET})


def test_sheets_and_archives(spark, tmp_path):
    (tmp_path / "a.xlsx").write_bytes(xlsx())
    (tmp_path / "b.zip").write_bytes(zipped({"in.csv": "#note\nkey;amount\nk9;3\n", "deep.zip": zipped({"x.xlsx": xlsx()})}))
    rows = {(r["file"], r["row_no"]): r["cells"] for r in read_sheets(spark, str(tmp_path)).collect()}
    assert rows["a.xlsx", 3] == ["k1", "7"] and ("a.xlsx", 4) not in rows
    assert rows["b.zip!in.csv", 3] == ["k9", "3"] and rows["b.zip!deep.zip!x.xlsx", 2] == ["k1", "12.5"]
    named = bound(read_sheets(spark, str(tmp_path / "a.xlsx")), {"key": 0, "amount": 1}).where("row_no = 2").first()
    assert (named["key"], named["amount"]) == ("k1", "12.5")
    with pytest.raises(ArchiveError):
        list(members(zipped({"../evil.csv": "x"})))
    with pytest.raises(ArchiveError):
        list(members(zipped({"bomb.csv": "0" * 10**6})))


def test_csv_quirks(spark, tmp_path):
    (tmp_path / "a.csv").write_bytes("#账单\n订单号;金额\n\t123 ;1\n -;--\n".encode("gb18030"))
    rows = read_csv(spark, str(tmp_path / "a.csv")).collect()
    assert [(r["订单号"], r["金额"]) for r in rows] == [("123", "1")]


def test_artifact_is_addressed_by_content(spark, tmp_path):
    one = spark.createDataFrame([(1, "a"), (2, None)], "k int, v string")
    path, digest = write_artifact(one, str(tmp_path))
    assert spark.read.parquet(path).count() == 2 and write_artifact(one.orderBy(F.desc("k")), str(tmp_path))[1] == digest
    assert write_artifact(one.union(one), str(tmp_path))[1] != digest


@pytest.mark.parametrize("sql", ["DROP TABLE certified", "SELECT * FROM other", "WITH a AS (SELECT 1) SELECT * FROM a", "SELECT * FROM certified; SELECT 1", "SELECT reflect('java.lang.System', 'exit', 1)", "SELECT * FROM certified WHERE k IN (SELECT k FROM other)", "INSERT INTO certified SELECT 1", "SELECT * FROM parquet.`/etc`"])
def test_guard_refuses(spark, sql):
    with pytest.raises(GuardError):
        run_guarded(spark, sql, {"certified": spark.range(3).toDF("k")})


def test_guard_limits(spark):
    assert run_guarded(spark, "SELECT k FROM certified UNION ALL SELECT k FROM certified", {"certified": spark.range(30).toDF("k")}, 10).count() == 10


def one(spark, value, made):
    return spark.createDataFrame([(value,)], "c string").select(made(F.col("c")).alias("x")).first()["x"]


@pytest.mark.parametrize(("dirty", "want"), [("1,234.56", "1234.5600"), ("¥12元", "12.0000"), ("(3.10)", "-3.1000"), ("12%", "0.1200"), ("HSC25016", None), ("-", None), ("", None), (None, None), ("  7 ", "7.0000")])
def test_numbers(spark, dirty, want):
    got = one(spark, dirty, text.parse_number)
    assert (None if got is None else str(got)) == want


@pytest.mark.parametrize(("dirty", "want"), [("2026-5-1", "2026-05-01"), ("2026/05/01 10:20", "2026-05-01"), ("20260501", "2026-05-01"), ("2026年5月1日", "2026-05-01"), ("2026-05-01T10:20:30+08:00", "2026-05-01"), ("45000", "2023-03-15"), ("junk", None), ("", None)])
def test_dates(spark, dirty, want):
    got = one(spark, dirty, text.parse_date)
    assert (None if got is None else got.isoformat()) == want


@pytest.mark.parametrize(("dirty", "want"), [("@4356", "4356"), ("123.0", "123"), ("V1.0", "V1.0"), (' "9 ', "9"), ("@", None)])
def test_keys(spark, dirty, want):
    assert one(spark, dirty, text.norm_key) == want


def test_text_helpers(spark):
    assert one(spark, " 订单（号） ", text.fold_header) == "订单(号)"
    assert one(spark, "账单2024年5月", text.period_in) == "2024-05" and one(spark, "24年11月", text.period_in) == "2024-11" and one(spark, "none", text.period_in) is None
    assert one(spark, "订单".encode().decode("latin-1"), text.repaired) == "订单" and one(spark, "plain é", text.repaired) == "plain é"
    assert one(spark, "=1+1", text.guarded) == "'=1+1"


def test_rounding_and_ratio(spark):
    row = spark.sql("SELECT CAST('0.125' AS DECIMAL(20,4)) AS a, CAST('0.00005' AS DECIMAL(20,5)) AS b, CAST(1 AS DECIMAL(20,4)) AS one, CAST(0 AS DECIMAL(20,4)) AS zero")
    got = row.select(cents("a").alias("c"), half_even("b").alias("h"), ratio("one", "zero").alias("r")).first()
    assert str(got["c"]) == "0.13" and float(got["h"]) == 0.0 and got["r"] is None


def test_predicates_are_closed():
    with pytest.raises(PredicateError):
        checked({"field": "a", "op": "regex", "value": ".*"})
    with pytest.raises(PredicateError):
        checked({"all_of": [{"any_of": [{"none_of": [{"all_of": [{"field": "a", "op": "is_null"}]}]}]}]})


def test_statement_nulls_and_cycles(spark):
    totals = spark.createDataFrame([("s", "a", 5), ("s", "b", 2)], "store string, metric_id string, amount int").withColumn("amount", F.col("amount").cast("decimal(20,4)"))
    nodes = [{"id": "part", "op": "add", "of": ["a", "b"]}, {"id": "all", "op": "add", "of": ["a", "b"], "total": True}]
    missing = spark.createDataFrame([("s", "b")], "store string, metric_id string")
    row = statement.statement(totals, ["store"], ["a", "b"], nodes, missing).first()
    assert (row["part"], row["all"]) == (5, None)
    with pytest.raises(ValueError):
        statement.ordered([{"id": "x", "of": ["y"]}, {"id": "y", "of": ["x"]}], set())


def test_exact_allocation_adds_up(spark):
    lines = spark.createDataFrame([("o", i, w) for i, w in enumerate((1.0, 1.0, 1.0))] + [("z", i, 0.0) for i in range(3)], "k string, i int, w double").withColumn("total", F.lit("10").cast("decimal(20,4)"))
    rows = allocate.exact(lines, ["k"], "total", "w", ["i"]).collect()
    for key in "oz":
        parts = [float(r["allocated"]) for r in sorted(rows, key=lambda r: r["i"]) if r["k"] == key]
        assert parts == [3.3333, 3.3333, 3.3334]


def test_stream_equals_batch(spark, sf_dir, tmp_path):
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    events.repartition(4).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(events.schema).parquet(str(tmp_path / "in"))
    query = ledger.once(stream, ["event_id"], "ts", "60 days").writeStream.format("memory").queryName("seen_once").option("checkpointLocation", str(tmp_path / "c1")).trigger(availableNow=True).start()
    query.awaitTermination(60)
    assert spark.table("seen_once").count() == events.select("event_id").distinct().count()
    ledger.route_late(stream, "ts", "2023-12", str(tmp_path / "open"), str(tmp_path / "late"), str(tmp_path / "c2")).awaitTermination(60)
    assert spark.read.parquet(str(tmp_path / "open")).count() == events.count() and spark.read.parquet(str(tmp_path / "late")).count() == 0
