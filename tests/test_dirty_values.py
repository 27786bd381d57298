"""Dirty numbers, dates, keys and months, one by one, and row numbers of a large table."""

import datetime
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from saldo.functions import text
from saldo.operators import dedupe

DATES = {
    "2024-01-05 10:20:30": "2024-01-05", "2024-1-5 9:05": "2024-01-05", "2024/1/5": "2024-01-05", "1998/12/31 23:59:59": "1998-12-31", "20240105": "2024-01-05", "20240105102030": "2024-01-05",
    "2024年1月5日": "2024-01-05", "2024.01.05": "2024-01-05", "1999年2月3日": "1999-02-03", "2024-01-05T10:20:30+08:00": "2024-01-05", "2024-01-05T10:20:30Z": "2024-01-05", "45296": "2024-01-05", "45296.5": "2024-01-05",
    "2024-01-05 25:00": "2024-01-05", "2024 / 1 / 5 x": "2024-01-05", "1999 - 1 - 5 x": None, "see 2024-01-05": None, "20240230": None, "2024-02-30": None, "20240105102099": None, "": None, "-": None, "abc": None, None: None,
}
NUMBERS = {"¥1,234.50": "1234.5", "(12.5)": "-12.5", "（3）": "-3", "12%": "0.12", "(50%)": "-0.5", " 7 元": "7", "1e3": "1000", "-0.25": "-0.25", "": None, "--": None, "N/A": None, "x1": None, "1.2.3": None, "()": None, None: None}
KEYS = {"@123.0": "123", " '12 3' ": "123", "A1.0": "A1.0", "@@x": "x", "": None, "@": None, '"5"': "5", "1.00": "1.00", None: None}
PERIODS = {"2024-05 x": "2024-05", "a202405": "2024-05", "2024年5月": "2024-05", "shop2606.csv": "2026-06", "24年5月": "2024-05", "2024_1": "2024-01", "20241399": None, "x": None}


def column(spark, values, make):
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v string").select("i", make("v").alias("o")).collect()
    return [r["o"] for r in sorted(rows, key=lambda r: r["i"])]


@pytest.mark.parametrize(
    ("make", "cases", "read"),
    [
        (text.parse_date, DATES, datetime.date.fromisoformat),
        (text.parse_number, NUMBERS, Decimal),
        (text.norm_key, KEYS, str),
        (text.period_in, PERIODS, str),
    ],
)
def test_values(spark, make, cases, read):
    got = column(spark, list(cases), make)
    assert dict(zip(cases, got, strict=True)) == {k: None if v is None else read(v) for k, v in cases.items()}


def test_numbers_of_a_large_table(spark):
    wide = spark.range(1_500_000).select((F.col("id") * 48271 % 1_500_007).alias("k"), F.col("id"), F.repeat(F.lit("x"), 60).alias("fill"))
    out = dedupe.numbered(wide, ["k", "id"], parts=40)
    told = out.agg(F.count("*").alias("n"), F.count_distinct("row_no").alias("d"), F.min("row_no").alias("low"), F.max("row_no").alias("high")).first()
    assert tuple(told) == (1_500_000, 1_500_000, 1, 1_500_000)
    assert out.join(out.select((F.col("row_no") - 1).alias("row_no"), F.col("k").alias("after")), "row_no").where("k > after").isEmpty()
