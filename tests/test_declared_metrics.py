"""Declarations are refused where they can't be compiled; one scan a source; cents are rounded once."""

import pytest
from pyspark.sql import functions as F

from saldo.operators import metrics

BASE = {"id": "m", "source": "s", "value": {"op": "sum", "of": ["v"]}}


def spine(spark, rows):
    df = spark.createDataFrame(rows, "k string, store string, platform string, on date, net double".replace("on date", "on_ string")).withColumn("on_", F.to_date("on_"))
    return metrics.Spine(df, "k", ["store", "platform"], "platform", "on_", ["store", "net"], "net")


def source(spark, rows):
    return spark.createDataFrame(rows, "k string, v double, store string, platform string, at string").withColumn("at", F.to_date("at"))


def got(df):
    return {tuple(r)[:3]: [None if x is None else float(x) for x in tuple(r)[3:]] for r in df.collect()}


@pytest.mark.parametrize("bad", [{"kind": "x"}, {"allocate": "odd"}, {"source": "none"}, {}])
def test_refused(spark, bad):
    m = BASE | bad | ({"link": "k"} if bad else {})
    with pytest.raises(metrics.MetricError):
        metrics.compiled([m], {"s": source(spark, [("a", 1.0, "x", "P", "2024-01-01")])}, spine(spark, [("a", "x", "P", "2024-01-01", 1.0)]))
    with pytest.raises(metrics.MetricError, match="unique"):
        metrics.compiled([BASE, BASE], {}, None)


def test_allocations_platforms_times_and_lost_money(spark):
    lines = [("a", "x", "P", "2024-01-05", 30.0), ("a", "y", "Q", "2024-01-05", 10.0), ("b", "x", "P", "2024-02-01", 0.0), ("b", "x", "P", "2024-02-01", 0.0)]
    money = [("@a", 100.0, "z", "P", "2024-03-01"), ("b", 5.0, "z", "Q", "2024-03-02"), ("lost", 7.0, "z", "P", "2024-04-01"), (None, 1.0, "z", "P", "2024-04-01")]
    declared = [
        BASE | {"id": "even", "link": "k", "allocate": "even"},
        BASE | {"id": "ratio", "link": "k", "allocate": "ratio", "by_platform": {"Q": {"allocate": None, "sign": -1}}},
        BASE | {"id": "own", "link": "k", "time": "at", "by_platform": {"Q": {"disabled": True}}},
        BASE | {"id": "direct", "time": "at", "platform": "P", "sign": -1},
    ]
    out = got(metrics.compiled(declared, {"s": source(spark, money)}, spine(spark, lines)))
    assert out == {
        ("x", "P", "2024-01"): [50.0, 75.0, 0.0, 0.0],
        ("y", "Q", "2024-01"): [50.0, 0.0, 0.0, 0.0],
        ("x", "P", "2024-02"): [5.0, 5.0, 0.0, 0.0],
        ("x", "P", "2024-03"): [0.0, 0.0, 105.0, 0.0],
        ("y", "Q", "2024-03"): [0.0, 0.0, 0.0, 0.0],
        (None, None, None): [8.0, 8.0, 0.0, 0.0],
        (None, None, "2024-04"): [0.0, 0.0, 8.0, 0.0],
        ("z", "P", "2024-03"): [0.0, 0.0, 0.0, -100.0],
        ("z", "Q", "2024-03"): [0.0, 0.0, 0.0, 0.0],
        ("z", "P", "2024-04"): [0.0, 0.0, 0.0, -8.0],
    }


def test_each_source_is_scanned_once(spark, tmp_path):
    source(spark, [("a", 1.0, "x", "P", "2024-01-01")]).write.parquet(str(tmp_path / "s"))
    frame = spark.read.parquet(str(tmp_path / "s"))
    declared = [BASE | {"id": "one", "link": "k"}, BASE | {"id": "two", "link": "k", "allocate": "even", "where": [{"column": "platform", "op": "eq", "value": "P"}]}]
    plan = metrics.compiled(declared, {"s": frame}, spine(spark, [("a", "x", "P", "2024-01-01", 1.0)]))._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Relation [") == 1


def test_cents_are_rounded_once(spark):
    sums = spark.sql("SELECT 'P' AS platform, CAST(0.004995 AS DECIMAL(38,6)) AS a, CAST(1.004999 AS DECIMAL(38,6)) AS b")
    row = metrics.stated(sums, ["a", "b"], [{"id": "c", "op": "add", "of": ["a", "b"]}, {"id": "d", "op": "negate", "of": ["a"], "applies": ["Q"]}], "platform").first()
    assert [str(row["a"]), str(row["b"]), str(row["c"]), row["d"]] == ["0.00", "1.00", "1.01", None]
