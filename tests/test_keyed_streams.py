"""State by key: any cut of a stream into batches gives what the batch operators give."""

import random

import pytest
from pyspark.sql import functions as F

from saldo.operators import dedupe, periods
from saldo.plans.streams import streamed
from saldo.streaming import keyed

LOG = "account string, at timestamp, action string, id string"


@pytest.mark.parametrize("cuts", [(10,), (3, 7), (1, 2, 5, 6)])
def test_first_source_in_any_cut(spark, cuts):
    pick = random.Random(len(cuts))
    rows = [(i, pick.choice("abc"), pick.choice(["x", "y", None]), pick.randrange(4)) for i in range(10)] + [(10, "z", None, 1), (11, "z", None, 1)]
    df = spark.createDataFrame(rows, "n int, src string, what string, v int")
    edges = [0, *cuts, 12]
    parts = [df.where((F.col("n") >= a) & (F.col("n") < b)).repartition(3) for a, b in zip(edges, edges[1:], strict=False)]
    got = streamed(parts, lambda s: keyed.first_source(s, ["what", "v"], "src", ["n"]))
    want = dedupe.incremental(df, ["what", "v"], "src", ["n"])
    assert sorted(r["n"] for r in got.collect()) == sorted(r["n"] for r in want.collect())


def test_period_log_in_any_order(spark):
    pick = random.Random(4)
    rows = [(pick.choice("pqr"), f"2024-05-{pick.randrange(1, 29):02} 10:00:00", pick.choice(["revise", "adjust", "preclose", "finalize"]), pick.choice(["1", "2", "3", None])) for _ in range(120)]
    df = spark.createDataFrame(rows, "account string, at string, action string, id string").withColumn("at", F.col("at").cast("timestamp"))
    want = {r["account"]: tuple(r)[1:] for r in periods.period_states(df, ["account"]).collect()}
    numbered = [r + (i,) for i, r in enumerate(df.collect())]
    pick.shuffle(numbered)
    parts = [spark.createDataFrame([tuple(r)[:4] for r in numbered[i::3]], LOG) for i in range(3)]
    out = streamed(parts, lambda s: keyed.period_log(s, ["account"]), "update")
    last = out.groupBy("account").agg(F.max_by(F.struct("state", "version", "revisions", "restatements", "refused"), "batch").alias("s")).select("account", "s.*")
    assert {r["account"]: tuple(r)[1:] for r in last.collect()} == want


class Held:
    """A list state in memory that counts its calls."""

    def __init__(self):
        self.elements, self.calls = [], 0

    def get(self):
        self.calls += 1
        return iter(list(self.elements))

    def appendList(self, elements):  # noqa: N802
        self.calls += 1
        self.elements += elements

    def put(self, elements):
        self.calls += 1
        self.elements = list(elements)


class Handle:
    def __init__(self):
        self.held = Held()

    def getListState(self, *_):  # noqa: N802
        return self.held


def test_a_batch_reads_and_writes_a_bucket_of_contents_once():
    from pyspark.sql import Row
    from pyspark.sql import types as T

    handle, processor = Handle(), keyed.FirstSource("src", ["n"], ["n", "src"], T.StringType(), None)
    processor.init(handle)
    first = [Row(n=i, src="ab"[i % 2], _print=str(i // 2)) for i in range(200)]
    assert [r["n"] for r in processor.handleInputRows((0,), iter(first), None)] == list(range(0, 200, 2)) and handle.held.calls == 2
    second = [Row(n=i, src="b", _print=str(i)) for i in range(50, 150)]
    assert [r["n"] for r in processor.handleInputRows((0,), iter(second), None)] == list(range(100, 150)) and handle.held.calls == 4
    assert not list(processor.handleInputRows((0,), iter(second[:50]), None)) and handle.held.calls == 5


def test_first_source_of_few_buckets(spark):
    rows = [(i, "abc"[i * 7 % 3], i % 40, None if i % 5 else 1) for i in range(160)]
    df = spark.createDataFrame(rows, "n int, src string, what int, v int")
    parts = [df.where((F.col("n") >= a) & (F.col("n") < a + 80)) for a in (0, 80)]
    got = streamed(parts, lambda s: keyed.first_source(s, ["what", "v"], "src", ["n"], buckets=3))
    want = dedupe.incremental(df, ["what", "v"], "src", ["n"])
    assert sorted(r["n"] for r in got.collect()) == sorted(r["n"] for r in want.collect())


def test_a_batch_reads_and_writes_a_bucket_of_periods_once(monkeypatch):
    from pyspark.sql import Row

    monkeypatch.setattr(keyed, "ELEMENTS", 4)
    pick = random.Random(9)
    handle, processor = Handle(), keyed.PeriodLog(["account"], None)
    processor.init(handle)
    logs: dict[int, dict] = {}
    for batch in range(14):
        rows = [Row(account=pick.randrange(30), at=pick.randrange(9), action=pick.choice(["revise", "adjust", "preclose", "finalize"]), id=pick.choice(["1", "2", None])) for _ in range(50)]
        for r in rows:
            keyed.count(logs.setdefault(r["account"], {}), [(r["action"], r["at"], r["id"], 1)])
        got = {r["account"]: tuple(r)[1:] for r in processor.handleInputRows((0,), iter([Row(**r.asDict(), _period=f"p{r['account']}") for r in rows]), None)}
        assert got == {r["account"]: keyed.told(logs[r["account"]]) for r in rows}
        assert handle.held.calls == 2 * (batch + 1) and len(handle.held.elements) <= 4


def test_period_log_of_few_buckets_and_null_keys(spark):
    pick = random.Random(5)
    rows = [(pick.choice(["p", "q", "", None]), pick.choice([1, None]), f"2024-05-{pick.randrange(1, 29):02} 10:00:00", pick.choice(["revise", "adjust", "preclose", "finalize"]), str(pick.randrange(3))) for _ in range(200)]
    df = spark.createDataFrame(rows, "account string, shop int, at string, action string, id string").withColumn("at", F.col("at").cast("timestamp"))
    want = {tuple(r)[:2]: tuple(r)[2:] for r in periods.period_states(df, ["account", "shop"]).collect()}
    parts = [df.where(F.xxhash64(*df.columns) % 2 == 0), df.where(F.xxhash64(*df.columns) % 2 != 0)]
    out = streamed(parts, lambda s: keyed.period_log(s, ["account", "shop"], buckets=2), "update")
    last = out.groupBy("account", "shop").agg(F.max_by(F.struct("state", "version", "revisions", "restatements", "refused"), "batch").alias("s")).select("account", "shop", "s.*")
    assert {tuple(r)[:2]: tuple(r)[2:] for r in last.collect()} == want and len(want) == 8
