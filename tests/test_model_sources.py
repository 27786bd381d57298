"""The model's files, inventories, evidence, and what is decided on the driver."""

import datetime
import hashlib

import pytest
from pyspark.sql import functions as F

from saldo.functions.rules import looked_up
from saldo.operators import allocate, asof, audit, profile, reconcile
from saldo.sources import guard, model
from saldo.streaming import ledger


def test_typed_tables(spark, tmp_path):
    (tmp_path / "dictionary.csv").write_text("﻿platform, raw ,major,minor,more\n* , fee ,cost,,x\nweb,fee,cost,web fee,y\n", encoding="utf-8")
    (tmp_path / "overhead.csv").write_text("period,amount\n2024-01, 12.50 \n2024-02,x\n")
    rows = {tuple(r) for r in model.model_table(spark, str(tmp_path), "dictionary").collect()}
    assert rows == {("*", "fee", "cost", None), ("web", "fee", "cost", "web fee")}
    assert [(r[0], None if r[1] is None else float(r[1])) for r in model.model_table(spark, str(tmp_path), "overhead").orderBy("period").collect()] == [("2024-01", 12.5), ("2024-02", None)]
    (tmp_path / "commission.csv").write_text("product_id\n1\n")
    with pytest.raises(ValueError, match="lacks"):
        model.model_table(spark, str(tmp_path), "commission")


def test_lookup_takes_the_platform_first_and_one_row(spark):
    words = spark.createDataFrame([("web", "fee", "b"), ("web", "fee", "a"), ("*", "fee", "z"), ("*", "tax", "t")], "platform string, raw string, major string")
    rows = spark.createDataFrame([("web", "fee"), ("app", "fee"), ("app", "tax"), ("app", "none")], "p string, label string")
    assert {(r["p"], r["label"]): r["major"] for r in looked_up(rows, words, "label", "p", ["major"]).collect()} == {("web", "fee"): "a", ("app", "fee"): "z", ("app", "tax"): "t", ("app", "none"): None}


def test_inventory_and_hashes(spark, tmp_path):
    (tmp_path / "a.csv").write_bytes(b"one")
    (tmp_path / "b.txt").write_bytes(b"two!")
    later = F.current_timestamp() + F.expr("INTERVAL 2 MINUTES")
    rows = {r["name"]: (r["length"], r["stable"]) for r in model.inventory(spark, str(tmp_path), quiet_seconds=60, now=later).collect()}
    assert rows == {"a.csv": (3, True), "b.txt": (4, True)}
    assert {r["name"]: r["stable"] for r in model.inventory(spark, str(tmp_path), "*.csv", quiet_seconds=3600).collect()} == {"a.csv": False}
    assert {r["sha256"] for r in model.hashed(spark, str(tmp_path)).collect()} == {hashlib.sha256(b).hexdigest() for b in (b"one", b"two!")}


def test_evidence_is_kept_once_and_seen_in_its_neighbourhood(spark, tmp_path):
    facts = spark.createDataFrame([("s", "2024-01", 1), ("s", "2024-02", 2)], "store string, period string, v int")
    for _ in range(2):
        model.keep_evidence(facts, str(tmp_path / "e"), "r1")
    assert spark.read.parquet(str(tmp_path / "e")).count() == 2
    rows = spark.createDataFrame([("f", None if i % 2 else "s", i, ["x"] * 300) for i in range(40)], "file string, sheet string, row_no int, cells array<string>")
    near = model.evidence_around(rows, "f", "s", 20, 3).collect()
    assert sorted((r["row_no"], r["hit"]) for r in near) == [(18, False), (20, True), (22, False)] and len(near[0]["cells"]) == 200


def test_rows_are_appended_by_name(spark):
    spark.sql("DROP TABLE IF EXISTS appended_rows")
    model.appended(spark.createDataFrame([(1, "a")], "i int, t string"), "appended_rows")
    model.appended(spark.createDataFrame([("b", 2)], "t string, i int"), "appended_rows")
    assert sorted(map(tuple, spark.table("appended_rows").collect())) == [(1, "a"), (2, "b")]
    spark.sql("DROP TABLE appended_rows")


def test_aliases(spark):
    df = spark.createDataFrame([(1, 2, 3)], "`Order No` int, paid int, other int")
    assert model.renamed(df, {"order_id": ["order id", "OrderNo"], "paid": ["sum"], "lost": ["none"]}).columns == ["order_id", "paid", "other"]


def test_rules_and_checks_are_validated():
    assert model.rule_checked({"id": "a", "kind": "classify", "column": "c", "how": "equals", "value": "x", "major": "m"})
    for bad in ({"id": "a", "kind": "other"}, {"kind": "map", "values": {}}, {"id": "a", "kind": "route", "column": "c", "route": "x"}, {"id": "a", "kind": "classify", "how": "always"}):
        with pytest.raises(ValueError):
            model.rule_checked(bad)
    for bad in ({"id": "a", "kind": "x"}, {"kind": "tie_out"}, {"id": "a", "kind": "tie_out", "left": ["x"]}):
        with pytest.raises(audit.CheckError):
            audit.checked(bad)


def test_roles_proposed():
    columns = [{"name": "Order ID", "kind": "id", "rows": 10, "filled": 10}, {"name": "Paid amount", "kind": "number", "rows": 10, "filled": 9}, {"name": "Amount", "kind": "text", "rows": 10, "filled": 10}]
    roles = {"order": {"words": ["orderid"], "kind": "id"}, "paid": {"words": ["amount", "paidamount"], "kind": "number"}}
    got = profile.propose(columns, roles)
    assert got["order"] == ("Order ID", 1.0) and got["paid"][0] == "Paid amount" and len(got) == 2


def test_purposes_and_kinds_of_queries():
    assert profile.purpose([" Order ID", "paid amount"]) == ("orders", "high")
    assert profile.purpose(["order_id", "paid_amount", "income"]) == ("needs_confirmation", "ambiguous")
    assert profile.purpose(["x"], "shipping") == ("shipping", "medium") and profile.purpose(["x"]) == ("unknown", "low")
    assert profile.kinds_of_query(" 1234567890123 ") == ["order", "text"] and profile.kinds_of_query("-1,200.50") == ["amount", "text"] and profile.kinds_of_query(" ") == []


def test_cash_bridges_and_tiers_and_health(spark):
    edges = spark.createDataFrame([("b1", "c1"), ("b2", "c2"), ("b2", "c3"), ("b4", "c5"), ("b5", "c5"), ("b5", "c6")], "batch string, cash string")
    told = reconcile.cash_bridges(edges, "batch", "cash")
    assert told.count() > 0
    shares = spark.createDataFrame([(0.5,), (None,), (-0.1,), (1.5,)], "s double")
    assert tuple(allocate.ratio_health(shares, "s").first()) == (1, 1, 1)
    assert callable(asof.best_tier)


def test_a_guarded_statement_leaves_no_view(spark):
    spark.range(3).createOrReplaceTempView("certified")
    rows = guard.run_guarded(spark, "SELECT v FROM certified", {"certified": spark.createDataFrame([(7,)], "v int")}).collect()
    assert [r["v"] for r in rows] == [7] and spark.table("certified").count() == 3
    spark.catalog.dropTempView("certified")


def test_timing(spark):
    day = datetime.datetime
    rows = spark.createDataFrame([(day(2024, 1, 5), day(2024, 1, 9)), (day(2024, 1, 31), day(2024, 2, 1)), (day(2024, 3, 1), day(2024, 2, 28))], "event timestamp, arrival timestamp")
    assert [r[0] for r in rows.select(ledger.timing("event", "arrival")).collect()] == ["same_period", "late_arrival", "cross_period"]


def test_late_rows_and_buckets_of_a_stream(spark, tmp_path):
    rows = [(datetime.datetime(2024, m, 3, h), f"k{m}{h}", float(m)) for m in (1, 2, 3) for h in (1, 1, 2)]
    spark.createDataFrame(rows, "at timestamp, k string, v double").write.parquet(str(tmp_path / "in"))
    stream = lambda: spark.readStream.schema("at timestamp, k string, v double").parquet(str(tmp_path / "in"))
    ledger.route_late(stream(), "at", "2024-02", str(tmp_path / "open"), str(tmp_path / "late"), str(tmp_path / "c1")).awaitTermination()
    assert spark.read.parquet(str(tmp_path / "open")).count() == 3 and spark.read.parquet(str(tmp_path / "late")).count() == 6
    query = ledger.buckets(stream(), "at", "v", "1 hour", "1 day").writeStream.format("memory").queryName("hours").outputMode("complete").option("checkpointLocation", str(tmp_path / "c2")).trigger(availableNow=True).start()
    query.awaitTermination()
    assert sorted(r["n"] for r in spark.table("hours").collect()) == [1, 1, 1, 2, 2, 2]
