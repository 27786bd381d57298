"""Matching under a contract: every route, kind and status once, and what is refused."""

from decimal import Decimal

import pytest

from saldo.operators import contracts

THREE = {"code": "c", "version": "1", "sources": {"export": {"side": "order"}, "settlement": {"side": "platform"}, "extra": {"side": "platform", "required": False}, "bank": {"side": "cash"}}}
TWO = {**THREE, "mode": "platform_wallet", "sources": {k: v for k, v in THREE["sources"].items() if k != "bank"}}


def test_what_is_no_contract():
    for change, why in (({"code": ""}, "code"), ({"mode": "x"}, "no mode"), ({"mode": "platform_wallet"}, "requires"), ({"sources": {"a": {"side": "q"}}}, "no sides"), ({"sources": {"a": {"side": "order"}}}, "requires")):
        with pytest.raises(contracts.ContractError, match=why):
            contracts.checked({**THREE, **change})
    assert contracts.checked(TWO) and contracts.checked(THREE)


def test_orders_and_platform(spark):
    D = Decimal
    items = [
        ("same", "export", "two_sided", D(10)), ("same", "settlement", None, D(10)),
        ("near", "export", None, D("10.00")), ("near", "settlement", None, D(4)), ("near", "extra", None, D("6.01")),
        ("far", "export", None, D(1)), ("far", "export", None, D(2)), ("far", "settlement", None, D(7)),
        ("many", "export", None, D(1)), ("many", "export", None, None), ("many", "settlement", None, D(1)), ("many", "extra", None, D(0)),
        ("lone", "export", None, D(5)), ("legal", "settlement", "legal_single_sided", D(-3)), ("part", "settlement", "legal_single_sided", D(1)), ("part", "settlement", None, D(1)),
        ("out", "export", "excluded", D(9)), ("gone", "export", None, D(2)), ("gone", "settlement", "excluded", D(2)), (None, "export", None, D(1)),
        ("cash", "bank", None, D(1)),
    ]
    table = spark.createDataFrame(items, "business_key string, source_type string, route string, amount decimal(20,4)")
    got = {r["business_key"]: (r["kind"], r["missing"], r["status"], r["difference"], r["exposure"]) for r in contracts.order_platform(table, THREE, route="route").collect()}
    assert got == {
        "same": ("1:1", "", "balanced", 0, 0), "near": ("1:N", "", "balanced", D("0.01"), 0), "far": ("N:1", "", "amount_mismatch", 4, 4), "many": ("N:M", "", "balanced", 0, 0),
        "lone": ("left_only", "platform", "missing_side", -5, 5), "legal": ("right_only", "order", "legal_single_sided", -3, 0), "part": ("right_only", "order", "missing_side", 2, 2),
        "gone": ("left_only", "platform", "missing_side", -2, 2), None: ("left_only", "platform", "missing_side", -1, 1),
    }
    with pytest.raises(Exception, match="no place for bank"):
        contracts.order_platform(table, TWO, route="route").collect()
    with pytest.raises(Exception, match="no route"):
        contracts.order_platform(table.selectExpr("*", "'x' as way"), THREE, route="way").collect()
    with pytest.raises(Exception, match="no place for (export|settlement|extra) as cash"):
        contracts.order_platform(table.selectExpr("*", "'cash' as at"), THREE, side="at").collect()
    assert contracts.order_platform(table.limit(0), THREE).collect() == []
    assert [tuple(r) for r in contracts.repeated_items(table, "route").orderBy("route").collect()][1:] == [("excluded", 2), ("legal_single_sided", 2)]


def test_batches_and_cash(spark):
    D = Decimal
    items = [
        ("k", "settlement", "b1", None, D(5)), ("k", "bank", None, "c1", D(5)),
        ("k", "settlement", "b2", None, D(5)), ("k", "bank", None, "c2", D(2)), ("k", "bank", None, "c3", D(3)),
        ("k", "settlement", "b4", None, D(5)), ("k", "extra", "b5", None, D(1)), ("k", "bank", None, "c4", D(7)),
        ("k", "settlement", "b6", None, D(1)), ("k", "settlement", "b7", None, D(1)), ("k", "bank", None, "c6", D(2)),
        ("k", "settlement", "b8", None, D(1)), ("k", "bank", None, "c8", D(1)),
        ("k", "settlement", "b9", None, D(-4)), ("k", "bank", None, "c9", D(6)),
        ("k1", "settlement", " ", None, D(3)), ("k1", "bank", None, None, D(2)), ("k", "export", "b1", "c1", D(100)), ("k", "settlement", "b0", None, D(8)),
    ]
    table = spark.createDataFrame(items, "business_key string, source_type string, settlement_batch_key string, cash_bridge_key string, amount decimal(20,4)")
    bridges = spark.createDataFrame([("b1", "c1"), ("b2", "c2"), ("b2", "c3"), ("b4", "c4"), ("b5", "c4"), ("b6", "c6"), ("b7", "c6"), ("b7", "c7"), ("b8", "c8"), ("b8", "c8"), ("b0", "c0"), (None, "c9"), ("b9", " ")], "settlement_batch_key string, cash_bridge_key string")
    got = {r["component"]: (r["kind"], r["bridges"], r["missing"], r["status"], r["difference"], r["exposure"]) for r in contracts.platform_cash(table, bridges, THREE).collect()}
    assert got == {
        "b:b1": ("1:1", 1, "", "linked", 0, 0), "b:b2": ("1:N", 2, "", "linked", 0, 0), "b:b4": ("N:1", 2, "", "cash_amount_mismatch", 1, 1), "b:b6": ("N:M", 3, "", "ambiguous_cash_bridge", 0, 0),
        "b:b8": ("1:1", 2, "", "ambiguous_cash_bridge", 0, 0), "b:b9": (None, 0, "cash", "missing_cash_bridge", 4, 4), "c:c9": (None, 0, "platform", "missing_cash_bridge", 6, 6),
        "p:k1": (None, 0, "cash", "missing_cash_bridge", -3, 3), "k:k1": (None, 0, "platform", "missing_cash_bridge", 2, 2), "b:b0": ("1:1", 1, "cash", "missing_side", -8, 8),
    }
    with pytest.raises(contracts.ContractError):
        contracts.platform_cash(table, bridges, TWO)


def test_rules_between_sources(spark):
    D = Decimal
    mine = spark.createDataFrame([("a", "k1", D(1)), ("a", "k1", D(2)), ("a", "k2", D(3)), ("a", None, D(4)), ("b", "k1", D(5)), (None, "k9", D(1))], "s string, k string, v decimal(20,4)")
    theirs = spark.createDataFrame([("a", "k1", D("10.01")), ("a", "k3", None), (None, "k9", D(2)), ("z", "k1", D(1))], "s string, q string, v decimal(20,4)")
    rules = [{"mode": "required_source"}, {"mode": "control_total", "field": "v"}, {"mode": "business_key", "field": "k", "dependency_field": "q", "allowed_unmatched": 1}, {"mode": "business_key", "field": "k", "dependency_field": "q"}, {"mode": "control_total", "field": "v", "applicable": False}]
    got = {(r["s"], r["rule"]): (r["status"], r["actual"], r["expected"], r["difference"]) for r in contracts.cross_source(mine, theirs, rules, ["s"]).collect()}
    none = (None, None, None)
    assert got == {
        ("a", 0): ("passed", *none), ("a", 1): ("passed", 10, D("10.01"), D("-0.01")), ("a", 2): ("passed", 1, 2, 1), ("a", 3): ("failed", 1, 2, 1), ("a", 4): ("not_applicable", *none),
        ("b", 0): ("pending", *none), ("b", 1): ("pending", *none), ("b", 2): ("pending", *none), ("b", 3): ("pending", *none), ("b", 4): ("not_applicable", *none),
        (None, 0): ("passed", *none), (None, 1): ("failed", 1, 2, -1), (None, 2): ("passed", 1, 1, 0), (None, 3): ("passed", 1, 1, 0), (None, 4): ("not_applicable", *none),
    }
    with pytest.raises(contracts.ContractError):
        contracts.cross_source(mine, theirs, [{"mode": "x"}], ["s"])
