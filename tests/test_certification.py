"""Certified statements: totals, products and residuals of small facts, and the gate."""

from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from saldo.operators import statement

COMPONENTS = ("sales", "refund", "cost")


def told(spark, facts):
    table = spark.createDataFrame(facts, "store string, sku string, metric string, amount decimal(20,4)")
    return {(r["store"], r["sku_key"]): r for r in statement.certified(table, ["store"], "sku", "metric", "amount", COMPONENTS).collect()}


def test_store_is_products_and_residual(spark):
    D = Decimal
    facts = [("a", "p", "sales", D(10)), ("a", "p", "refund", D(-1)), ("a", "p", "cost", D(-4)), ("a", "q", "sales", D(5)), ("a", None, "cost", D(-2)), ("a", " ", "cost", D(1)), ("a", "p", "other", D(99))]
    facts += [("b", "p", m, D(1)) for m in COMPONENTS] + [("c", None, "sales", D(3)), (None, "p", "sales", None)]
    got = told(spark, facts)
    assert set(got) == {("a", "__store_total__"), ("a", "p"), ("a", "q"), ("a", "__unassigned__"), ("b", "__store_total__"), ("b", "p"), ("c", "__store_total__"), ("c", "__unassigned__"), (None, "__store_total__"), (None, "p")}
    whole = got["a", "__store_total__"]
    assert (whole["sales"], whole["refund"], whole["cost"], whole["profit"], whole["missing"]) == (15, -1, -5, 9, "")
    assert (whole["products"], whole["complete_products"], whole["residual_cost"], whole["residual_sales"], whole["ready"]) == (2, 1, -1, 0, False)
    assert (got["a", "q"]["profit"], got["a", "q"]["missing"], got["a", "q"]["ready"], got["a", "p"]["profit"]) == (None, "refund,cost", None, 5)
    assert got["a", "__unassigned__"]["profit"] is None and got["a", "__unassigned__"]["cost"] == -1
    assert got["b", "__store_total__"]["ready"] and not got["c", "__store_total__"]["ready"] and got["c", "__store_total__"]["products"] == 0
    assert got[None, "p"]["sales"] == 0 and got[None, "__store_total__"]["missing"] == "refund,cost"
    for store in ("a", "b", "c", None):
        for m in COMPONENTS:
            parts = [r[m] for (s, k), r in got.items() if s == store and k != "__store_total__" and r[m] is not None]
            assert sum(parts) == (got[store, "__store_total__"][m] or 0)
    assert told(spark, []) == {}


def test_products_of_other_facts(spark):
    rows = [
        ("s", "O1", None, " p "), ("s", "o2", None, "p"), ("s", "O2 ", None, "q"), ("s", None, None, "r"),
        ("f1", " o1", None, "z"), ("f2", "o2", None, None), ("f3", "o2", None, "q"), ("f4", "o9", "O1", "r"), ("f5", "o1", "o2", None), ("f6", None, None, "r"), ("f7", "", "", None),
    ]
    table = spark.createDataFrame(rows, "metric string, order_id string, sub string, sku string")
    got = {(r["metric"], r["order_id"]): r["sku"] for r in statement.with_products(table, "order_id", "metric", "sku", "s", ["sub"]).collect()}
    assert len(got) == len(rows) and [got["s", o] for o in ("O1", "o2", "O2 ", None)] == ["p", "p", "q", "r"]
    assert [v for (m, _), v in sorted(got.items(), key=lambda x: x[0][0]) if m != "s"] == ["p", None, "q", "p", None, None, None]


def test_facts_of_lines_have_the_products_of_facts(spark):
    """Told where the lines of an order are together, products are those that the facts have when they are dealt by order."""
    import random

    pick = random.Random(1)
    rows = [(o, n, pick.choice(["p", " q ", "r", "", None]), pick.choice(["p", "q", "s", "rx", " ", None]), pick.choice("ab")) for o in [*range(60), None] for n in range(1, 1 + pick.choice([1, 1, 2, 3]))]
    lines = spark.createDataFrame(rows, "o int, n int, part string, other string, store string")
    key, none = F.concat(F.lit(" K"), F.col("o").cast("string")), F.lit(None).cast("string")
    entries = [
        {"metric": "sales", "amount": F.col("n"), "sku": F.col("part"), "orders": [key]},
        {"metric": "fee", "amount": F.lit(-1), "sku": F.col("other"), "orders": [F.lower(key)], "where": F.when(F.col("store") == "a", F.col("n") == 1)},
        {"metric": "cost", "amount": F.col("n") * 2, "sku": F.col("other"), "orders": [F.when(F.col("n") > 1, "unknown"), F.when(F.col("n") == 1, key)]},
        {"metric": "gift", "amount": F.lit("0.5"), "sku": F.concat(F.col("part"), F.lit(" ")), "orders": []},
        {"metric": "none", "amount": F.lit(None), "sku": none, "orders": [F.lit(" "), key]},
    ]
    got = statement.facts_of_lines(lines, "o", entries, "sales", ["store", "n"])
    assert got.columns == ["store", "n", "sku", "metric", "amount"]
    apart = None
    for e in entries:
        order, sub = [*e["orders"], none, none][:2]
        one = lines.where(e.get("where", F.lit(True))).select("store", "n", order.alias("order_id"), sub.alias("sub"), e["sku"].alias("sku"), F.lit(e["metric"]).alias("metric"), e["amount"].cast("decimal(20,4)").alias("amount"))
        apart = one if apart is None else apart.unionByName(one)
    want = statement.with_products(apart, "order_id", "metric", "sku", "sales", ["sub"]).select(got.columns)
    ordered = lambda df: sorted((tuple(r) for r in df.collect()), key=repr)
    found = ordered(got)
    assert found == ordered(want) and {r[2] for r in found} == {None, "p", "q", "r"}
    # Both by the one product of the order and, where its sales don't agree, by a product that another order sells.
    assert {r[2] for r in found if r[3] == "none"} == {None, "p", "q", "r"} and {"p", "q", None} <= {r[2] for r in found if r[3] == "cost"} and ordered(statement.facts_of_lines(lines.limit(0), "o", entries, "sales", ["store"])) == []


def test_profit_view(spark):
    D = Decimal
    rows = [("m", "p", "P", "transaction_receipt", D(100), True), ("m", "p", "P", "transaction_refund", D(-10), True), ("m", "p", "P", "order_cost", D("-33.3333"), True), ("m", "p", None, "advertising", D(-5), True), ("m", "p", "P", "commission", None, True), ("m", "q", "Q", "procurement", D(-2), True), ("n", "p", "P2", "advertising", D(-1), True)]
    table = spark.createDataFrame(rows, "month string, sku string, name string, metric string, amount decimal(20,4), ok boolean")
    view = lambda df: statement.profit_view(df, ["month"], "sku", "name", "metric", "amount", "ok").collect()
    got = {(r["month"], r["sku"]): r for r in view(table)}
    p, q, n = got["m", "p"], got["m", "q"], got["n", "p"]
    assert (p["name"], p["gross_profit"], p["gross_margin"], p["store_profit"], p["store_margin"], p["commission"]) == ("P", D("56.6667"), D("0.5667"), D("51.6667"), D("0.5167"), 0)
    assert (q["gross_profit"], q["gross_margin"], q["store_margin"]) == (-2, None, None) and (n["name"], n["gross_profit"], n["store_profit"]) == ("P2", 0, -1)
    assert len(p.asDict()) == 3 + 11 + 4 and view(table.limit(0)) == []
    for change, why in (({"ok": F.lit(False)}, "not certified"), ({"ok": F.lit(None).cast("boolean")}, "not certified"), ({"metric": F.lit("x")}, "no metric x"), ({"sku": F.lit("")}, "no product"), ({"month": F.lit("m")}, "two names of p")):
        with pytest.raises(Exception, match=why):
            view(table.withColumns(change))
