"""Declared gates: each rule met and broken, absent columns, empty tables; the ninth kind of gap."""

from decimal import Decimal

import pytest

from saldo.operators import audit, upload


def test_declared_gates(spark):
    D = Decimal
    table = spark.createDataFrame([("a", 1, D(5)), ("a", 1, None), ("a", None, D(-1)), ("b", 2, D(3)), (None, 3, D(0))], "store string, k int, v decimal(20,4)")
    rules = [{"type": "required_field", "field": "v"}, {"type": "required_field", "field": "gone"}, {"type": "non_negative", "field": "v"}, {"type": "non_negative", "field": "gone"}, {"type": "unique", "fields": ["k"]}, {"type": "unique", "fields": ["k", "v"]}]
    rules += [{"type": "row_count", "min": 2, "max": 3}, {"type": "order_count", "field": "k", "min": 1}, {"type": "expected_volume", "expected": 2, "tolerance": "0.5"}, {"type": "expected_volume"}, {"type": "control_total", "field": "v", "expected": "4.01"}, {"type": "control_total", "field": "v"}]
    got = {(r["store"], r["rule"]): (r["status"], r["value"]) for r in upload.declared_gates(table, rules, ["store"]).collect()}
    assert len(got) == 36
    p, f, n = "passed", "failed", "not_applicable"
    assert [got["a", i] for i in range(12)] == [(f, 1), (f, 3), (f, 1), (n, None), (f, 1), (p, 0), (p, 3), (p, 1), (p, 3), (n, None), (p, 4), (n, None)]
    assert [got["b", i][0] for i in range(12)] == [p, f, p, n, p, p, f, p, p, n, f, n] and got[None, 10] == (f, 0)
    empty = upload.declared_gates(table.limit(0), rules).collect()
    assert [(r["gate"], r["status"]) for r in empty][:2] == [("required_field:v", p), ("required_field:gone", f)] and empty[6]["status"] == f and empty[10]["value"] == 0
    assert upload.declared_gates(table.limit(0), rules, ["store"]).collect() == []
    with pytest.raises(ValueError, match="no rule"):
        upload.declared_gates(table, [{"type": "x"}])


def test_unclassified_rows_are_a_gap(spark):
    table = spark.createDataFrame([("a", 5, 3, 3), ("b", 5, 3, 0), ("c", 5, 3, None), ("d", 5, 5, 1)], "k string, n int, linked int, lost int").selectExpr("*", "'x' as node", "cast(1 as decimal(20,4)) as v", "cast(1 as decimal(20,4)) as before", "3 as expected")
    call = lambda **more: [(r["k"], r["kind"], r["severity"]) for r in audit.gaps(table, ["k"], "node", "v", "before", "n", "linked", "expected", **more).orderBy("k", "severity").collect()]
    assert call(unclassified="lost") == [("a", "unclassified", 8), ("b", "unlinked", 9), ("c", "unlinked", 9), ("d", "unclassified", 8)]
    assert call(unclassified="lost", every=True)[:2] == [("a", "unclassified", 8), ("a", "unlinked", 9)] and call() == [("a", "unlinked", 9), ("b", "unlinked", 9), ("c", "unlinked", 9)]
