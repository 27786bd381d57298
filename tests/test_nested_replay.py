"""Differences of nested documents: null told apart from absent, any depth, any key."""

from saldo.operators import audit


def differences(spark, was, now):
    side = lambda doc: spark.createDataFrame([(1, doc)], "k int, doc string")
    return {r["path"]: (r["was"], r["now"], r["change"]) for r in audit.replayed_documents(side(now), side(was), ["k"], "doc").collect()}


def test_leaves_types_and_depth(spark):
    was = '{"a": {"b": [1, {"c": "x", "d": null}]}, "e": [], "odd key": 1, "same": [1, 2.5, true]}'
    now = '{"a": {"b": [1, {"c": "y"}, 3]}, "e": [1], "odd key": "1", "same": [1, 2.5, true], "n": null}'
    assert differences(spark, was, now) == {
        "$.a.b[1].c": ('"x"', '"y"', "changed"), "$.a.b[1].d": ("null", None, "removed"), "$.a.b[2]": (None, "3", "added"), "$.e": ("[]", None, "removed"), "$.e[0]": (None, "1", "added"),
        '$[{"k":"odd key"}]': ("1", '"1"', "type"), "$.n": (None, "null", "added"),
    }


def test_invalid_null_and_equal_documents(spark):
    assert differences(spark, "no json", '{"a": 1}') == {"$": ("no json", None, "removed"), "$.a": (None, "1", "added")}
    assert differences(spark, None, '{"a": 1}') == {"$.a": (None, "1", "added")}
    assert differences(spark, '{"b": 2, "a": 1}', '{"a": 1, "b": 2}') == {}


def test_flat_fields_that_turn_null_have_changed(spark):
    side = lambda rows: spark.createDataFrame(rows, "k int, v int")
    out = audit.replayed(side([(1, None), (2, 5), (4, None)]), side([(1, 3), (2, None), (3, None)]), ["k"], ["v"])
    assert {r["k"]: (r["was"], r["now"], r["change"]) for r in out.collect()} == {1: ("3", None, "changed"), 2: (None, "5", "changed"), 3: (None, None, "removed"), 4: (None, None, "added")}
