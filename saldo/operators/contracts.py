"""Reconciliation under a contract: which sources take part on which side, orders against platform, settlement batches against cash.

A contract is {code, version, mode, tolerance, sources: {type: {side, required}}}. It is checked on the driver and compiled to
one expression for an item's part; an item that the contract has no place for stops the plan that reads it.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from saldo.functions.money import MONEY
from saldo.operators.graph import components
from saldo.operators.reconcile import link_kind

#: The sides that a contract of each mode requires, and the routes of items.
MODES = {"platform_wallet": {"order", "platform"}, "bank_three_way": {"order", "platform", "cash"}}
ROUTES = ("two_sided", "legal_single_sided", "excluded")
SUM = "decimal(30,4)"


class ContractError(ValueError):
    """A contract that cannot be kept."""


def checked(contract: Mapping) -> Mapping:
    """The contract, if it names itself, has no unknown sides, and requires just the sides of its mode."""
    if not contract.get("code") or not contract.get("version"):
        raise ContractError("a contract needs a code and a version")
    mode = contract.get("mode", "bank_three_way")
    if mode not in MODES:
        raise ContractError(f"no mode {mode}")
    sources = contract["sources"]
    if odd := {s for spec in sources.values() if (s := spec["side"]) not in ("order", "platform", "cash")}:
        raise ContractError(f"no sides {sorted(odd)}")
    required = {spec["side"] for spec in sources.values() if spec.get("required", True)}
    if required != MODES[mode]:
        raise ContractError(f"{mode} requires {sorted(MODES[mode])}, not {sorted(required)}")
    return contract


def side_of(contract: Mapping, source_type: Column, side: Column | None = None) -> Column:
    """The side of an item by its source; a source that the contract lacks, or a side that is not the source's, raises."""
    pairs = [F.lit(x) for name, spec in contract["sources"].items() for x in (name, spec["side"])]
    told = F.create_map(*pairs)[source_type]
    wrong = told.isNull() if side is None else told.isNull() | ~told.eqNullSafe(side)
    message = F.concat(F.lit(f"contract {contract['code']} has no place for "), F.concat_ws(" as ", F.coalesce(source_type, F.lit("null")), *([] if side is None else [side])))
    return F.when(wrong, F.raise_error(message).cast("string")).otherwise(told)


def repeated_items(items: DataFrame, item_id: str) -> DataFrame:
    """(item_id, times) of items that are there more than once; a contract's items have to be unique."""
    return items.groupBy(item_id).agg(F.count("*").alias("times")).where("times > 1")


def _sum(when: Column, amount: Column) -> Column:
    return F.coalesce(F.sum(F.when(when, amount)), F.lit(0)).cast(SUM)


def _tolerated(difference: Column, contract: Mapping) -> Column:
    return F.abs(difference) <= F.abs(F.lit(str(contract.get("tolerance", "0.0100"))).cast(MONEY))


def _missing(sides: Mapping[str, Column]) -> Column:
    return F.concat_ws(",", *[F.when(n == 0, F.lit(name)) for name, n in sides.items()])


def order_platform(items: DataFrame, contract: Mapping, key: str = "business_key", source_type: str = "source_type", amount: str = "amount", route: str | None = None, side: str | None = None) -> DataFrame:
    """(key, order_amount, platform_amount, difference, orders, platforms, kind, missing, status, exposure) of each business key.

    Status is balanced, amount_mismatch, missing_side, or legal_single_sided where all items of a key with one side
    only are routed so. Excluded items take no part; a null route is two_sided, an unknown one raises; a null amount
    adds nothing but is an item; items of a null key are one key's. Exposure is what is open: 0 where nothing is.
    One aggregate with conditional sums, combined before the shuffle.
    """
    checked(contract)
    part = side_of(contract, F.col(source_type), None if side is None else F.col(side))
    way = F.lit("two_sided") if route is None else F.coalesce(F.col(route), F.lit("two_sided"))
    way = F.when(way.isin(*ROUTES), way).otherwise(F.raise_error(F.concat(F.lit("no route "), way)).cast("string"))
    told = items.select(F.col(key), part.alias("_side"), way.alias("_way"), F.col(amount).cast(MONEY).alias("_amount")).where("_side in ('order', 'platform') and _way <> 'excluded'")
    order, platform = F.col("_side") == "order", F.col("_side") == "platform"
    told = told.groupBy(key).agg(
        _sum(order, F.col("_amount")).alias("order_amount"),
        _sum(platform, F.col("_amount")).alias("platform_amount"),
        F.count_if(order).alias("orders"),
        F.count_if(platform).alias("platforms"),
        F.bool_and(F.col("_way") == "legal_single_sided").alias("_legal"),
    )
    missing = _missing({"order": F.col("orders"), "platform": F.col("platforms")})
    told = told.withColumns({"difference": (F.col("platform_amount") - F.col("order_amount")).cast(SUM), "missing": missing, "kind": link_kind(F.col("orders"), F.col("platforms"))})
    status = F.when((F.col("missing") != "") & F.col("_legal"), "legal_single_sided").when(F.col("missing") != "", "missing_side").when(_tolerated(F.col("difference"), contract), "balanced").otherwise("amount_mismatch")
    open_ = F.col("status").isin("missing_side", "amount_mismatch")
    told = told.withColumn("status", status).withColumn("exposure", F.when(open_, F.abs("difference")).otherwise(0).cast(SUM))
    return told.select(key, "order_amount", "platform_amount", "difference", "orders", "platforms", "kind", "missing", "status", "exposure")


def platform_cash(items: DataFrame, bridges: DataFrame, contract: Mapping, key: str = "business_key", source_type: str = "source_type", amount: str = "amount", batch: str = "settlement_batch_key", cash: str = "cash_bridge_key", side: str | None = None) -> DataFrame:
    """(component, batches, cashes, platform_amount, cash_amount, difference, kind, bridges, missing, status, exposure) of each group that bridges join.

    Platform items stand under their batch, cash items under their cash key, those without one under their business
    key, which no bridge reaches. Groups are the components of the bridges (rows of batch and cash); component is the
    least of `b:<batch>`, `c:<cash>`, `k:<business key of cash>`, `p:<of platform>`; kind is null without a bridge. Status: missing_cash_bridge where no bridge is;
    ambiguous_cash_bridge for N:M groups and pairs that are bridged twice; missing_side; cash_amount_mismatch; linked.
    Exposure is the open difference, or both sides where there is no bridge. A blank key is none; a bridge with a
    blank end joins nothing.

    Items are added up by key before they meet the components, so that a key of many items is one row there.
    """
    checked(contract)
    if contract.get("mode", "bank_three_way") != "bank_three_way":
        raise ContractError("only a bank_three_way contract has a cash side")
    named = lambda mark, c: F.concat(F.lit(mark), F.nullif(F.trim(F.col(c).cast("string")), F.lit("")))
    part = side_of(contract, F.col(source_type), None if side is None else F.col(side))
    platform = F.col("_side") == "platform"
    own = F.when(platform, F.coalesce(named("b:", batch), F.concat(F.lit("p:"), F.coalesce(F.col(key).cast("string"), F.lit("")))))
    own = own.otherwise(F.coalesce(named("c:", cash), F.concat(F.lit("k:"), F.coalesce(F.col(key).cast("string"), F.lit("")))))
    taking = items.withColumn("_side", part).where("_side in ('platform', 'cash')")
    nodes = taking.groupBy(own.alias("id"), platform.alias("_platform")).agg(F.coalesce(F.sum(F.col(amount).cast(MONEY)), F.lit(0)).cast(SUM).alias("_sum"), F.count("*").alias("_items"))
    pairs = bridges.select(named("b:", batch).alias("a"), named("c:", cash).alias("b")).where("a is not null and b is not null").groupBy("a", "b").agg(F.count("*").alias("_times"))
    labels = components(pairs)
    told = nodes.join(labels, "id", "full_outer").withColumn("_joined", F.col("component").isNotNull()).withColumn("component", F.coalesce("component", "id"))
    starts = lambda mark: F.col("id").startswith(mark)
    told = told.groupBy("component").agg(
        F.count_if(starts("b:")).alias("batches"),
        F.count_if(starts("c:")).alias("cashes"),
        _sum(F.col("_platform"), F.col("_sum")).alias("platform_amount"),
        _sum(~F.col("_platform"), F.col("_sum")).alias("cash_amount"),
        F.coalesce(F.sum(F.when(F.col("_platform"), F.col("_items"))), F.lit(0)).alias("_n_platform"),
        F.coalesce(F.sum(F.when(~F.col("_platform"), F.col("_items"))), F.lit(0)).alias("_n_cash"),
        F.bool_or("_joined").alias("_joined"),
    )
    times = pairs.join(labels, F.col("a") == F.col("id")).groupBy("component").agg(F.sum("_times").alias("bridges"), F.max("_times").alias("_most"))
    told = told.join(times, "component", "left")
    several = (F.col("batches") > 1) & (F.col("cashes") > 1)
    difference = (F.col("cash_amount") - F.col("platform_amount")).cast(SUM)
    told = told.withColumns({"difference": difference, "missing": _missing({"platform": F.col("_n_platform"), "cash": F.col("_n_cash")}), "bridges": F.coalesce("bridges", F.lit(0))})
    status = F.when(~F.col("_joined"), "missing_cash_bridge").when(several | (F.col("_most") > 1), "ambiguous_cash_bridge").when(F.col("missing") != "", "missing_side").when(_tolerated(F.col("difference"), contract), "linked").otherwise("cash_amount_mismatch")
    exposure = F.when(F.col("status") == "linked", 0).when(F.col("status") == "missing_cash_bridge", F.abs("platform_amount") + F.abs("cash_amount")).otherwise(F.abs("difference")).cast(SUM)
    told = told.withColumns({"kind": F.when(F.col("_joined"), link_kind(F.col("batches"), F.col("cashes"))), "status": status}).withColumn("exposure", exposure)
    return told.select("component", "batches", "cashes", "platform_amount", "cash_amount", "difference", "kind", "bridges", "missing", "status", "exposure")


def cross_source(rows: DataFrame, partners: DataFrame, rules: Sequence[Mapping], scope: Sequence[str]) -> DataFrame:
    """(scope, rule, mode, status, actual, expected, difference) of each rule and scope of `rows` against its partner source.

    A rule is {mode, field, dependency_field, tolerance, allowed_unmatched, applicable}. required_source: the scope has rows
    of the partner. control_total: the sums agree within the tolerance (0.0100). business_key: no more than allowed_unmatched of the
    different keys lack a partner (actual: matched, expected: all, difference: unmatched). A scope that the partner has not
    is pending; a rule that is not applicable is told as such; null and blank keys are none. `field` is a column of both sides
    unless dependency_field names the partner's. Rules of one mode and columns share the work of a scan.
    """
    sums = [r for r in rules if r["mode"] == "control_total"]
    other = lambda r: r.get("dependency_field", r["field"])
    if odd := {r["mode"] for r in rules} - {"required_source", "control_total", "business_key"}:
        raise ContractError(f"no modes {sorted(odd)}")
    number = lambda c: F.coalesce(F.sum(F.col(c).cast(MONEY)), F.lit(0)).cast(SUM)
    mine = rows.groupBy(*scope).agg(F.lit(True).alias("_here"), *[number(c).alias(f"_own_{c}") for c in sorted({r["field"] for r in sums})])
    theirs = partners.groupBy(*scope).agg(F.lit(True).alias("_there"), *[number(c).alias(f"_other_{c}") for c in sorted({other(r) for r in sums})])
    told = _null_safe(mine, theirs, scope)
    key = lambda c: F.nullif(F.trim(F.col(c).cast("string")), F.lit(""))
    fields = list(dict.fromkeys((r["field"], other(r)) for r in rules if r["mode"] == "business_key"))
    for i, (a, b) in enumerate(fields):
        # A key's presence on either side is one aggregate of both tables: an anti join without a join.
        both = rows.select(*scope, key(a).alias("_key"), F.lit(1).alias("_mine")).unionByName(partners.select(*scope, key(b).alias("_key"), F.lit(0).alias("_mine"))).where("_key is not null")
        seen = both.groupBy(*scope, "_key").agg(F.max("_mine").alias("_mine"), F.min("_mine").alias("_least")).where("_mine = 1")
        told = _null_safe(told, seen.groupBy(*scope).agg(F.count_if(F.col("_least") == 0).alias(f"_matched{i}"), F.count("*").alias(f"_keys{i}")), scope)
    out = []
    for n, r in enumerate(rules):
        there, nothing = F.col("_there").isNotNull(), F.lit(None).cast(SUM)
        actual = expected = difference = nothing
        passed = F.lit(True)
        if r["mode"] == "control_total":
            actual, expected = F.col(f"_own_{r['field']}"), F.col(f"_other_{other(r)}")
            difference = (actual - expected).cast(SUM)
            passed = F.abs(difference) <= F.lit(str(r.get("tolerance", "0.0100"))).cast(MONEY)
        elif r["mode"] == "business_key":
            i = fields.index((r["field"], other(r)))
            actual, expected = (F.coalesce(f"_{c}{i}", F.lit(0)).cast(SUM) for c in ("matched", "keys"))
            difference = (expected - actual).cast(SUM)
            passed = difference <= r.get("allowed_unmatched", 0)
        status = F.when(there & passed, "passed").when(there, "failed").otherwise("pending") if r.get("applicable", True) else F.lit("not_applicable")
        known = there if r.get("applicable", True) else F.lit(False)
        out.append(F.struct(F.lit(n).alias("rule"), F.lit(r["mode"]).alias("mode"), status.alias("status"), *[F.when(known, v).alias(c) for c, v in (("actual", actual), ("expected", expected), ("difference", difference))]))
    return told.select(*scope, F.explode(F.array(*out)).alias("_r")).select(*scope, "_r.*")


def _null_safe(left: DataFrame, right: DataFrame, keys: Sequence[str]) -> DataFrame:
    """The left table with the right one's columns, null keys being equal to each other."""
    renamed = right.withColumnsRenamed({k: f"_r_{k}" for k in keys})
    same = reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"_r_{k}")) for k in keys])
    return left.join(renamed, same, "left").drop(*[f"_r_{k}" for k in keys])
