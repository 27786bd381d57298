"""Declared metrics and statements: facts, exact totals, formula trees, profit views.

A metric is {id, value, where, sign, parents, keep_zero}; a statement is a list of nodes
{id, op, of, total}. Both are compiled to expressions; a statement of any depth is one
aggregate and one projection.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from saldo.functions.money import MONEY, money, ratio, total
from saldo.functions.predicates import where

# What gross profit is made of, receipts first, and what comes between it and a store's profit.
GROSS_METRICS = ("transaction_receipt", "transaction_refund", "transaction_compensation", "software_service_fee", "marketing_expense", "shipping_expense", "order_cost", "reship_cost", "commission", "procurement")
ADVERTISING = "advertising"


def value(spec: Mapping) -> Column:
    """sum of columns (null counts as 0), product (null stays null), count, or a constant."""
    kind, of = spec["op"], spec.get("of", ())
    if kind == "sum":
        return total(*[money(c) for c in of])
    if kind == "sum_product":
        return reduce(lambda a, b: (a * b).cast("decimal(28,6)"), [money(c) for c in of])
    return F.lit(1).cast(MONEY) if kind == "count" else F.lit(str(spec["value"])).cast(MONEY)


def facts(rows: DataFrame, metric: Mapping, context: Sequence[str]) -> DataFrame:
    """A metric's facts: filtered, valued, signed, parents only if asked for, zeros left out."""
    kept = rows.where(where(metric.get("where", ())))
    amount = F.bround(value(metric["value"]), 4).cast(MONEY)
    if metric.get("parents"):
        amount = F.when(F.col(metric["parents"]), amount).otherwise(F.lit(0).cast(MONEY))
    if metric.get("sign", 1) < 0:
        amount = -amount
    out = kept.select(F.lit(metric["id"]).alias("metric_id"), *context, amount.cast(MONEY).alias("amount"))
    return out if metric.get("keep_zero") else out.where("amount <> 0")


def all_facts(rows: DataFrame, metrics: Sequence[Mapping], context: Sequence[str]) -> DataFrame:
    """Facts of several metrics over one scan: each row is unfolded into the metrics that claim it."""
    entries = []
    for m in metrics:
        amount = F.bround(value(m["value"]), 4).cast(MONEY)
        amount = (-amount if m.get("sign", 1) < 0 else amount).cast(MONEY)
        entries.append(F.when(where(m.get("where", ())), F.struct(F.lit(m["id"]).alias("metric_id"), amount.alias("amount"))))
    unfolded = rows.select(*context, F.explode(F.filter(F.array(*entries), lambda e: e.isNotNull())).alias("_e"))
    return unfolded.select("_e.metric_id", *context, "_e.amount").where("amount <> 0")


def summed(rows: DataFrame, metrics: Sequence[Mapping], keys: Sequence[str]) -> DataFrame:
    """Sums of all metrics by keys as columns, from the rows at once: one aggregate, and no row is unfolded into facts."""
    out = []
    for m in metrics:
        amount = F.bround(value(m["value"]), 4).cast(MONEY)
        amount = (-amount if m.get("sign", 1) < 0 else amount).cast(MONEY)
        out.append(F.coalesce(F.sum(F.when(where(m.get("where", ())), amount)), F.lit(0)).cast("decimal(30,4)").alias(m["id"]))
    return rows.groupBy(*keys).agg(*out)


def with_nodes(wide: DataFrame, metrics: Sequence[str], nodes: Sequence[Mapping]) -> DataFrame:
    """The sums with every node of a statement as a further column."""
    for spec in ordered(nodes, set(metrics)):
        wide = wide.withColumn(spec["id"], node(spec))
    return wide


def totals(facts_: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Exact sums by metric and keys; cents are left to the display."""
    return facts_.groupBy("metric_id", *keys).agg(F.sum("amount").alias("amount"))


def ordered(nodes: Sequence[Mapping], metrics: set[str]) -> list[Mapping]:
    """Nodes after the nodes that they need; a cycle or an unknown name is an error."""
    known, left, out = set(metrics), list(nodes), []
    while left:
        ready = [n for n in left if all(c in known for c in n.get("of", ()))]
        if not ready:
            raise ValueError(f"cycle or unknown name in {[n['id'] for n in left]}")
        out += ready
        known |= {n["id"] for n in ready}
        left = [n for n in left if n["id"] not in known]
    return out


def node(spec: Mapping) -> Column:
    """add (signs by a leading minus are given as negate nodes), negate, ratio and constant over columns.

    A missing child makes a total null; other sums are partial, and null only if all children are missing.
    """
    of = [F.col(c) for c in spec.get("of", ())]
    if spec["op"] == "constant":
        return F.lit(str(spec["value"])).cast(MONEY)
    if spec["op"] == "ratio":
        return ratio(of[0], of[1])
    if spec["op"] == "negate":
        return (-of[0]).cast("decimal(30,4)")
    if spec.get("total"):
        return reduce(lambda a, b: a + b, of).cast("decimal(30,4)")
    return F.when(F.coalesce(*of).isNotNull(), total(*of)).cast("decimal(30,4)")


def statement(totals_: DataFrame, keys: Sequence[str], metrics: Sequence[str], nodes: Sequence[Mapping], unavailable: DataFrame | None = None) -> DataFrame:
    """One row per keys with a column for every metric and node.

    A metric without facts is 0; one listed in `unavailable` (keys, metric_id) is null, and what needs it follows.
    """
    wide = totals_.groupBy(*keys).agg(*[F.coalesce(F.sum(F.when(F.col("metric_id") == m, F.col("amount"))), F.lit(0)).cast("decimal(30,4)").alias(m) for m in metrics])
    if unavailable is not None:
        missing = unavailable.groupBy(*keys).agg(F.collect_set("metric_id").alias("_missing"))
        wide = wide.join(missing, list(keys), "left")
        wide = wide.withColumns({m: F.when(~F.coalesce(F.array_contains("_missing", m), F.lit(False)), F.col(m)) for m in metrics}).drop("_missing")
    return with_nodes(wide, metrics, nodes)


def rolled_up(lines: DataFrame, store: str, sku: str, metric: str, amount: str, keys: Sequence[str] = ()) -> DataFrame:
    """Store totals and product lines of every metric in one pass, by grouping sets."""
    named = ", ".join([*keys, store, metric])
    sql = f"SELECT {named}, CASE WHEN grouping({sku}) = 1 THEN '__store_total__' ELSE CAST({sku} AS STRING) END AS sku_key, SUM({amount}) AS value FROM {{lines}} GROUP BY GROUPING SETS (({named}), ({named}, {sku}))"
    return lines.sparkSession.sql(sql, lines=lines)


def ticked(name: str) -> str:
    """A column's name inside SQL that is formatted with DataFrames."""
    return "`" + name.replace("`", "``").replace("{", "{{").replace("}", "}}") + "`"


def summed_of(value: str, metric: str, name: str) -> Column:
    """The sum over the rows of one metric only. By a filter of the aggregate: a row touches the sum of its own metric, not those of all."""
    quoted = name.replace("\\", "\\\\").replace("'", "\\'")
    return F.expr(f"sum(`{value}`) FILTER (WHERE `{metric}` = '{quoted}')")


def certified(facts_: DataFrame, keys: Sequence[str], sku: str, metric: str, amount: str, components: Sequence[str]) -> DataFrame:
    """Per keys a row '__store_total__', one for each product, and '__unassigned__' if some money has no product.

    Columns: sku_key, a sum for each component (null where a row has no fact of it), profit (the sum of all
    components; null unless all are there, and for what is unassigned), missing (names, comma-joined), and of the
    total row only: products, complete_products, residual_<component> (the store's sum less its products') and
    ready (every product complete, at least one, and no residual). Facts of other metrics are left out; a null
    amount is a fact that is there and adds nothing; a blank product is none.

    Products are summed first, and stores over them: the products' rows are named once and read twice, not dealt again.
    """
    product = own_product(F.col(sku))
    zero = F.lit(0).cast("decimal(30,4)")
    rows = facts_.where(F.col(metric).isin(*components)).select(*keys, product.alias("_sku"), F.col(metric).alias("_metric"), F.coalesce(F.col(amount).cast(MONEY), F.lit(0).cast(MONEY)).alias("_value"))
    by_product = rows.groupBy(*keys, "_sku").agg(*[summed_of("_value", "_metric", m).cast("decimal(30,4)").alias(m) for m in components])
    by_product = by_product.withColumn("_whole", reduce(lambda a, b: a & b, [F.col(m).isNotNull() for m in components]))
    by, sums = ", ".join(map(ticked, keys)), [ticked(m) for m in components]
    own = ["0 AS _total", "_sku", by, *sums, *["NULL"] * (len(sums) + 2)]
    of_all = ["1", "NULL", by, *[f"CAST(SUM({m}) AS DECIMAL(30,4))" for m in sums], *[f"CAST(SUM(CASE WHEN _sku IS NOT NULL THEN {m} END) AS DECIMAL(30,4))" for m in sums], "COUNT(_sku)", "COUNT_IF(_sku IS NOT NULL AND _whole)"]
    names = ["_total", "_product", *keys, *components, *[f"_assigned_{m}" for m in components], "products", "complete_products"]
    told = facts_.sparkSession.sql(f"WITH p AS (SELECT * FROM {{products}}) SELECT {', '.join(filter(None, own))} FROM p UNION ALL SELECT {', '.join(filter(None, of_all))} FROM p{' GROUP BY ' + by if by else ''}", products=by_product).toDF(*names)
    total_row, unassigned = F.col("_total") == 1, (F.col("_total") == 0) & F.col("_product").isNull()
    missing = F.concat_ws(",", *[F.when(F.col(m).isNull(), F.lit(m)) for m in components])
    profit = F.when(~unassigned, reduce(lambda a, b: a + b, [F.col(m) for m in components])).cast("decimal(30,4)")
    residual = {f"residual_{m}": F.when(total_row, F.coalesce(m, zero) - F.coalesce(f"_assigned_{m}", zero)).cast("decimal(30,4)") for m in components}
    settled = reduce(lambda a, b: a & b, [F.col(r) == 0 for r in residual])
    ready = F.when(total_row, (F.col("products") > 0) & (F.col("products") == F.col("complete_products")) & settled)
    name = F.when(total_row, "__store_total__").when(unassigned, "__unassigned__").otherwise(F.col("_product"))
    told = told.withColumns({"sku_key": name, "profit": profit, "missing": missing, **residual}).withColumn("ready", ready)
    return told.select(*keys, "sku_key", *components, "profit", "missing", *[F.when(total_row, F.col(c)).alias(c) for c in ("products", "complete_products")], *residual, "ready")


def profit_view(entries: DataFrame, keys: Sequence[str], sku: str, name: str, metric: str, amount: str, certified_: str | None = None) -> DataFrame:
    """Per keys and product its name, the sums of all profit metrics, gross and store profit and their margins on receipts.

    A metric without entries is 0, a margin over no receipts null, null amounts add nothing. An entry that is not
    certified, of an unknown metric or without a product stops the plan, as do two names of one product in a group.
    One aggregate with a conditional sum for each metric, combined before the shuffle.
    """
    known = (*GROSS_METRICS, ADVERTISING)
    refuse = lambda test, why, good: F.when(test, F.raise_error(why)).otherwise(good)
    value = F.coalesce(F.col(amount).cast(MONEY), F.lit(0))
    if certified_:
        value = refuse(~F.coalesce(F.col(certified_), F.lit(False)), F.lit("an entry is not certified"), value)
    kind = refuse(~F.coalesce(F.col(metric).isin(*known), F.lit(False)), F.concat(F.lit("no metric "), F.coalesce(metric, F.lit("null"))), F.col(metric))
    product = refuse(F.coalesce(F.col(sku).cast("string"), F.lit("")) == "", F.lit("an entry has no product"), F.col(sku))
    rows = entries.select(*keys, product.alias(sku), F.col(name).alias("_name"), kind.alias("_metric"), value.alias("_value"))
    sums = [F.coalesce(summed_of("_value", "_metric", m), F.lit(0)).cast("decimal(30,4)").alias(m) for m in known]
    told = rows.groupBy(*keys, sku).agg(F.min("_name").alias(name), F.max("_name").alias("_other"), *sums)
    told = told.withColumn(name, refuse(F.col(name) != F.col("_other"), F.concat(F.lit("two names of "), F.col(sku).cast("string")), F.col(name)))
    told = told.withColumn("gross_profit", total(*GROSS_METRICS).cast("decimal(30,4)")).withColumn("store_profit", (F.col("gross_profit") + F.col(ADVERTISING)).cast("decimal(30,4)"))
    margins = {f"{m}_margin": ratio(f"{m}_profit", GROSS_METRICS[0]) for m in ("gross", "store")}
    return told.withColumns(margins).select(*keys, sku, name, *GROSS_METRICS, "gross_profit", "gross_margin", ADVERTISING, "store_profit", "store_margin")


def own_product(sku: Column) -> Column:
    """A product's name without the blanks around it; a blank one is none."""
    return F.nullif(F.trim(sku.cast("string")), F.lit(""))


def folded(key: Column) -> Column:
    """An order's key as it is compared: without blanks around it, in small letters; a blank one is none."""
    return F.nullif(F.lower(F.trim(key.cast("string"))), F.lit(""))


def with_products(facts_: DataFrame, order: str, metric: str, sku: str, sales: str, orders: Sequence[str] = ()) -> DataFrame:
    """Facts with `sku` resolved: sales keep their own; other facts take the one product that all the sales of their orders
    (the column `order` and those in `orders`) agree on, else their own if some sale has it, else none.

    Each order's products are brought down to the least and the greatest before the join, and only known products join.
    Facts without a key are spread over all tasks by a second one.
    """
    own = own_product(F.col(sku))
    sold = facts_.where((F.col(metric) == sales) & own.isNotNull()).select(folded(F.col(order)).alias("_key"), own.alias("_own"))
    of_order = sold.where("_key is not null").groupBy("_key").agg(F.min("_own").alias("_least"), F.max("_own").alias("_most"))
    known = sold.where("_key is not null").select("_own").distinct().withColumn("_known", F.lit(True))
    row = F.pmod(F.xxhash64(*[F.col(c) for c in facts_.columns]), F.lit(4096)).cast("string")
    # What has no key gets one of many that no table has.
    spread = lambda key: F.coalesce(F.concat(F.lit("="), key), F.concat(F.lit("-"), row))

    def looked_up(rows: DataFrame, table: DataFrame, key: Column, name: str) -> DataFrame:
        keyed = table.withColumn("_at", F.concat(F.lit("="), F.col(name))).drop(name)
        return rows.withColumn("_at", spread(key)).join(keyed, "_at", "left").drop("_at")

    told = facts_.withColumn("_own", own)
    tried = [order, *orders]
    for i, c in enumerate(tried):
        told = looked_up(told, of_order.withColumnsRenamed({"_least": f"_least{i}", "_most": f"_most{i}"}), folded(F.col(c)), "_key")
    told = looked_up(told, known, F.col("_own"), "_own")
    ends = [f"{e}{i}" for i in range(len(tried)) for e in ("_least", "_most")]
    least, most = F.array_min(F.array(*ends)), F.array_max(F.array(*ends))
    resolved = F.when(F.col(metric) == sales, F.col("_own")).when(least == most, least).when(F.col("_known"), F.col("_own"))
    return told.withColumn(sku, resolved).drop("_own", "_known", *ends)


def facts_of_lines(lines: DataFrame, order: str, entries: Sequence[Mapping], sales: str, keys: Sequence[str]) -> DataFrame:
    """(keys, sku, metric, amount): the facts of lines of orders, with the products that `with_products` gives to them.

    The lines of an order, and no others, have one value of `order`, and no fact names an order other than its line's. An
    entry is {metric, amount, sku, orders, where}, Columns over a line, `orders` the keys that the fact names; that of
    `sales` names its line's order by the first. Keys that differ from it are no order's.

    An order's least and greatest product are told where its lines already are together, so that no fact is dealt by its
    order. A product that its own line sells is known; only facts with another one are looked up among all that are sold.
    """
    (sale,) = [e for e in entries if e["metric"] == sales]
    sold = lines.withColumns({"_key": folded(sale["orders"][0]), "_sold": F.when(sale.get("where", F.lit(True)), own_product(sale["sku"]))})
    sold = sold.withColumn("_sold", F.when(F.col("_key").isNotNull(), F.col("_sold")))
    known = sold.where("_sold is not null").select(F.col("_sold").alias("sku")).distinct().withColumn("_known", F.lit(True))
    together = Window.partitionBy(order)
    told = sold.withColumns({"_least": F.min("_sold").over(together), "_most": F.max("_sold").over(together)})

    def facts_(of: Sequence[Mapping], asked: bool) -> DataFrame:
        """The facts that must be looked up among all sold products, or those that need not."""
        made = []
        for e in of:
            own, one, foreign = own_product(e["sku"]), F.lit(False), F.lit(False)
            if e is not sale:
                named = reduce(lambda a, b: a | b, [folded(k).eqNullSafe(F.col("_key")) for k in e["orders"]], F.lit(False))
                one = named & F.col("_least").isNotNull() & F.col("_least").eqNullSafe(F.col("_most"))
                foreign = ~one & own.isNotNull() & ~own.eqNullSafe(F.col("_sold"))
            there = e.get("where", F.lit(True)) & (foreign if asked else ~foreign)
            made.append(F.when(there, F.struct(F.when(one, F.col("_least")).otherwise(own).alias("sku"), F.lit(e["metric"]).alias("metric"), e["amount"].cast(MONEY).alias("amount"))))
        return told.select(*keys, F.explode(F.array(*made)).alias("_f")).where("_f is not null").select(*keys, "_f.*")

    others = [e for e in entries if e is not sale]
    looked_up = facts_(others, True).join(known, "sku", "left").withColumn("sku", F.when(F.col("_known"), F.col("sku")))
    return facts_(entries, False).unionByName(looked_up.drop("_known"))


def complete(df: DataFrame, keys: Sequence[str], metric: str, needed: Sequence[str]) -> DataFrame:
    """Which needed metrics each group lacks, and whether it is complete."""
    have = df.groupBy(*keys).agg(F.collect_set(F.when(F.col(metric).isin(*needed), F.col(metric))).alias("_have"))
    lacking = F.array_sort(F.array_except(F.array(*map(F.lit, needed)), F.col("_have")))
    return have.select(*keys, F.concat_ws(",", lacking).alias("missing"), (F.size(lacking) == 0).alias("complete"))
