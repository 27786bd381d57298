"""Plans from order lines and settlements to statements, links, allocations and differences.

Money is exact decimal throughout and becomes double in the last projection only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from saldo.functions import rules, text
from saldo.functions.money import MONEY, money
from saldo.functions.predicates import predicate, where
from saldo.operators import allocate, asof, dedupe, graph, invariants, link, reconcile, statement
from saldo.plans.registry import Tables, query

#: What SQL repeats: an amount as exact decimal.
AMOUNT = "CAST({} AS DECIMAL(20,4))"
PRICE = AMOUNT.format("l_extendedprice")
GROSS = AMOUNT.format("o_totalprice")


def number(c: Column | str) -> Column:
    return (F.col(c) if isinstance(c, str) else c).cast("double")


def with_store(t: Tables) -> DataFrame:
    """Order lines with their order's store and month."""
    orders = t.orders.join(t.customer, F.col("o_custkey") == F.col("c_custkey")).select("o_orderkey", F.col("c_mktsegment").alias("store"), text.period("o_orderdate").alias("period"))
    return t.lineitem.join(orders, F.col("l_orderkey") == F.col("o_orderkey"))


LINES = "(SELECT l.*, c_mktsegment AS store, strftime(o_orderdate, '%Y-%m') AS period FROM lineitem l JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey)"
METRICS = [
    {"id": "sales", "value": {"op": "sum", "of": ["l_extendedprice"]}},
    {"id": "refunds", "value": {"op": "sum", "of": ["l_extendedprice"]}, "where": [{"column": "l_returnflag", "op": "eq", "value": "R"}], "sign": -1},
    {"id": "fees", "value": {"op": "sum_product", "of": ["l_extendedprice", "l_tax"]}, "where": [{"column": "l_linestatus", "op": "eq", "value": "F"}], "sign": -1},
]
NODES = [
    {"id": "net", "op": "add", "of": ["sales", "refunds"]},
    {"id": "profit", "op": "add", "of": ["net", "fees"], "total": True},
    {"id": "margin", "op": "ratio", "of": ["profit", "sales"]},
]


@query(f"""
WITH f AS (SELECT store, period, SUM({PRICE}) AS sales,
  -SUM(CASE WHEN l_returnflag = 'R' THEN {PRICE} ELSE 0 END) AS refunds,
  -SUM(CASE WHEN l_linestatus = 'F' THEN CAST({PRICE} * {AMOUNT.format("l_tax")} AS DECIMAL(20,4)) ELSE 0 END) AS fees FROM {LINES} GROUP BY ALL)
SELECT store, period, CAST(sales AS DOUBLE) AS sales, CAST(refunds AS DOUBLE) AS refunds, CAST(fees AS DOUBLE) AS fees,
  CAST(sales + refunds AS DOUBLE) AS net, CAST(sales + refunds + fees AS DOUBLE) AS profit FROM f""")
def statement_by_store_month(t: Tables) -> DataFrame:
    told = statement.with_nodes(statement.summed(with_store(t), METRICS, ["store", "period"]), ["sales", "refunds", "fees"], NODES)
    return told.select("store", "period", *[number(c).alias(c) for c in ("sales", "refunds", "fees", "net", "profit")])


@query(f"""SELECT l_partkey, strftime(l_shipdate, '%Y-%m') AS period, CAST(SUM({PRICE}) AS DOUBLE) AS sales,
  CAST(COALESCE(SUM({PRICE}) FILTER (WHERE l_returnflag = 'R'), 0) AS DOUBLE) AS refunds, COUNT(*) AS n_lines FROM lineitem GROUP BY ALL""")
def pnl_pivot_part_month(t: Tables) -> DataFrame:
    lines = t.lineitem.select("l_partkey", text.period("l_shipdate").alias("period"), money("l_extendedprice").alias("v"), "l_returnflag")
    return lines.groupBy("l_partkey", "period").agg(number(F.sum("v")).alias("sales"), number(F.coalesce(F.sum(F.when(F.col("l_returnflag") == "R", F.col("v"))), F.lit(0))).alias("refunds"), F.count("*").alias("n_lines"))


@query(f"""SELECT store, 'sales' AS metric, CASE WHEN grouping(l_partkey) = 1 THEN '__store_total__' ELSE CAST(l_partkey AS VARCHAR) END AS sku_key,
  CAST(SUM({PRICE}) AS DOUBLE) AS value FROM {LINES} GROUP BY GROUPING SETS ((store), (store, l_partkey))""")
def grouping_sets_store_sku(t: Tables) -> DataFrame:
    lines = with_store(t).select("store", "l_partkey", F.lit("sales").alias("metric"), money("l_extendedprice").alias("amount"))
    return statement.rolled_up(lines, "store", "l_partkey", "metric", "amount").withColumn("value", number("value"))


@query("""SELECT event_id, COALESCE(value > 50, false) AND COALESCE(event_type <> 'error', true) AS kept FROM events""")
def where_predicate_null_policy(t: Tables) -> DataFrame:
    kept = where([{"column": "value", "op": "gt", "value": 50}, {"column": "event_type", "op": "ne", "value": "error", "include_null": True}])
    return t.events.select("event_id", kept.alias("kept"))


DSL = {"all_of": [{"any_of": [{"field": "p_brand", "op": "matches_shape", "value": "A{5}#D{2}"}, {"field": "p_type", "op": "prefix", "value": "SM"}]}, {"none_of": [{"field": "p_size", "op": "range", "value": [10, 20]}]}, {"field": "p_retailprice", "op": "sign", "value": "positive"}]}


@query("""SELECT p_partkey, (regexp_full_match(p_brand, '[A-Za-z]{5}#[0-9]{2}') OR p_type LIKE 'SM%') AND NOT (p_size BETWEEN 10 AND 20) AND p_retailprice > 0 AS chosen FROM part""")
def predicate_dsl_nested(t: Tables) -> DataFrame:
    return t.part.select("p_partkey", predicate(DSL, set(t.part.columns)).alias("chosen"))


RULES = [
    {"column": "event_type", "how": "equals", "value": ["purchase"], "major": "income", "minor": "sale"},
    {"when": {"all_of": [{"field": "event_type", "op": "eq", "value": "error"}, {"field": "value", "op": "range", "value": ["20", "100000"]}]}, "major": "cost", "minor": "penalty"},
    {"column": "event_type", "how": "contains", "value": ["sign", "view"], "major": "traffic", "minor": None},
    {"column": "props", "how": "regex", "value": r'"k": 1[0-9]\}', "major": "promo", "minor": "teens"},
]
WINNER = """CASE WHEN event_type = 'purchase' THEN 0 WHEN event_type = 'error' AND CAST(value AS DECIMAL(20,4)) BETWEEN 20 AND 100000 THEN 1
  WHEN event_type LIKE '%sign%' OR event_type LIKE '%view%' THEN 2 WHEN regexp_matches(props, '"k": 1[0-9]\\}') THEN 3 ELSE -1 END"""


@query(f"""SELECT event_id, winner, CASE winner WHEN 0 THEN 'income' WHEN 1 THEN 'cost' WHEN 2 THEN 'traffic' WHEN 3 THEN 'promo' ELSE 'unclassified' END AS major,
  CASE winner WHEN 0 THEN 'sale' WHEN 1 THEN 'penalty' WHEN 2 THEN NULL WHEN 3 THEN 'teens' ELSE 'unclassified' END AS minor FROM (SELECT *, {WINNER} AS winner FROM events)""")
def rule_chain_winner(t: Tables) -> DataFrame:
    return rules.classify(t.events, RULES, ["major", "minor"], otherwise="unclassified").select("event_id", "winner", "major", "minor")


@query(f"""SELECT {WINNER} AS winner, COUNT(*) AS hits, CAST(SUM({AMOUNT.format("value")}) AS DOUBLE) AS amount FROM events GROUP BY ALL""")
def rule_chain_stats(t: Tables) -> DataFrame:
    return rules.classify(t.events, RULES, []).groupBy("winner").agg(F.count("*").alias("hits"), number(F.sum(money("value"))).alias("amount"))


@query("""SELECT event_id, CASE WHEN value > 200 THEN 'large' WHEN event_type = 'view' THEN 'browse' ELSE event_type END AS label FROM events""")
def reclassify_pipeline(t: Tables) -> DataFrame:
    return t.events.select("event_id", rules.rewritten("event_type", [(F.col("event_type") == "view", "browse"), (F.col("value") > 200, "large")]).alias("label"))


@query(f"""SELECT CASE WHEN o_orderstatus = 'P' THEN 'excluded' WHEN o_orderpriority LIKE '1%' THEN 'legal_single_sided' ELSE 'two_sided' END AS route,
  COUNT(*) AS n, CAST(SUM({GROSS}) AS DOUBLE) AS amount FROM orders GROUP BY ALL""")
def route_split(t: Tables) -> DataFrame:
    routes = [{"column": "o_orderstatus", "how": "equals", "value": "P", "route": "excluded"}, {"column": "o_orderpriority", "how": "starts", "value": "1", "route": "legal_single_sided"}]
    return rules.classify(t.orders, routes, ["route"], otherwise="two_sided").groupBy("route").agg(F.count("*").alias("n"), number(F.sum(money("o_totalprice"))).alias("amount"))


@query("""SELECT p_partkey, NULLIF(regexp_extract(p_brand, '#([0-9]+)$', 1), '') AS brand_key, CASE WHEN len(list_distinct(regexp_extract_all(p_name, '[a-z]+'))) = 1 THEN 'found'
  WHEN len(list_distinct(regexp_extract_all(p_name, '[a-z]+'))) > 1 THEN 'ambiguous' ELSE 'missing' END AS status FROM part""")
def key_extract_regex(t: Tables) -> DataFrame:
    _, status = rules.only_key("p_name", "([a-z]+)")
    return t.part.select("p_partkey", text.first_group("p_brand", "#([0-9]+)$").alias("brand_key"), status.alias("status"))


ORDER = ["l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_returnflag", "l_linestatus", "l_shipdate"]


@query(f"""SELECT l_orderkey, CAST(SUM(CASE WHEN rn = 1 THEN {PRICE} ELSE 0 END) AS DOUBLE) AS parent_amount, COUNT(*) AS n_lines
  FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY {", ".join(ORDER)}) AS rn FROM lineitem) GROUP BY ALL""")
def parent_first_sum(t: Tables) -> DataFrame:
    marked = dedupe.mark_parents(t.lineitem, ["l_orderkey"], ORDER)
    return marked.groupBy("l_orderkey").agg(number(F.sum(F.when(F.col("is_parent"), money("l_extendedprice")).otherwise(F.lit(0).cast(MONEY)))).alias("parent_amount"), F.count("*").alias("n_lines"))


@query("""SELECT file, COUNT(*) AS kept FROM (SELECT l_suppkey % 2 AS file, MIN(l_suppkey % 2) OVER (PARTITION BY l_orderkey, l_linenumber) AS first FROM lineitem) WHERE file = first GROUP BY ALL""")
def cross_file_dedupe(t: Tables) -> DataFrame:
    files = t.lineitem.withColumn("file", F.col("l_suppkey") % 2)
    return dedupe.across_files(files, ["l_orderkey", "l_linenumber"], "file").groupBy("file").agg(F.count("*").alias("kept"))


@query("""SELECT COUNT(*) AS kept, COUNT(DISTINCT user_id) AS users FROM (SELECT *, event_id % 3 AS src,
  first_value(event_id % 3) OVER (PARTITION BY user_id, event_type, CAST(ts AS DATE) ORDER BY event_id) AS first FROM events) WHERE src = first""")
def incremental_dedupe_fingerprint(t: Tables) -> DataFrame:
    rows = t.events.withColumns({"src": F.col("event_id") % 3, "day": F.to_date("ts")})
    kept = dedupe.incremental(rows, ["user_id", "event_type", "day"], "src", ["event_id"])
    return kept.agg(F.count("*").alias("kept"), F.count_distinct("user_id").alias("users"))


@query("""SELECT user_id, event_id, event_type FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS rn FROM events) WHERE rn = 1""")
def latest_per_group(t: Tables) -> DataFrame:
    return dedupe.latest(t.events, ["user_id"], ["ts", "event_id"]).select("user_id", "event_id", "event_type")


@query("""SELECT l_orderkey, l_partkey, l_suppkey FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_returnflag <> 'R', l_linenumber, l_partkey, l_suppkey) AS rn FROM lineitem) WHERE rn = 1""")
def preferred_row(t: Tables) -> DataFrame:
    return dedupe.preferred(t.lineitem, ["l_orderkey"], F.col("l_returnflag") == "R", ["l_linenumber", "l_partkey", "l_suppkey"]).select("l_orderkey", "l_partkey", "l_suppkey")


@query("""SELECT row_number() OVER (ORDER BY o_totalprice, o_orderkey) AS row_no, o_orderkey FROM orders""")
def row_numbers(t: Tables) -> DataFrame:
    return dedupe.numbered(t.orders.select("o_totalprice", "o_orderkey"), ["o_totalprice", "o_orderkey"]).select("row_no", "o_orderkey")


def settled(t: Tables) -> DataFrame:
    """Settlement rows that reach the spine for a part of the orders only."""
    return t.orders.select(F.concat(F.lit("@"), F.col("o_orderkey").cast("string"), F.lit(".0")).alias("raw_key"), money("o_totalprice").alias("amount"), "o_orderpriority").withColumn("raw_key", F.regexp_replace("raw_key", r"^@([0-9]+)\.0$", "@$1"))


def spine_keys(t: Tables) -> DataFrame:
    return link.spine_index(t.lineitem, "l_orderkey", ORDER)


@query(f"""SELECT o_orderpriority, COUNT(*) AS n_rows, COUNT(*) AS keyed, COUNT(*) FILTER (WHERE k IS NOT NULL) AS hits, CAST(COALESCE(SUM({GROSS}) FILTER (WHERE k IS NULL), 0) AS DOUBLE) AS unlinked_amount
  FROM orders LEFT JOIN (SELECT DISTINCT l_orderkey AS k FROM lineitem) ON o_orderkey = k GROUP BY ALL""")
def link_hit_rate(t: Tables) -> DataFrame:
    report = link.link_report(link.link(settled(t), "raw_key", spine_keys(t)), ["o_orderpriority"], "amount")
    return report.select("o_orderpriority", F.col("rows").alias("n_rows"), "keyed", "hits", number(F.coalesce("unlinked_amount", F.lit(0))).alias("unlinked_amount"))


@query("""SELECT COUNT(*) AS expected, COUNT(k) AS covered FROM (SELECT DISTINCT o_orderkey FROM orders WHERE o_orderstatus = 'F') LEFT JOIN (SELECT DISTINCT l_orderkey AS k FROM lineitem WHERE l_linestatus = 'F') ON o_orderkey = k""")
def link_coverage(t: Tables) -> DataFrame:
    covered = t.lineitem.where("l_linestatus = 'F'").select(F.col("l_orderkey").alias("link_key"))
    return link.coverage(t.orders, covered, "o_orderkey", F.col("o_orderstatus") == "F").select("expected", "covered")


@query("""WITH first AS (SELECT l_partkey, l_suppkey, row_number() OVER (PARTITION BY l_partkey ORDER BY l_suppkey) AS rn FROM lineitem)
SELECT p_partkey, CAST(s_suppkey AS VARCHAR) AS bridged_key FROM part LEFT JOIN first ON p_partkey = l_partkey AND rn = 1 LEFT JOIN supplier ON l_suppkey = s_suppkey""")
def bridge_lookup(t: Tables) -> DataFrame:
    hops = [link.bridge(t.lineitem, "l_partkey", "l_suppkey", ["l_suppkey"]), link.bridge(t.supplier, "s_suppkey", "s_suppkey", ["s_suppkey"])]
    return link.through(t.part, "p_partkey", hops).select("p_partkey", "bridged_key")


@query("""WITH spine AS (SELECT DISTINCT l_orderkey AS k FROM lineitem)
SELECT COUNT(*) FILTER (WHERE s.k IS NOT NULL) AS direct, COUNT(*) FILTER (WHERE s.k IS NULL AND c.k IS NOT NULL) AS by_fallback, COUNT(*) FILTER (WHERE s.k IS NULL AND c.k IS NULL) AS unlinked
  FROM orders LEFT JOIN spine s ON o_orderkey = s.k LEFT JOIN spine c ON o_orderkey + 1 = c.k""")
def fallback_link(t: Tables) -> DataFrame:
    index = spine_keys(t)
    crosswalk = link.bridge(t.orders.withColumn("other", F.col("o_orderkey") + 1), "o_orderkey", "other", ["other"])
    told = link.with_fallback(link.link(t.orders, "o_orderkey", index), crosswalk, index)
    return told.agg(F.count_if(F.col("linked") & ~F.col("by_fallback")).alias("direct"), F.count_if("by_fallback").alias("by_fallback"), F.count_if(~F.col("linked")).alias("unlinked"))


@query(f"""SELECT COUNT(*) AS orphan_keys, CAST(COALESCE(SUM({GROSS}), 0) AS DOUBLE) AS orphan_amount FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem)""")
def orphan_amounts(t: Tables) -> DataFrame:
    lost = link.orphans(link.link(settled(t), "raw_key", spine_keys(t)), spine_keys(t), "amount")
    return lost.select("orphan_keys", number(F.coalesce("orphan_amount", F.lit(0))).alias("orphan_amount"))


def by_order(t: Tables) -> DataFrame:
    return t.orders.select(F.col("o_orderkey").alias("link_key"), money("o_totalprice").alias("amount"))


@query(f"""WITH s AS (SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, 1.0 / COUNT(*) OVER (PARTITION BY l_orderkey) AS f FROM lineitem)
SELECT l_orderkey, COUNT(*) AS n_lines, ROUND(SUM(f), 6) AS factors FROM s JOIN orders ON l_orderkey = o_orderkey GROUP BY ALL""")
def allocate_even(t: Tables) -> DataFrame:
    spine = allocate.factors(t.lineitem, ["l_orderkey"], "even")
    out = allocate.project(spine, "l_orderkey", by_order(t))
    return out.groupBy("l_orderkey").agg(F.count("*").alias("n_lines"), F.round(F.sum("factor"), 6).alias("factors"))


@query(f"""WITH s AS (SELECT *, GREATEST({PRICE} - CASE WHEN l_returnflag = 'R' THEN {PRICE} ELSE 0 END, 0) AS net FROM lineitem),
  g AS (SELECT *, SUM(net) OVER (PARTITION BY l_orderkey) AS total, COUNT(*) OVER (PARTITION BY l_orderkey) AS n FROM s)
SELECT l_returnflag, COUNT(*) AS n_lines, ROUND(SUM(CASE WHEN total > 0 THEN CAST(net AS DOUBLE) / CAST(total AS DOUBLE) ELSE 1.0 / n END), 4) AS factors FROM g GROUP BY ALL""")
def allocate_ratio(t: Tables) -> DataFrame:
    lines = t.lineitem.withColumn("refund", F.when(F.col("l_returnflag") == "R", F.col("l_extendedprice")).otherwise(F.lit(0.0)))
    spine = allocate.factors(lines, ["l_orderkey"], "ratio", paid="l_extendedprice", refund="refund")
    return spine.groupBy("l_returnflag").agg(F.count("*").alias("n_lines"), F.round(F.sum("factor"), 4).alias("factors"))


@query(f"""SELECT o_orderkey, CAST({GROSS} AS DOUBLE) AS allocated, true AS exact FROM orders WHERE o_orderkey IN (SELECT l_orderkey FROM lineitem)""")
def allocate_exact_remainder(t: Tables) -> DataFrame:
    lines = t.lineitem.join(t.orders.select("o_orderkey", money("o_totalprice").alias("total")), F.col("l_orderkey") == F.col("o_orderkey"))
    out = allocate.exact(lines, ["o_orderkey"], "total", "l_extendedprice", ORDER)
    told = out.groupBy("o_orderkey").agg(F.sum("allocated").alias("allocated"), F.max("total").alias("total"))
    return told.select("o_orderkey", number("allocated").alias("allocated"), (F.col("allocated") == F.col("total")).alias("exact"))


@query(f"""SELECT period, COUNT(*) AS stores, 1000.01 AS overhead FROM (SELECT DISTINCT strftime(o_orderdate, '%Y-%m') AS period, c_mktsegment FROM orders JOIN customer ON o_custkey = c_custkey) GROUP BY ALL""")
def overhead_spread(t: Tables) -> DataFrame:
    basis = t.orders.join(t.customer, F.col("o_custkey") == F.col("c_custkey")).groupBy(text.period("o_orderdate").alias("period"), F.col("c_mktsegment").alias("store")).agg(F.sum(money("o_totalprice")).cast(MONEY).alias("receipts"))
    monthly = basis.select("period").distinct().withColumn("amount", F.lit("1000.01").cast(MONEY))
    out = allocate.overhead(basis, "period", "store", "receipts", monthly)
    return out.groupBy("period").agg(F.count("*").alias("stores"), number(F.sum("amount")).alias("overhead"))


@query(f"""WITH w AS (SELECT l_orderkey AS k, SUM(1) AS w FROM lineitem GROUP BY ALL)
SELECT k IS NOT NULL AS counted, COUNT(*) AS n, CAST(SUM({GROSS} * COALESCE(w, 0)) AS DOUBLE) AS contribution FROM orders LEFT JOIN w ON o_orderkey = k GROUP BY ALL""")
def contribution_marking(t: Tables) -> DataFrame:
    out = allocate.contribution(by_order(t), allocate.factors(t.lineitem, ["l_orderkey"]), "l_orderkey")
    return out.groupBy("counted").agg(F.count("*").alias("n"), number(F.sum("contribution")).alias("contribution"))


def both_sides(t: Tables) -> DataFrame:
    left = t.orders.select(F.col("o_orderkey").alias("business_key"), F.lit("order").alias("side"), money("o_totalprice").alias("amount"))
    return left.unionByName(t.lineitem.select(F.col("l_orderkey").alias("business_key"), F.lit("platform").alias("side"), money("l_extendedprice").alias("amount")))


SIDES = f"""(SELECT o_orderkey AS business_key, 1 AS l, {GROSS} AS la, 0 AS r, 0 AS ra FROM orders UNION ALL SELECT l_orderkey, 0, 0, 1, {PRICE} FROM lineitem)"""


@query(f"""SELECT business_key, CAST(SUM(la) AS DOUBLE) AS left_amount, CAST(SUM(ra) AS DOUBLE) AS right_amount,
  CASE WHEN SUM(l) = 0 OR SUM(r) = 0 THEN 'missing_side' WHEN ABS(SUM(la) - SUM(ra)) <= GREATEST(0.01, CAST(GREATEST(ABS(SUM(la)), ABS(SUM(ra))) * 0.5 AS DECIMAL(30,4))) THEN 'balanced' ELSE 'unbalanced' END AS status FROM {SIDES} GROUP BY ALL""")
def reconcile_order_platform(t: Tables) -> DataFrame:
    out = reconcile.two_sided(both_sides(t), ["business_key"], "side", "amount", "order", "platform", relative="0.5")
    return out.select("business_key", number("left_amount").alias("left_amount"), number("right_amount").alias("right_amount"), "status")


@query(f"""SELECT kind, COUNT(*) AS n FROM (SELECT CASE WHEN SUM(l) = 0 THEN 'right_only' WHEN SUM(r) = 0 THEN 'left_only' WHEN SUM(l) = 1 AND SUM(r) = 1 THEN '1:1' WHEN SUM(l) = 1 THEN '1:N' WHEN SUM(r) = 1 THEN 'N:1' ELSE 'N:M' END AS kind
  FROM {SIDES} GROUP BY business_key) GROUP BY ALL""")
def link_kinds(t: Tables) -> DataFrame:
    return reconcile.two_sided(both_sides(t), ["business_key"], "side", "amount", "order", "platform").groupBy("kind").agg(F.count("*").alias("n"))


@query("""WITH RECURSIVE e AS (SELECT DISTINCT o_custkey AS a, 100000000 + o_orderkey % 3001 AS b FROM orders WHERE o_orderpriority = '1-URGENT' AND o_orderstatus = 'P'),
  p AS (SELECT a, b FROM e UNION SELECT b, a FROM e), r(id, c) AS (SELECT a, a FROM p UNION SELECT p.b, r.c FROM r JOIN p ON p.a = r.id)
SELECT id, MIN(c) AS component FROM r GROUP BY ALL""")
def bridge_components(t: Tables) -> DataFrame:
    edges = t.orders.where("o_orderpriority = '1-URGENT' and o_orderstatus = 'P'").select(F.col("o_custkey").alias("a"), (F.lit(100000000) + F.col("o_orderkey") % 3001).alias("b"))
    return graph.components(edges)


@query("""WITH RECURSIVE e AS (SELECT 2 * o_custkey AS a, 2 * o_orderkey + 1 AS b FROM orders), p AS (SELECT a, b FROM e UNION SELECT b, a FROM e),
  r(id, c) USING KEY (id) AS (SELECT a, MIN(LEAST(a, b)) FROM p GROUP BY a
    UNION SELECT p.a, MIN(r.c) FROM r JOIN p ON p.b = r.id JOIN recurring.r AS had ON had.id = p.a GROUP BY p.a, had.c HAVING MIN(r.c) < had.c)
SELECT id, c AS component FROM r""")
def bridge_components_all(t: Tables) -> DataFrame:
    """Components over the edges of every order; customers are even ids, orders odd ones, so none fall together."""
    return graph.components(t.orders.select((2 * F.col("o_custkey")).alias("a"), (2 * F.col("o_orderkey") + 1).alias("b")))


PURCHASE = "SELECT user_id, ts, MAX(value) AS last_purchase FROM events WHERE event_type = 'purchase' GROUP BY ALL"


@query(f"""SELECT e.event_id, p.last_purchase FROM (SELECT * FROM events WHERE event_type = 'view') e ASOF LEFT JOIN ({PURCHASE}) p ON e.user_id = p.user_id AND e.ts >= p.ts""")
def asof_backward(t: Tables) -> DataFrame:
    bought = t.events.where("event_type = 'purchase'").select("user_id", F.col("ts").alias("since"), F.col("value").alias("last_purchase"))
    return asof.backward(t.events.where("event_type = 'view'").select("event_id", "user_id", "ts"), bought, ["user_id"], "ts", "since", ["last_purchase"], "week").select("event_id", "last_purchase")


@query("""WITH o AS (SELECT o_orderkey, o_custkey % 50 AS item, o_orderdate FROM orders), v AS (SELECT o_custkey % 50 AS item, o_orderdate AS since, MAX(o_orderkey) AS version FROM orders WHERE o_orderstatus = 'P' AND o_custkey % 50 < 20 GROUP BY ALL),
  g AS (SELECT o_orderdate AS since, MAX(o_orderkey) AS version FROM orders WHERE o_orderstatus = 'P' AND o_custkey % 50 >= 20 GROUP BY ALL),
  a AS (SELECT o.*, v.version AS own FROM o ASOF LEFT JOIN v ON o.item = v.item AND o.o_orderdate >= v.since)
SELECT o_orderkey, COALESCE(own, g.version) AS version, CASE WHEN own IS NOT NULL THEN 'item' WHEN g.version IS NOT NULL THEN 'group' ELSE 'none' END AS matched_by FROM a ASOF LEFT JOIN g ON a.o_orderdate >= g.since""")
def asof_fallback(t: Tables) -> DataFrame:
    item = F.col("o_custkey") % 50
    rows = t.orders.select("o_orderkey", item.alias("item"), F.lit("s").alias("store"), "o_orderdate")
    versions = t.orders.where("o_orderstatus = 'P'").select(F.when(item < 20, item).alias("item"), F.lit("s").alias("store"), F.col("o_orderdate").alias("since"), F.col("o_orderkey").alias("version"))
    return asof.with_fallback(rows, versions, "item", "store", "o_orderdate", "since", ["version"]).select("o_orderkey", "version", "matched_by")


@query("""WITH v AS (SELECT p_partkey AS k, p_retailprice AS cost, DATE '1995-01-01' AS f, DATE '1998-01-01' AS u FROM part UNION ALL SELECT p_partkey, p_retailprice + 1, DATE '1997-06-01', NULL FROM part WHERE p_size < 25),
  m AS (SELECT l.l_partkey, l.l_shipdate, COUNT(k) AS n, MAX(cost) AS cost FROM (SELECT DISTINCT l_partkey, l_shipdate FROM lineitem) l LEFT JOIN v ON k = l_partkey AND f <= l_shipdate AND (u IS NULL OR l_shipdate < u) GROUP BY ALL)
SELECT CASE WHEN n = 0 THEN 'absent' WHEN n > 1 THEN 'overlapping' ELSE 'found' END AS status, COUNT(*) AS n_lines, CAST(SUM(CASE WHEN n = 1 THEN CAST(cost AS DECIMAL(20,4)) ELSE 0 END) AS DOUBLE) AS cost
  FROM lineitem JOIN m USING (l_partkey, l_shipdate) GROUP BY ALL""")
def interval_cost_lookup(t: Tables) -> DataFrame:
    day = lambda d: F.lit(d).cast("timestamp")
    first = t.part.select("p_partkey", F.col("p_retailprice").alias("cost"), day("1995-01-01").alias("since"), day("1998-01-01").alias("until"))
    second = t.part.where("p_size < 25").select("p_partkey", (F.col("p_retailprice") + 1).alias("cost"), day("1997-06-01").alias("since"), F.lit(None).cast("timestamp").alias("until"))
    versions = first.union(second).withColumnRenamed("p_partkey", "l_partkey")
    out = asof.interval(t.lineitem.select("l_partkey", "l_shipdate"), versions, "l_partkey", "l_shipdate", "since", "until", "cost")
    return out.groupBy("status").agg(F.count("*").alias("n_lines"), number(F.sum(F.coalesce(money("cost"), F.lit(0).cast(MONEY)))).alias("cost"))


@query("""SELECT o_custkey, arg_max(o_orderpriority, (o_orderdate, o_orderkey)) AS priority FROM orders WHERE o_orderdate <= TIMESTAMP '1998-06-30' GROUP BY ALL""")
def latest_owner(t: Tables) -> DataFrame:
    owners = t.orders.select("o_custkey", F.struct("o_orderdate", "o_orderkey").alias("since"), F.col("o_orderpriority").alias("priority"), "o_orderdate")
    return asof.owners_at(owners.where("o_orderdate <= '1998-06-30'").withColumn("since", F.concat(F.date_format("o_orderdate", "yyyyMMdd"), F.lpad(F.col("since.o_orderkey").cast("string"), 20, "0"))), "99999999", "o_custkey", "since", ["priority"])


@query(f"""SELECT person, CAST(SUM(CAST({PRICE} * share AS DECIMAL(26,6))) AS DOUBLE) AS part, COUNT(DISTINCT l_partkey) AS products
  FROM lineitem JOIN (SELECT s_suppkey, 'a' AS person, 0.6 AS share FROM supplier UNION ALL SELECT s_suppkey, 'b', 0.4 FROM supplier WHERE s_nationkey < 12) ON l_suppkey = s_suppkey GROUP BY ALL""")
def split_to_people(t: Tables) -> DataFrame:
    shares = t.supplier.select(F.col("s_suppkey").alias("l_suppkey"), F.lit("a").alias("person"), F.lit("0.6").alias("share")).union(t.supplier.where("s_nationkey < 12").select("s_suppkey", F.lit("b"), F.lit("0.4")))
    out = asof.split(t.lineitem, shares, ["l_suppkey"], "l_extendedprice", "share")
    return out.groupBy("person").agg(number(F.sum("part")).alias("part"), F.count_distinct("l_partkey").alias("products"))


@query(f"""SELECT l_orderkey, CAST(SUM(CASE WHEN l_returnflag = 'R' THEN -{PRICE} ELSE {PRICE} END) AS DOUBLE) AS deducted, CAST(GREATEST(SUM(CASE WHEN l_returnflag = 'R' THEN -{PRICE} ELSE {PRICE} END), 0) AS DOUBLE) AS skipped FROM lineitem GROUP BY ALL""")
def loss_policy(t: Tables) -> DataFrame:
    base = t.lineitem.groupBy("l_orderkey").agg(F.sum(F.when(F.col("l_returnflag") == "R", -money("l_extendedprice")).otherwise(money("l_extendedprice"))).cast(MONEY).alias("base"))
    return base.select("l_orderkey", number(allocate.loss_policy(F.col("base"))).alias("deducted"), number(allocate.loss_policy(F.col("base"), "skip")).alias("skipped"))


@query(f"""SELECT l_returnflag, COUNT(*) FILTER (WHERE l_tax <> 0) AS found_count, CAST(SUM({AMOUNT.format("l_tax")}) AS DOUBLE) AS found_sum, COUNT(*) FILTER (WHERE l_tax <> 0) = COUNT(*) AS ok FROM lineitem GROUP BY ALL""")
def control_total_check(t: Tables) -> DataFrame:
    declared = t.lineitem.groupBy("l_returnflag").agg(F.count("*").alias("declared_count"), F.sum(money("l_tax")).alias("declared_sum"))
    return reconcile.control_check(t.lineitem, declared, ["l_returnflag"], "l_tax").select("l_returnflag", "found_count", number("found_sum").alias("found_sum"), "ok")


def eq(field: str, value: str, sign: int = 1) -> dict:
    return {"select": {"field": field, "op": "eq", "value": value}, "sign": sign}


def flag(f: str) -> str:
    return f"SUM(CASE WHEN l_returnflag = '{f}' THEN {PRICE} ELSE 0 END)"


@query(f"""SELECT l_linestatus, CAST({flag("A")} AS DOUBLE) AS left_total, CAST({flag("R")} AS DOUBLE) AS right_total, ABS({flag("A")} - {flag("R")}) <= GREATEST(0.01, CAST(GREATEST(ABS({flag("A")}), ABS({flag("R")})) * 0.02 AS DECIMAL(30,4))) AS holds FROM lineitem GROUP BY ALL""")
def invariant_equality(t: Tables) -> DataFrame:
    out = invariants.equality(t.lineitem, ["l_linestatus"], eq("l_returnflag", "A"), eq("l_returnflag", "R"), "l_extendedprice", relative="0.02")
    return out.select("l_linestatus", number("left_total").alias("left_total"), number("right_total").alias("right_total"), "holds")


@query(f"""SELECT l_linestatus, CAST({flag("A")} + {flag("N")} AS DOUBLE) AS left_total, CAST({flag("R")} AS DOUBLE) AS right_total FROM lineitem GROUP BY ALL""")
def invariant_conservation(t: Tables) -> DataFrame:
    out = invariants.conservation(t.lineitem, ["l_linestatus"], [eq("l_returnflag", "A"), eq("l_returnflag", "N")], [eq("l_returnflag", "R")], "l_extendedprice")
    return out.select("l_linestatus", number("left_total").alias("left_total"), number("right_total").alias("right_total"))


@query(f"""SELECT l_linestatus, CAST({flag("A")} AS DOUBLE) AS left_total, CAST(CAST({flag("R")} AS DECIMAL(24,4)) * 0.5 AS DOUBLE) AS right_total FROM lineitem GROUP BY ALL""")
def invariant_proportionality(t: Tables) -> DataFrame:
    out = invariants.proportionality(t.lineitem, ["l_linestatus"], eq("l_returnflag", "A"), eq("l_returnflag", "R"), "0.5", "l_extendedprice")
    return out.select("l_linestatus", number("left_total").alias("left_total"), number("right_total").alias("right_total"))


@query("""SELECT l_returnflag, COUNT(*) FILTER (WHERE n > 1) AS repeated, CAST(SUM(n) AS BIGINT) AS n_rows FROM (SELECT l_returnflag, l_orderkey, l_linenumber, COUNT(*) AS n FROM lineitem GROUP BY ALL) GROUP BY ALL""")
def invariant_uniqueness(t: Tables) -> DataFrame:
    out = invariants.uniqueness(t.lineitem, ["l_returnflag"], ["l_orderkey", "l_linenumber"])
    return out.select("l_returnflag", "repeated", F.col("left_total").cast("long").alias("n_rows"))


@query("""SELECT o_orderstatus, COUNT(*) AS needed, COUNT(*) FILTER (WHERE k IS NULL) AS missing FROM orders LEFT JOIN (SELECT DISTINCT l_orderkey AS k FROM lineitem) ON o_orderkey = k GROUP BY ALL""")
def invariant_completeness(t: Tables) -> DataFrame:
    left = t.orders.select("o_orderstatus", F.col("o_orderkey").alias("key"))
    return invariants.completeness(left, t.lineitem.select(F.col("l_orderkey").alias("key")), ["key"], ["o_orderstatus"]).select("o_orderstatus", "needed", "missing")


@query(f"""SELECT c_mktsegment AS store, CAST(MAX(d) AS DOUBLE) AS largest, CAST(SUM(d) AS DOUBLE) AS cumulative, concat_ws(',', CASE WHEN MAX(d) >= 450000 THEN 'single_item' END, CASE WHEN SUM(d) >= 100000000 THEN 'cumulative' END, CASE WHEN SUM(d) >= 0.1 * MAX({AMOUNT.format("c_acctbal")}) AND MAX({AMOUNT.format("c_acctbal")}) > 0 THEN 'revenue_share' END) AS reasons
  FROM (SELECT c_mktsegment, c_acctbal, {GROSS} AS d FROM orders JOIN customer ON o_custkey = c_custkey) GROUP BY ALL""")
def materiality_legs(t: Tables) -> DataFrame:
    rows = t.orders.join(t.customer, F.col("o_custkey") == F.col("c_custkey")).withColumnRenamed("c_mktsegment", "store")
    out = invariants.materiality(rows, "o_totalprice", ["store"], "c_acctbal", "450000", "100000000", "0.1")
    return out.select("store", number("largest").alias("largest"), number("cumulative").alias("cumulative"), "reasons")


@query("""SELECT CASE WHEN o_orderstatus = 'F' AND o_totalprice > 1000 AND NOT o_totalprice > 400000 THEN 'certified' WHEN o_totalprice > 1000 AND o_orderpriority LIKE '1%' THEN 'conditional' ELSE 'unverified' END AS tier, COUNT(*) AS n FROM orders GROUP BY ALL""")
def trust_tiers(t: Tables) -> DataFrame:
    price = F.col("o_totalprice")
    tier = invariants.trust_tier(F.col("o_orderstatus") == "F", price > 1000, price > 400000, F.col("o_orderpriority").startswith("1"))
    return t.orders.groupBy(tier.alias("tier")).agg(F.count("*").alias("n"))


YEARLY = "(SELECT o_custkey, CAST(SUM({v}) AS DECIMAL(20,4)) AS v FROM orders WHERE year(o_orderdate) = {y} GROUP BY ALL)"


@query(f"""SELECT CASE WHEN h.v IS NULL THEN 'current_only' WHEN c.v IS NULL THEN 'historical_only' WHEN c.v = h.v THEN 'equal' WHEN ABS(c.v - h.v) <= 0.0001 THEN 'float_tail' WHEN ABS(c.v - h.v) <= 0.05 THEN 'rounding' ELSE 'true_difference' END AS difference, COUNT(*) AS n
  FROM {YEARLY.format(v=GROSS, y=1997)} c FULL JOIN {YEARLY.format(v=GROSS, y=1998)} h USING (o_custkey) GROUP BY ALL""")
def diff_classes(t: Tables) -> DataFrame:
    yearly = lambda y: t.orders.where(F.year("o_orderdate") == y).groupBy("o_custkey").agg(F.sum(money("o_totalprice")).alias("v"))
    return reconcile.compare(yearly(1997), yearly(1998), ["o_custkey"], "v").groupBy("difference").agg(F.count("*").alias("n"))


def outcomes(t: Tables, least: int) -> DataFrame:
    return t.orders.select("o_orderkey", F.when(F.col("o_totalprice") > least, "unresolved").otherwise("resolved").alias("status"), money("o_totalprice").alias("exposure"))


@query("""SELECT CASE WHEN o_totalprice > 200000 AND o_totalprice <= 300000 THEN 'newly_resolved' ELSE 'unchanged' END AS change, COUNT(*) AS n FROM orders GROUP BY ALL""")
def experiment_compare(t: Tables) -> DataFrame:
    return invariants.compare_outcomes(outcomes(t, 200000), outcomes(t, 300000), "o_orderkey", "status", "exposure").groupBy("change").agg(F.count("*").alias("n"))


@query("""SELECT COUNT(*) FILTER (WHERE o_totalprice > 200000 AND o_totalprice <= 300000) AS newly_resolved, CAST(0 AS BIGINT) AS newly_unresolved, CASE WHEN COUNT(*) FILTER (WHERE o_totalprice > 200000 AND o_totalprice <= 300000) > 0 THEN 'supported' ELSE 'inconclusive' END AS verdict FROM orders""")
def experiment_verdict(t: Tables) -> DataFrame:
    told = invariants.compare_outcomes(outcomes(t, 200000), outcomes(t, 300000), "o_orderkey", "status", "exposure")
    return invariants.experiment(told).select("newly_resolved", "newly_unresolved", "verdict")


@query(f"""SELECT CASE WHEN d > 0 THEN '+' WHEN d < 0 THEN '-' ELSE '0' END || '|' || CASE WHEN ABS(d) < 1 THEN 0 ELSE len(CAST(CAST(FLOOR(ABS(d)) AS BIGINT) AS VARCHAR)) END || '|D|' || l_returnflag AS situation, COUNT(*) AS n
  FROM (SELECT {PRICE} - 50000 AS d, l_returnflag FROM lineitem) GROUP BY ALL""")
def fingerprint_buckets(t: Tables) -> DataFrame:
    situation = invariants.situation(money("l_extendedprice") - 50000, F.col("l_orderkey"), F.col("l_returnflag"))
    return t.lineitem.groupBy(situation.alias("situation")).agg(F.count("*").alias("n"))
