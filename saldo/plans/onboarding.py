"""Taking in tables nobody has described yet: profiles, roles, totals, wallets, uploads and reviews."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from saldo.functions import rules, text, wallet
from saldo.functions.money import MONEY, money
from saldo.operators import invariants, profile, upload
from saldo.plans.ledger import AMOUNT, GROSS, PRICE, number
from saldo.plans.readmodels import ORDERS, orders_of
from saldo.plans.registry import Tables, query
from saldo.sources import model, tables
from saldo.sources.shared import new_folder

KEY = "CAST(l_orderkey AS VARCHAR)"


def with_totals(t: Tables) -> DataFrame:
    """Lines by order as people keep them: a total row under each return flag; that of R says one more than its lines."""
    lines = t.lineitem.select("l_returnflag", F.col("l_orderkey").cast("string").alias("marker"), money("l_extendedprice").cast("string").alias("paid"), money("l_tax").cast("string").alias("tax"))
    totals = t.lineitem.groupBy("l_returnflag").agg(F.lit(" 合计 ").alias("marker"), (F.sum(money("l_extendedprice")) + F.when(F.first("l_returnflag") == "R", F.lit("1").cast(MONEY)).otherwise(F.lit(0).cast(MONEY))).cast("string").alias("paid"), F.sum(money("l_tax")).cast("string").alias("tax"))
    return lines.union(totals)


@query(f"""SELECT l_returnflag, COUNT(*) AS n, CAST(SUM({PRICE}) AS DOUBLE) AS paid FROM lineitem GROUP BY ALL""")
def without_total_rows(t: Tables) -> DataFrame:
    details, _ = profile.without_totals(with_totals(t), "marker")
    return details.groupBy("l_returnflag").agg(F.count("*").alias("n"), number(F.sum(F.col("paid").cast(MONEY))).alias("paid"))


@query(f"""SELECT l_returnflag, 'paid' AS "column", CAST(SUM({PRICE}) + 1 AS DOUBLE) AS declared, CAST(SUM({PRICE}) AS DOUBLE) AS found, 1.0::DOUBLE AS gap FROM lineitem WHERE l_returnflag = 'R' GROUP BY ALL""")
def total_row_gaps(t: Tables) -> DataFrame:
    out = profile.total_gaps(with_totals(t), "marker", ["paid", "tax"], ["l_returnflag"])
    return out.select("l_returnflag", "column", *[number(c).alias(c) for c in ("declared", "found", "gap")])


@query("""SELECT o_orderkey, strftime(CASE WHEN o_orderkey % 3 = 0 AND o_orderkey % 4 = 0 THEN NULL ELSE o_orderdate END, '%Y-%m-%d') AS paid_at, CASE WHEN o_orderkey % 3 <> 0 THEN 'paid_at' WHEN o_orderkey % 4 <> 0 THEN 'order_id' END AS paid_at_from FROM orders""")
def time_from_fallbacks(t: Tables) -> DataFrame:
    day = F.col("o_orderdate")
    rows = t.orders.select("o_orderkey", F.when(F.col("o_orderkey") % 3 != 0, F.date_format(day, "yyyy/M/d HH:mm")).alias("paid_at"), F.when(F.col("o_orderkey") % 4 != 0, F.concat(F.lit("No."), F.date_format(day, "yyyyMMdd"), F.lit("-"), F.col("o_orderkey"))).alias("order_id"))
    out = profile.time_slots(rows, "paid_at", [("order_id", r"No\.(\d{8})-")])
    return out.select("o_orderkey", F.date_format("paid_at", "yyyy-MM-dd").alias("paid_at"), "paid_at_from")


@query("""SELECT p_partkey, CASE WHEN p_partkey % 3 = 0 THEN 'North Store 2' WHEN p_partkey % 3 = 1 THEN 'North Store' END AS store, CASE WHEN p_partkey % 2 = 0 THEN '2024-05' ELSE '2026-06' END AS period FROM part""")
def hints_of_file_names(t: Tables) -> DataFrame:
    k = F.col("p_partkey")
    name = F.concat(F.when(k % 3 == 0, "x North　Store 2 ").when(k % 3 == 1, "NorthStore-").otherwise("South "), F.when(k % 2 == 0, "2024年5月").otherwise("v2606"), F.lit(".csv"))
    rows = t.part.select("p_partkey", name.alias("file"))
    return model.with_hints(rows, "file", profile.store_in("file", ["North Store", "North Store 2", " "]), text.period_in("file")).select("p_partkey", "store", "period")


@query("""SELECT p_partkey % 7 AS file, MIN(CASE WHEN p_partkey // 7 % 4 = 3 THEN p_partkey // 7 END) AS header_row, 1 AS template FROM part WHERE p_partkey // 7 <= 30 GROUP BY ALL""")
def header_rows_found(t: Tables) -> DataFrame:
    at = F.floor(F.col("p_partkey") / 7)
    cells = F.when(at % 4 == 3, F.array(F.lit(" order id"), F.lit("（paid）"), F.lit("sku"))).when(at % 4 == 1, F.array(F.lit("order id"), F.lit("x"), F.lit(None).cast("string"))).otherwise(F.array(F.lit("1"), F.lit("2"), F.lit("3")))
    rows = t.part.select((F.col("p_partkey") % 7).alias("file"), at.alias("row_no"), cells.alias("cells"))
    return profile.header_row(rows, "file", "row_no", "cells", [["order id", "(paid)"], ["order id", "(paid)", "sku"]])


@query("""SELECT name, kind, CAST(n AS BIGINT) AS rows, CAST(filled AS BIGINT) AS filled, ROUND(CAST(n - filled AS DOUBLE) / n, 6) AS empty_share FROM (
 SELECT 'ts' AS name, 'time' AS kind, COUNT(*) AS n, COUNT(ts) AS filled FROM events UNION ALL SELECT 'value', 'number', COUNT(*), COUNT(value) FROM events UNION ALL SELECT 'event_type', 'text', COUNT(*), COUNT(event_type) FROM events
 UNION ALL SELECT 'even', 'id', COUNT(*), COUNT(*) FILTER (WHERE event_id % 2 = 0) FROM events)""")
def column_profile(t: Tables) -> DataFrame:
    rows = t.events.select(F.date_format("ts", "yyyy-MM-dd HH:mm:ss").alias("ts"), F.col("value").cast("decimal(20,4)").alias("value"), "event_type", F.when(F.col("event_id") % 2 == 0, F.lpad(F.col("event_id").cast("string"), 12, "9")).alias("even"))
    return profile.profile(rows, ["ts", "value", "event_type", "even"]).drop("samples")


@query("""SELECT 'amount' AS role, COUNT(*) AS rows, COUNT(*) AS filled, COUNT(*) FILTER (WHERE event_id % 50 = 0) AS failed FROM events UNION ALL SELECT 'time', COUNT(*), COUNT(ts), 0 FROM events""")
def template_dry_run(t: Tables) -> DataFrame:
    rows = t.events.select(F.when(F.col("event_id") % 50 == 0, "n.a.x").otherwise(F.col("value").cast("decimal(20,4)").cast("string")).alias("v"), F.date_format("ts", "yyyy/M/d H:mm").alias("at"))
    return profile.dry_run(rows, {"amount": ("v", "number"), "time": ("at", "time")}).drop("ok")


REMARKS = ["订单123打款", "订单9退款", "品牌新享-首单拉新计划A", "x品牌新享天猫新客营销托管", "阿里妈妈无界账户充值", "淘宝平台提现", "保证金额度不足充值", "卖家保证金充值 订单编号：1234567890123456789", " ", "其他"]
MEANINGS = ["0010001|交易收款-交易收款", "0020001|交易退款-余额退款", "品牌新享-首单拉新计划", "品牌新享天猫新客营销托管", "万相台", "其他支出\\收入", "保证金额度不足充值", "保证金充值", None, None]
CASES = " ".join(f"WHEN {i} THEN '{m}'" for i, m in enumerate(MEANINGS) if m)


@query(f"""SELECT event_id, CASE event_id % 10 {CASES} END AS meaning, CASE WHEN event_id % 7 = 0 THEN lpad(CAST(event_id AS VARCHAR), 19, '0') WHEN event_id % 7 = 1 THEN lpad(CAST(event_id AS VARCHAR), 19, '1') WHEN event_id % 7 = 2 THEN NULL WHEN event_id % 10 = 7 THEN '1234567890123456789' END AS order_key,
 CASE WHEN event_id % 7 IN (0, 1) THEN 'found' WHEN event_id % 7 = 2 THEN 'ambiguous' WHEN event_id % 10 = 7 THEN 'found' ELSE 'missing' END AS status FROM events""")
def wallet_rows(t: Tables) -> DataFrame:
    k = F.col("event_id").cast("string")
    prefixed = lambda mark: F.concat(F.lit("T200P"), F.lpad(k, 19, mark))
    merchant = F.when(F.col("event_id") % 7 == 0, F.lpad(k, 19, "0")).when(F.col("event_id") % 7 == 1, F.concat(F.lit("t"), F.substring(prefixed("1"), 2, 99))).when(F.col("event_id") % 7 == 2, F.concat_ws(",", prefixed("2"), prefixed("3")))
    remark = F.element_at(F.array(*map(F.lit, REMARKS)), (F.col("event_id") % 10 + 1).cast("int"))
    rows = t.events.select("event_id", merchant.alias("merchant"), remark.alias("remark"))
    rows = rows.withColumn("meaning", wallet.description("remark")[1])
    key, status = wallet.order_key("merchant", "remark", "meaning")
    return rows.select("event_id", "meaning", key.alias("order_key"), status.alias("status"))


@query("""SELECT event_id, CASE WHEN event_type = 'error' THEN 'penalty' WHEN event_type IN ('view', 'click') THEN 'traffic' WHEN value > 90 THEN 'large' ELSE 'rest' END AS major FROM events""")
def overlaid_rules(t: Tables) -> DataFrame:
    fees = [
        {"platform": "*", "stage": "after", "priority": 2, "how": "always", "column": "event_type", "major": "rest"}, {"platform": "web", "stage": "before", "priority": 1, "column": "event_type", "how": "equals", "value": "error", "major": "penalty"},
        {"platform": "app", "stage": "before", "priority": 0, "column": "event_type", "how": "always", "major": "never"}, {"platform": "web", "stage": "after", "priority": 1, "when": {"field": "value", "op": "range", "value": ["90.0001", "1000000"]}, "major": "large"},
    ]
    template = [{"column": "event_type", "how": "equals", "value": ["view", "click", "error"], "major": "traffic"}]
    return rules.classify(t.events, model.overlaid(template, fees, "web"), ["major"]).select("event_id", "major")


@query("""SELECT p_partkey, CASE WHEN p_partkey % 10 = 0 THEN 'removed' WHEN p_partkey % 10 = 1 THEN 'added' ELSE 'changed' END AS change FROM part WHERE p_partkey % 10 IN (0, 1) OR p_size % 2 = 0""")
def fee_rule_changes(t: Tables) -> DataFrame:
    wanted = t.part.where("p_partkey % 10 <> 0").withColumn("p_size", F.when(F.col("p_size") % 2 == 0, F.col("p_size") + 1).otherwise(F.col("p_size")))
    return model.fee_changes(wanted, t.part.where("p_partkey % 10 <> 1"), ["p_partkey"], ["p_brand", "p_size"])


@query(f"""SELECT o_custkey AS file, CASE WHEN o_orderstatus = 'F' THEN '支出合计' ELSE '收入合计' END AS label, CASE WHEN o_orderkey % 2 = 0 THEN o_orderkey END AS count, CAST(CASE WHEN o_orderstatus = 'F' THEN -{GROSS} ELSE {GROSS} END AS DOUBLE) AS amount, CASE WHEN o_orderstatus = 'F' THEN 'outgo' ELSE 'income' END AS direction FROM orders WHERE o_orderstatus <> 'P'""")
def embedded_control_totals(t: Tables) -> DataFrame:
    counted = F.when(F.col("o_orderkey") % 2 == 0, F.concat(F.format_number("o_orderkey", 0), F.lit("笔，共"))).otherwise("")
    line = F.when(F.col("o_orderstatus") == "P", F.concat(F.lit("支出合计："), counted, F.lit("1元"))).otherwise(F.concat(F.lit("# "), F.when(F.col("o_orderstatus") == "F", F.concat(F.lit("支出合计："), counted, F.lit("-"))).otherwise(F.concat(F.lit("收入合计："), counted)), F.format_number("o_totalprice", 2), F.lit("元")))
    out = model.control_totals(t.orders.select(F.col("o_custkey").alias("file"), line.alias("line")), "file", "line")
    return out.withColumn("amount", number("amount"))


@query("""SELECT p_partkey % 20 AS file, COUNT(*) AS lines, COUNT(*) FILTER (WHERE p_size % 10 = 1) AS blank, COUNT(*) FILTER (WHERE p_size % 10 = 2) AS comments, 3 AS fields, COUNT(*) FILTER (WHERE p_size % 10 = 3) AS odd_lines FROM part GROUP BY ALL""")
def line_structure(t: Tables) -> DataFrame:
    line = F.when(F.col("p_size") % 10 == 1, " ").when(F.col("p_size") % 10 == 2, "# a,b").when(F.col("p_size") % 10 == 3, "a,b").otherwise("a,b,")
    return profile.structure(t.part.select((F.col("p_partkey") % 20).alias("file"), line.alias("line")), "file", "line")


@query("""SELECT event_id FROM events WHERE event_type = 'error' AND props LIKE '%"k": 1%'""")
def drill_narrowed(t: Tables) -> DataFrame:
    return profile.narrowed(t.events, event_type="error", keyword='"K": 1', user_id=None).select("event_id")


@query("""SELECT event_id, m AS metric_id FROM (SELECT event_id, event_type, unnest(['fees', 'sales', 'all']) AS m FROM events) WHERE m = 'all' OR m = 'fees' AND event_type = 'error' OR m = 'sales' AND event_type = 'purchase'""")
def claimed_facts(t: Tables) -> DataFrame:
    facts = t.events.select("event_id", F.col("event_type").alias("major"), F.explode(F.array(*map(F.lit, ("fees", "sales", "all")))).alias("metric_id"))
    metrics = t.spark.createDataFrame([("fees", "error"), ("sales", "purchase"), ("all", None)], "metric_id string, major string")
    return profile.claimed(facts, metrics).select("event_id", "metric_id")


@query(f"""WITH r AS (SELECT user_id % 50 AS k, date_trunc('hour', ts) - CASE WHEN event_id % 3 = 2 THEN INTERVAL 0 HOUR ELSE INTERVAL 8 HOUR END AS h, {AMOUNT.format("ROUND(value, 0)")} AS v, event_id, event_type FROM events)
SELECT MIN(event_id) AS event_id, CAST(k AS VARCHAR) AS business_key, strftime(h, '%Y-%m-%d %H:%M:%S') AS occurred_at, CAST(v - 20 AS DOUBLE) AS paid, CAST(-v AS DOUBLE) AS fee, 0.0::DOUBLE AS freight, 'CNY' AS currency, CAST(arg_min(CASE WHEN event_type = 'error' THEN 1 ELSE 0 END, event_id) AS BIGINT) AS unread FROM r GROUP BY k, h, v""")
def canonical_upload(t: Tables) -> DataFrame:
    local = F.date_format(F.date_trunc("hour", "ts"), "yyyy/M/d HH:mm:ss")
    at = F.when(F.col("event_id") % 3 == 0, local).when(F.col("event_id") % 3 == 1, F.concat(F.translate(local, "/ ", "-T"), F.lit("+08:00"))).otherwise(F.concat(local, F.lit("Z")))
    rows = t.events.select("event_id", F.concat(F.lit("@"), (F.col("user_id") % 50).cast("string"), F.lit(".0")).alias("key"), at.alias("at"), F.concat(F.lit("¥"), F.round("value", 0).cast("decimal(20,4)") - 20).alias("paid"), F.round("value", 0).cast("decimal(20,4)").alias("fee"), F.when(F.col("event_type") == "error", "n/k").otherwise(" ").alias("tip"), F.lit(" ").alias("currency"))
    out = upload.canonical(rows, "key", "at", {"paid": "as_is", "fee": "negative", "freight": "as_is", "tip": "as_is"}, ["business_key", "occurred_at", "paid"], ["event_id"], zone="Asia/Shanghai", defaults={"currency": "CNY"})
    return out.select("event_id", "business_key", F.substring(F.col("occurred_at").cast("string"), 1, 19).alias("occurred_at"), *[number(c).alias(c) for c in ("paid", "fee", "freight")], "currency", F.col("unread").cast("bigint").alias("unread"))


@query("""SELECT * FROM (VALUES ('row_count', (SELECT COUNT(*) FROM orders)::DOUBLE, true), ('valid_time', (SELECT ROUND(AVG(CASE WHEN o_orderkey % 4 <> 0 THEN 1.0 ELSE 0.0 END), 6) FROM orders), false), ('amount_format', 1.0, true), ('scope', 1.0, true), ('key_present', 1.0, true), ('duplicate_keys', (SELECT COUNT(*) - COUNT(DISTINCT o_custkey) FROM orders)::DOUBLE, false), ('amount_signs', 1.0, true),
 ('cross_source', (SELECT COUNT(DISTINCT o_custkey) FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_custkey % 10 <> 0))::DOUBLE, (SELECT COUNT(DISTINCT o_custkey) FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_custkey % 10 <> 0)) = 0)) AS v(gate, value, passed)""")
def upload_gates(t: Tables) -> DataFrame:
    rows = t.orders.select(F.col("o_custkey").cast("string").alias("k"), F.when(F.col("o_orderkey") % 4 != 0, F.col("o_orderdate")).alias("at"), money("o_totalprice").alias("v"), F.col("o_orderpriority").alias("store"))
    known = t.customer.where("c_custkey % 10 <> 0").select(F.col("c_custkey").cast("string").alias("k"))
    return upload.upload_gates(rows, "k", "at", "v", ["store"], known)


SIGNED = f"CASE WHEN o_orderstatus = 'F' THEN -{GROSS} ELSE {GROSS} END"


@query(f"""SELECT store, COUNT(*) AS rows, COUNT(DISTINCT o_custkey) AS keys, CAST(SUM(CASE WHEN o_orderstatus <> 'F' THEN {GROSS} ELSE 0 END) AS DOUBLE) AS incoming, CAST(SUM(CASE WHEN o_orderstatus = 'F' THEN -{GROSS} ELSE 0 END) AS DOUBLE) AS outgoing, CAST(SUM({SIGNED}) AS DOUBLE) AS net, strftime(MIN(o_orderdate), '%Y-%m-%d') AS first_at, strftime(MAX(o_orderdate), '%Y-%m-%d') AS last_at FROM {ORDERS} GROUP BY ALL""")
def upload_summary(t: Tables) -> DataFrame:
    rows = orders_of(t).withColumn("v", F.when(F.col("o_orderstatus") == "F", (-F.col("gross")).cast(MONEY)).otherwise(F.col("gross")))
    out = upload.upload_summary(rows, ["store"], "o_custkey", "o_orderdate", "v")
    return out.select("store", "rows", "keys", *[number(c).alias(c) for c in ("incoming", "outgoing", "net")], *[F.date_format(c, "yyyy-MM-dd").alias(c) for c in ("first_at", "last_at")])


SUMS = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]


@query(f"""SELECT l_returnflag, {", ".join(f"CAST(SUM({AMOUNT.format(c)}) AS DOUBLE) AS {c}" for c in SUMS)}, COUNT(DISTINCT l_orderkey) AS orders FROM lineitem GROUP BY ALL""")
def amount_registry(t: Tables) -> DataFrame:
    out = upload.amounts(t.lineitem, ["l_returnflag"], SUMS, "l_orderkey")
    return out.select("l_returnflag", *[number(c).alias(c) for c in SUMS], "orders")


@query(f"""WITH r AS (SELECT CASE WHEN o_orderkey % 9 = 0 THEN NULL ELSE o_custkey END AS k, {GROSS} AS v FROM orders), o AS (SELECT k, MIN(v) AS v, COUNT(*) AS n FROM r WHERE k IS NOT NULL GROUP BY ALL)
SELECT (SELECT COUNT(*) FROM r) AS rows, (SELECT COUNT(*) FROM r WHERE k IS NULL) AS blank_keys, COUNT(*) AS keys, CAST(SUM(v) AS DOUBLE) AS amount, CAST(SUM(n - 1) AS BIGINT) AS repeats FROM o""")
def edge_recomputed(t: Tables) -> DataFrame:
    rows = t.orders.select(F.when(F.col("o_orderkey") % 9 == 0, "'").otherwise(F.concat(F.lit("@"), F.col("o_custkey"))).alias("k"), F.concat(F.lit("¥"), F.format_number(money("o_totalprice"), 4)).alias("v"))
    return upload.recomputed(rows, "k", "v").withColumn("amount", number("amount"))


@query("""SELECT n_nationkey, CASE WHEN n_regionkey = 0 THEN 'Africa main' WHEN n_regionkey = 1 THEN 'Americas' ELSE 'region ' || n_regionkey END AS store FROM nation""")
def store_aliases(t: Tables) -> DataFrame:
    aliases = t.spark.createDataFrame([("region 0", "Africa main"), ("region 1", "Americas"), ("region 1", "Americas of old")], "alias string, store string")
    return upload.own_store(t.nation.select("n_nationkey", F.concat(F.lit(" region "), F.col("n_regionkey"), F.lit(" ")).alias("store")), aliases, "store")


@query("""SELECT s_suppkey, CASE WHEN s_suppkey % 4 = 0 THEN 'tmall' WHEN s_suppkey % 4 = 1 THEN 'pdd' WHEN s_suppkey % 4 = 2 THEN '1688' ELSE 'unknown' END AS platform FROM supplier""")
def platform_ladder(t: Tables) -> DataFrame:
    k = F.col("s_suppkey")
    rows = t.supplier.select("s_suppkey", F.when(k % 4 == 0, F.concat(F.lit("TM-"), k)).when(k % 4 == 1, F.concat(k, F.lit("-pdd"))).otherwise(" ").alias("name"), F.when(k % 4 == 2, F.concat(F.lit("1688_"), k)).otherwise(k.cast("string")).alias("store_id"))
    return rows.select("s_suppkey", upload.platform_of("name", "store_id", [("starts", "TM-", "tmall"), ("ends", "-pdd", "pdd"), ("starts", "1688_", "1688")]).alias("platform"))


@query("""SELECT c_custkey, arg_max(o_orderkey, o_orderkey) AS newest FROM customer LEFT JOIN orders ON c_custkey = o_custkey GROUP BY ALL""")
def latest_profiles(t: Tables) -> DataFrame:
    profiles = t.orders.select(F.col("o_custkey").alias("c_custkey"), "o_orderkey")
    return upload.with_latest_profile(t.customer.select("c_custkey"), profiles, "c_custkey", "o_orderkey").select("c_custkey", F.col("profile.o_orderkey").alias("newest"))


@query("""SELECT o_orderkey, l_linenumber AS ordinal, l_partkey, p_brand FROM orders JOIN lineitem ON o_orderkey = l_orderkey JOIN part ON l_partkey = p_partkey WHERE o_orderstatus = 'P'""")
def evidence_gathered(t: Tables) -> DataFrame:
    bindings = t.lineitem.select(F.col("l_orderkey").alias("o_orderkey"), "l_partkey", F.col("l_linenumber").alias("ordinal"))
    records = t.part.select(F.col("p_partkey").alias("l_partkey"), "p_brand")
    return upload.evidence_of(t.orders.where("o_orderstatus = 'P'"), bindings, records, "o_orderkey", "l_partkey").select("o_orderkey", "ordinal", "l_partkey", "p_brand")


@query(f"""WITH s AS (SELECT period, store, bool_and(o_orderstatus <> 'P') AS ok, SUM({GROSS}) AS v FROM {ORDERS} GROUP BY ALL) SELECT period, COUNT(*) AS stores, COUNT(*) FILTER (WHERE ok) AS complete_stores, CAST(SUM(v) FILTER (WHERE ok) AS DOUBLE) AS amount FROM s GROUP BY ALL""")
def home_figures(t: Tables) -> DataFrame:
    rows = orders_of(t).withColumn("ok", F.col("o_orderstatus") != "P")
    return upload.home_figures(rows, "store", "period", "gross", "ok").withColumn("amount", number("amount"))


@query(f"""SELECT o_orderpriority, COUNT(*) AS keys, COUNT(*) FILTER (WHERE o_orderstatus = 'F') AS resolved, COUNT(*) FILTER (WHERE o_orderstatus <> 'F') AS unresolved, CAST(SUM({GROSS}) FILTER (WHERE o_orderstatus <> 'F') AS DOUBLE) AS exposure FROM orders GROUP BY ALL""")
def run_shadows(t: Tables) -> DataFrame:
    rows = t.orders.select("o_orderpriority", "o_orderkey", F.when(F.col("o_orderstatus") == "F", "resolved").otherwise("unresolved").alias("status"), money("o_totalprice").alias("exposure"))
    return upload.run_summary(rows, "o_orderpriority", "status", "exposure").drop("digest").withColumn("exposure", number("exposure"))


@query(f"""SELECT l_returnflag, 'tax' AS "column", CAST(SUM({AMOUNT.format("l_tax")}) + 2 AS DOUBLE) AS stated, CAST(SUM({AMOUNT.format("l_tax")}) AS DOUBLE) AS derived FROM lineitem WHERE l_returnflag = 'N' GROUP BY ALL""")
def report_rederived(t: Tables) -> DataFrame:
    lines = t.lineitem.select("l_returnflag", money("l_tax").alias("tax"), money("l_extendedprice").alias("paid"))
    report = lines.groupBy("l_returnflag").agg((F.sum("tax") + F.when(F.first("l_returnflag") == "N", F.lit("2").cast(MONEY)).otherwise(F.lit(0).cast(MONEY))).alias("tax"), F.sum("paid").alias("paid"))
    out = upload.rederived(report, lines, ["l_returnflag"], ["tax", "paid"])
    return out.select("l_returnflag", "column", number("stated").alias("stated"), number("derived").alias("derived"))


@query("""SELECT CAST(p_partkey AS VARCHAR) AS p_partkey, CASE WHEN p_partkey % 6 = 1 THEN 'accept' WHEN p_partkey % 6 = 2 THEN 'maybe' WHEN p_partkey % 6 = 3 THEN '' WHEN p_partkey % 6 = 4 THEN 'reject' ELSE 'accept' END AS decision,
 CASE WHEN p_partkey % 6 = 0 THEN 'changed' WHEN p_partkey % 6 = 1 THEN 'ok' WHEN p_partkey % 6 = 2 THEN 'invalid' WHEN p_partkey % 6 = 3 THEN 'undecided' WHEN p_partkey % 6 = 4 THEN 'repeated' ELSE 'unknown' END AS status FROM part""")
def reviews_returned(t: Tables) -> DataFrame:
    k = F.col("p_partkey")
    offered = model.exported_reviews(t.part, "p_partkey", ["p_name", "p_size"])
    now = t.part.where(k % 6 != 5).withColumn("p_size", F.when(k % 6 == 0, F.col("p_size") + 1).otherwise(F.col("p_size")))
    rest = F.col("p_partkey").cast("long") % 6
    filled = offered.withColumn("decision", F.when(rest == 2, "Maybe").when(rest == 3, " ").when(rest == 4, "reject").otherwise(" Accept "))
    twice = filled.where(rest == 4).withColumn("decision", F.lit("accept"))
    return model.imported_reviews(filled.union(twice), now, "p_partkey", ["p_name", "p_size"])


@query(f"""SELECT CASE WHEN o_orderstatus = 'F' AND o_totalprice > 1000 AND NOT o_totalprice > 400000 THEN 'certified' WHEN o_totalprice > 1000 AND o_orderpriority LIKE '1%' THEN 'conditional' ELSE 'unverified' END AS tier, COUNT(*) AS n, CAST(SUM({GROSS}) AS DOUBLE) AS amount FROM orders GROUP BY ALL""")
def trust_tier_amounts(t: Tables) -> DataFrame:
    price = F.col("o_totalprice")
    tier = invariants.trust_tier(F.col("o_orderstatus") == "F", price > 1000, price > 400000, F.col("o_orderpriority").startswith("1"))
    return t.orders.groupBy(tier.alias("tier")).agg(F.count("*").alias("n"), number(F.sum(money("o_totalprice"))).alias("amount"))


NOTE = """'"' || o_orderpriority || '" said:' || chr(10) || 'a, b \\ ' || o_orderstatus"""


@query(f"""SELECT o_orderkey % 3 AS encoding, {NOTE} AS note, COUNT(*) AS n, CAST(SUM({AMOUNT.format("o_totalprice")}) AS DOUBLE) AS paid FROM orders GROUP BY ALL""")
def dirty_exports_read_back(t: Tables) -> DataFrame:
    """Orders written as CSV in three encodings, with quotes, line breaks and backslashes in a cell, and read by one rule."""
    note = F.concat(F.lit('"'), "o_orderpriority", F.lit('" said:\na, b \\ '), "o_orderstatus")
    rows = t.orders.select((F.col("o_orderkey") % 3).alias("encoding"), note.alias("note"), money("o_totalprice").alias("paid"))
    read = []
    for k, encoding in enumerate(("utf-8-sig", "gb18030", "utf-16")):
        tables.write_csv(rows.where(F.col("encoding") == k), path := new_folder(t.spark), encoding)
        read.append(tables.read_csv(t.spark, path))
    out = read[0].unionByName(read[1]).unionByName(read[2])
    return out.groupBy(F.col("encoding").cast("bigint").alias("encoding"), "note").agg(F.count("*").alias("n"), number(F.sum(F.col("paid").cast(MONEY))).alias("paid"))
