"""Plans of the intake: canonical rows of every kind of source, templates, derived files, assignments, period states and boards."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from saldo.functions import text
from saldo.functions.money import money
from saldo.operators import normalise, periods, recognise
from saldo.operators.recognise import Template
from saldo.plans.ledger import AMOUNT, GROSS, PRICE, number
from saldo.plans.readmodels import ORDERS, orders_of
from saldo.plans.registry import Tables, query

QUANTITY, TAX, VALUE = (AMOUNT.format(c) for c in ("l_quantity", "l_tax", "value"))


def shown(c: str) -> F.Column:
    return F.col(c).cast("string")


def summed(df: DataFrame, *by: str) -> DataFrame:
    return df.groupBy(*by).agg(F.count("*").alias("n"), F.count_distinct("business_key").alias("keys"), number(F.sum("amount")).alias("amount"))


def day(c: str) -> F.Column:
    return F.date_format(c, "yyyy-MM-dd")


@query(f"""SELECT CASE WHEN l_linenumber = 7 THEN 'unexpected_amount_direction' END AS issue, COUNT(*) AS n, COUNT(DISTINCT l_orderkey) AS keys,
  CAST(SUM(CASE WHEN l_linenumber <> 7 THEN {PRICE} - CASE WHEN l_returnflag = 'R' THEN {QUANTITY} ELSE 0 END END) AS DOUBLE) AS amount FROM lineitem GROUP BY ALL""")
def normalise_orders(t: Tables) -> DataFrame:
    paid = F.when(F.col("l_linenumber") == 7, -F.col("l_extendedprice")).otherwise(F.col("l_extendedprice")).cast("string")
    rows = t.lineitem.select(shown("l_orderkey").alias("order_id"), shown("l_partkey").alias("sku"), paid.alias("paid_amount"), F.when(F.col("l_returnflag") == "R", F.concat(F.lit("¥"), shown("l_quantity"))).alias("refund_amount"), day("l_shipdate").alias("business_date"))
    return summed(normalise.canonical(rows, normalise.orders()), "issue")


@query(f"""SELECT CASE WHEN user_id % 3 = 0 THEN 'merchant_order_id' ELSE 'transaction_id' END AS key_kind, 'second' AS precision, COUNT(*) AS n, COUNT(DISTINCT CASE WHEN user_id % 3 = 0 THEN user_id ELSE event_id END) AS keys,
  CAST(SUM(CASE WHEN event_type = 'purchase' THEN {VALUE} ELSE -{VALUE} END) AS DOUBLE) AS amount FROM events GROUP BY ALL""")
def normalise_two_column_ledger(t: Tables) -> DataFrame:
    bought = F.col("event_type") == "purchase"
    rows = t.events.select(
        shown("event_id").alias("transaction_id"), F.when(F.col("user_id") % 3 == 0, shown("user_id")).otherwise("--").alias("merchant_order_id"), F.date_format("ts", "yyyy/MM/dd HH:mm:ss").alias("accounting_date"),
        F.when(bought, shown("value")).alias("income_amount"), F.when(~bought, shown("value")).alias("expense_amount"),
    )
    return summed(normalise.canonical(rows, normalise.two_column_ledger()), "key_kind", "precision")


@query(f"""SELECT CASE WHEN event_type NOT IN ('purchase', 'error') THEN 'unknown_money_direction' END AS issue, COUNT(*) AS n, COUNT(DISTINCT event_id) AS keys,
  CAST(SUM(CASE event_type WHEN 'purchase' THEN {VALUE} WHEN 'error' THEN -{VALUE} END) AS DOUBLE) AS amount FROM events GROUP BY ALL""")
def normalise_direction_ledger(t: Tables) -> DataFrame:
    word = F.when(F.col("event_type") == "purchase", "收 入").when(F.col("event_type") == "error", "付款").otherwise(F.col("event_type"))
    rows = t.events.select(shown("event_id").alias("transaction_id"), F.lit(None).cast("string").alias("merchant_order_id"), day("ts").alias("accounting_date"), shown("value").alias("amount"), word.alias("direction"))
    return summed(normalise.canonical(rows, normalise.direction_ledger()), "issue")


@query(f"""SELECT CASE WHEN l_linenumber = 1 THEN 'missing_business_key' END AS issue, CASE WHEN l_linenumber > 2 THEN 'sub_order_id' WHEN l_linenumber = 2 THEN 'main_order_id' END AS key_kind, CASE WHEN l_linestatus = 'F' THEN 'day' ELSE 'month' END AS precision,
  COUNT(*) AS n, COUNT(DISTINCT CASE WHEN l_linenumber > 2 THEN l_orderkey * 10 + l_linenumber WHEN l_linenumber = 2 THEN l_orderkey END) AS keys, CAST(SUM(CASE WHEN l_linenumber > 1 THEN -{TAX} END) AS DOUBLE) AS amount FROM lineitem GROUP BY ALL""")
def normalise_platform_fee(t: Tables) -> DataFrame:
    line = F.col("l_linenumber")
    rows = t.lineitem.select(
        F.when(line > 2, (F.col("l_orderkey") * 10 + line).cast("string")).alias("sub_order_id"), F.when(line > 1, shown("l_orderkey")).alias("main_order_id"), F.lit("").alias("merchant_order_id"), shown("l_partkey").alias("sku"),
        shown("l_tax").alias("fee_amount"), F.when(F.col("l_linestatus") == "F", day("l_shipdate")).alias("business_date"), text.period("l_shipdate").alias("billing_period"),
    )
    return summed(normalise.canonical(rows, normalise.platform_fee()), "issue", "key_kind", "precision")


@query(f"""SELECT CASE WHEN l_linenumber = 1 THEN '2024-05' ELSE strftime(l_shipdate, '%Y-%m') END AS period, CASE WHEN l_linenumber = 1 THEN 'month' ELSE 'day' END AS precision, COUNT(*) AS n, COUNT(DISTINCT (l_orderkey, l_partkey)) AS keys,
  CAST(SUM(-CAST({QUANTITY} * {TAX} AS DECIMAL(20,4))) AS DOUBLE) AS amount FROM lineitem GROUP BY ALL""")
def normalise_cost(t: Tables) -> DataFrame:
    rows = t.lineitem.select(shown("l_orderkey").alias("order_id"), shown("l_partkey").alias("sku"), F.when(F.col("l_linenumber") > 1, day("l_shipdate")).alias("business_date"), shown("l_quantity").alias("quantity"), shown("l_tax").alias("unit_cost"))
    return summed(normalise.canonical(rows, normalise.cost("2024-05")).withColumn("period", text.period("occurred_on")), "period", "precision")


@query(f"""SELECT strftime(l_shipdate, '%Y-%m-%d') || '|' || l_returnflag AS business_key, COUNT(*) AS n, COUNT(DISTINCT CASE WHEN l_linenumber % 2 = 0 THEN l_partkey END) AS skus, CAST(SUM(-{TAX}) AS DOUBLE) AS amount FROM lineitem GROUP BY ALL""")
def normalise_advertising(t: Tables) -> DataFrame:
    entity = F.when(F.col("l_linenumber") % 2 == 0, "Product").otherwise("Shop")
    rows = t.lineitem.select(day("l_shipdate").alias("business_date"), F.col("l_returnflag").alias("campaign"), shown("l_partkey").alias("sku"), entity.alias("entity_type"), shown("l_tax").alias("spend_amount"))
    out = normalise.canonical(rows, normalise.advertising())
    return out.groupBy("business_key").agg(F.count("*").alias("n"), F.count_distinct("sku").alias("skus"), number(F.sum("amount")).alias("amount"))


@query(f"""SELECT 'tracking_number' AS key_kind, COUNT(*) AS n, COUNT(DISTINCT o_orderkey) AS keys, CAST(SUM(-{GROSS}) AS DOUBLE) AS amount FROM orders UNION ALL SELECT 'order_id+source_row', COUNT(*), COUNT(DISTINCT (o_orderkey, o_custkey)), CAST(SUM({GROSS}) AS DOUBLE) FROM orders""")
def normalise_freight(t: Tables) -> DataFrame:
    rows = t.orders.select(shown("o_orderkey").alias("tracking_number"), shown("o_orderkey").alias("order_id"), F.lit("").alias("sku"), day("o_orderdate").alias("business_date"), shown("o_totalprice").alias("freight_amount"), F.col("o_custkey").alias("row_no"))
    return summed(normalise.canonical(rows, normalise.freight()).unionByName(normalise.canonical(rows, normalise.order_freight())), "key_kind")


@query(f"""SELECT 'control_period' AS key_kind, NULL AS issue, COUNT(*) AS n, COUNT(DISTINCT strftime(o_orderdate, '%Y-%m')) AS keys, CAST(SUM({GROSS} - o_custkey) AS DOUBLE) AS amount FROM orders
UNION ALL SELECT 'control_period+category', CASE WHEN o_orderstatus = 'P' THEN 'control_total_mismatch' END AS issue, COUNT(*), COUNT(DISTINCT o_orderpriority), CAST(SUM(CASE WHEN o_orderstatus <> 'P' THEN {GROSS} - o_custkey END) AS DOUBLE) FROM orders GROUP BY ALL""")
def normalise_control_totals(t: Tables) -> DataFrame:
    net = money("o_totalprice") - F.col("o_custkey") + F.when(F.col("o_orderstatus") == "P", 1).otherwise(0)
    rows = t.orders.select(text.period("o_orderdate").alias("period"), F.col("o_orderpriority").alias("category"), shown("o_totalprice").alias("income_amount"), shown("o_custkey").alias("expense_amount"), net.cast("string").alias("net_amount"))
    both = normalise.canonical(rows, normalise.period_control()).unionByName(normalise.canonical(rows, normalise.category_control("2024-05")))
    return summed(both, "key_kind", "issue")


TEMPLATES = [Template("small_rings", ("small", "ring")), Template("rings", ("ring",)), Template("red_widgets", ("red", "widget", "ECONOMY")), Template("widgets", ("widget",), ("red",), "#1")]


@query("""WITH h AS (SELECT p_brand, string_split(p_name, ' ') || [p_type] AS h FROM part), m AS (SELECT *, list_has_all(h, ['small', 'ring']) AS a, list_contains(h, 'ring') AS b, list_has_all(h, ['red', 'widget', 'ECONOMY']) AS c, list_contains(h, 'widget') AND NOT list_contains(h, 'red') AS d FROM h)
SELECT CASE WHEN d AND p_brand LIKE '%#1%' THEN 'widgets' WHEN c THEN 'red_widgets' WHEN a THEN 'small_rings' WHEN b THEN 'rings' WHEN d THEN 'widgets' END AS template, CAST(a AS INT) + CAST(b AS INT) + CAST(c AS INT) + CAST(d AS INT) AS candidates,
  COUNT(*) AS n, COUNT(*) FILTER (WHERE len(list_intersect(h, ['red', 'widget', 'ECONOMY'])) = 2) AS near_misses FROM m GROUP BY ALL""")
def template_recognition(t: Tables) -> DataFrame:
    files = t.part.select(F.concat(F.split("p_name", " "), F.array(F.concat(F.lit(" "), "p_type"))).alias("headers"), F.col("p_brand").alias("file_name"))
    return recognise.fits(files, TEMPLATES).groupBy("template", "candidates").agg(F.count("*").alias("n"), F.sum(F.size("near")).alias("near_misses"))


@query("""SELECT CASE WHEN p_size < 10 THEN 'pivot' WHEN p_size < 20 THEN 'repeated_headers' WHEN p_size < 30 THEN 'provenance' END AS reason, COUNT(*) AS n FROM part GROUP BY ALL""")
def derived_files(t: Tables) -> DataFrame:
    size = F.col("p_size")
    headers = F.when(size < 10, F.array(F.concat(F.lit("Sum of "), "p_name"), "p_type", "p_brand", F.lit("b"), F.lit(" "))).when(size < 20, F.array("p_name", "p_name", "p_type", F.lit("b"))).otherwise(F.array("p_name", "p_type"))
    said = F.when(size < 20, "名称：对账").when(size < 30, "来源：从成本表内筛选粘贴").otherwise("路径：账户——查看明细——导出")
    first = F.array(F.col("p_name"), said, F.lit("来源：另一张表提取"))
    first = F.when((size >= 20) & (size < 30), F.array(F.col("p_name"), said)).otherwise(first)
    return t.part.groupBy(recognise.made_from_others(headers, first).alias("reason")).agg(F.count("*").alias("n"))


@query("""WITH a AS (SELECT s_suppkey AS product, p.person, CASE WHEN s_nationkey = 3 THEN 0.5 ELSE p.ratio END AS ratio, CASE WHEN s_nationkey = 7 AND p.person = 'b' THEN 'conflict' ELSE 'active' END AS status,
    CASE WHEN s_nationkey = 5 THEN DATE '2024-05-03' ELSE DATE '2024-04-01' END AS since, CASE WHEN s_nationkey = 9 AND p.person <> 'c' THEN DATE '2024-05-20' ELSE DATE '2024-12-31' END AS until, CASE WHEN p.person = 'c' THEN 0 ELSE 1 END AS tier
    FROM supplier, (VALUES ('a', 0.6), ('b', 0.4), ('c', 1.0)) p(person, ratio) WHERE p.person <> 'c' OR s_nationkey = 9),
  d AS (SELECT a.*, CAST(day AS DATE) AS day FROM a, (SELECT unnest(generate_series(DATE '2024-05-01', DATE '2024-05-31', INTERVAL 1 DAY)) AS day) WHERE day BETWEEN since AND until),
  t AS (SELECT *, MAX(tier) OVER (PARTITION BY product, day) AS top FROM d),
  f AS (SELECT product, day, string_agg(person || ratio, ',' ORDER BY person) AS sig, CASE WHEN COUNT(*) FILTER (WHERE status = 'conflict') > 0 OR COUNT(DISTINCT person) <> COUNT(*) THEN 'conflict' WHEN SUM(ratio) <> 1 THEN 'ratio' END AS fault FROM t WHERE tier = top GROUP BY ALL),
  g AS (SELECT s_suppkey AS product, CAST(day AS DATE) AS day FROM supplier, (SELECT unnest(generate_series(DATE '2024-05-01', DATE '2024-05-31', INTERVAL 1 DAY)) AS day)),
  j AS (SELECT g.product, g.day, sig, CASE WHEN sig IS NULL THEN 'missing' ELSE fault END AS fault FROM g LEFT JOIN f USING (product, day))
SELECT product, COALESCE(arg_min(fault, day) FILTER (WHERE fault IS NOT NULL), CASE WHEN COUNT(DISTINCT sig) > 1 THEN 'split' ELSE 'ok' END) AS status, MIN(day) FILTER (WHERE fault IS NOT NULL) AS failed_on FROM j GROUP BY ALL""")
def daily_assignments(t: Tables) -> DataFrame:
    nation, person = F.col("s_nationkey"), F.col("person")
    people = F.explode(F.array(*[F.struct(F.lit(p).alias("person"), F.lit(r).alias("ratio")) for p, r in (("a", "0.6"), ("b", "0.4"), ("c", "1.0"))]))
    rows = t.supplier.select(F.col("s_suppkey").alias("product"), "s_nationkey", people.alias("p")).select("product", "s_nationkey", "p.*").where((person != "c") | (nation == 9))
    rows = rows.withColumns({
        "ratio": F.when(nation == 3, "0.5").otherwise(F.col("ratio")), "status": F.when((nation == 7) & (person == "b"), "conflict").otherwise("active"), "since": F.when(nation == 5, "2024-05-03").otherwise("2024-04-01").cast("date"),
        "until": F.when((nation == 9) & (person != "c"), "2024-05-20").otherwise("2024-12-31").cast("date"), "tier": F.when(person == "c", 0).otherwise(1),
    })
    return periods.assignments(rows, "2024-05-01", "2024-05-31")


@query("""WITH l AS (SELECT o_custkey AS account, o_orderdate AS moment, o_orderkey % 7 AS id, CASE substr(o_orderpriority, 1, 1) WHEN '1' THEN 'preclose' WHEN '2' THEN 'finalize' WHEN '3' THEN 'adjust' ELSE 'revise' END AS action FROM orders),
  c AS (SELECT account, MIN(moment) AS c FROM l WHERE action = 'preclose' GROUP BY ALL), f AS (SELECT account, MIN(moment) AS f FROM l JOIN c USING (account) WHERE action = 'finalize' AND moment > c GROUP BY ALL),
  s AS (SELECT l.*, c, f FROM l LEFT JOIN c USING (account) LEFT JOIN f USING (account)),
  g AS (SELECT account, MAX(c) AS c, MAX(f) AS f, COUNT(DISTINCT id) FILTER (WHERE action = 'revise' AND (f IS NULL OR moment < f)) AS revisions, COUNT(DISTINCT id) FILTER (WHERE action = 'adjust' AND moment > f) AS restatements,
    COUNT(*) FILTER (WHERE action = 'revise' AND moment >= f OR action = 'adjust' AND NOT COALESCE(moment > f, false) OR action = 'preclose' AND moment <> c OR action = 'finalize' AND NOT COALESCE(moment = f, false)) AS refused FROM s GROUP BY ALL)
SELECT account, CASE WHEN restatements > 0 THEN 'restated' WHEN f IS NOT NULL THEN 'finalized' WHEN c IS NOT NULL THEN 'pre_closed' ELSE 'open' END AS state,
  1 + revisions + restatements + CAST(c IS NOT NULL AS BIGINT) + CAST(f IS NOT NULL AS BIGINT) AS version, revisions, restatements, refused FROM g""")
def period_state_log(t: Tables) -> DataFrame:
    first = F.substring("o_orderpriority", 1, 1)
    action = F.when(first == "1", "preclose").when(first == "2", "finalize").when(first == "3", "adjust").otherwise("revise")
    return periods.period_states(t.orders.select(F.col("o_custkey").alias("account"), F.col("o_orderdate").alias("at"), action.alias("action"), (F.col("o_orderkey") % 7).alias("id")), ["account"])


@query(f"""SELECT s_nationkey AS person, l_linestatus AS store, CAST(SUM({PRICE}) AS DOUBLE) AS amount, COUNT(DISTINCT l_partkey) AS products, COUNT(*) FILTER (WHERE l_returnflag = 'R') AS failed
  FROM lineitem JOIN supplier ON l_suppkey = s_suppkey GROUP BY ALL ORDER BY amount DESC, person, store LIMIT 20""")
def people_leaderboard(t: Tables) -> DataFrame:
    lines = t.lineitem.join(t.supplier, F.col("l_suppkey") == F.col("s_suppkey"))
    board = lines.groupBy(F.col("s_nationkey").alias("person"), F.col("l_linestatus").alias("store")).agg(number(F.sum(money("l_extendedprice"))).alias("amount"), F.count_distinct("l_partkey").alias("products"), F.count_if(F.col("l_returnflag") == "R").alias("failed"))
    return board.orderBy(F.desc("amount"), "person", "store").limit(20)


@query(f"""WITH o AS {ORDERS}, k AS (SELECT store, period, COUNT(*) AS n, COUNT(*) FILTER (WHERE o_orderstatus = 'F') AS finished, COUNT(*) FILTER (WHERE o_orderstatus = 'P') AS pending, SUM({GROSS}) AS v FROM o GROUP BY ALL)
SELECT store, period, n, finished, pending, CAST(v AS DOUBLE) AS amount, RANK() OVER (PARTITION BY period ORDER BY v DESC) AS place FROM k WHERE period = (SELECT MAX(period) FROM k)""")
def performance_overview(t: Tables) -> DataFrame:
    orders, status = orders_of(t), F.col("o_orderstatus")
    cells = orders.groupBy("store", "period").agg(F.count("*").alias("n"), F.count_if(status == "F").alias("finished"), F.count_if(status == "P").alias("pending"), F.sum("gross").alias("v"))
    last = cells.agg(F.max("period").alias("period"))
    place = F.rank().over(Window.partitionBy("period").orderBy(F.desc("v")))
    return cells.join(F.broadcast(last), "period").select("store", "period", "n", "finished", "pending", number("v").alias("amount"), place.alias("place"))  # one row is broadcast


@query(f"""WITH o AS {ORDERS}, c AS (SELECT store, period, COUNT(*) AS jobs, COUNT(*) FILTER (WHERE o_orderstatus = 'F') AS certified, COUNT(*) FILTER (WHERE o_orderstatus = 'P') AS failed, arg_max(o_orderstatus, (o_orderdate, o_orderkey)) AS latest, SUM({GROSS}) AS v FROM o GROUP BY ALL),
  s AS (SELECT store, SUM(jobs) AS store_jobs, SUM(certified) AS store_certified FROM c GROUP BY ALL)
SELECT store, period, jobs, certified, failed, latest, CAST(v AS DOUBLE) AS amount, CAST(store_jobs AS BIGINT) AS store_jobs, CAST(store_certified AS BIGINT) AS store_certified, CASE WHEN certified = jobs THEN 'trusted' WHEN failed > 0 THEN 'blocked' ELSE 'partial' END AS trust FROM c JOIN s USING (store)""")
def trust_matrix(t: Tables) -> DataFrame:
    status = F.col("o_orderstatus")
    cells = orders_of(t).groupBy("store", "period").agg(
        F.count("*").alias("jobs"), F.count_if(status == "F").alias("certified"), F.count_if(status == "P").alias("failed"), F.max_by("o_orderstatus", F.struct("o_orderdate", "o_orderkey")).alias("latest"), F.sum("gross").alias("v")
    )
    store = Window.partitionBy("store")  # over a row per month
    trust = F.when(F.col("certified") == F.col("jobs"), "trusted").when(F.col("failed") > 0, "blocked").otherwise("partial")
    return cells.select("store", "period", "jobs", "certified", "failed", "latest", number("v").alias("amount"), F.sum("jobs").over(store).alias("store_jobs"), F.sum("certified").over(store).alias("store_certified"), trust.alias("trust"))
