"""Read models: overviews, trends, drill-downs, quality gates and buckets."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from saldo.functions import text
from saldo.functions.money import MONEY, money
from saldo.operators import invariants, statement
from saldo.plans.ledger import AMOUNT, GROSS, PRICE, number
from saldo.plans.registry import Tables, query
from saldo.sources.guard import run_guarded

ORDERS = "(SELECT *, c_mktsegment AS store, strftime(o_orderdate, '%Y-%m') AS period FROM orders JOIN customer ON o_custkey = c_custkey)"


def orders_of(t: Tables) -> DataFrame:
    return t.orders.join(t.customer, F.col("o_custkey") == F.col("c_custkey")).withColumns({"store": F.col("c_mktsegment"), "period": text.period("o_orderdate"), "gross": money("o_totalprice")})


@query(f"""SELECT CAST(SUM({GROSS}) AS DOUBLE) AS gross, COUNT(DISTINCT (store, o_custkey)) AS customers, COUNT(*) FILTER (WHERE o_orderstatus = 'F') AS finished, COUNT(*) AS n FROM {ORDERS}""")
def overview_summary(t: Tables) -> DataFrame:
    return orders_of(t).agg(number(F.sum("gross")).alias("gross"), F.count_distinct(F.struct("store", "o_custkey")).alias("customers"), F.count_if(F.col("o_orderstatus") == "F").alias("finished"), F.count("*").alias("n"))


@query(f"""SELECT strftime(ts, '%Y-%m-%d') AS day, COUNT(*) AS n, CAST(SUM({AMOUNT.format("value")}) AS DOUBLE) AS amount FROM events GROUP BY ALL""")
def daily_trend(t: Tables) -> DataFrame:
    return t.events.groupBy(F.date_format("ts", "yyyy-MM-dd").alias("day")).agg(F.count("*").alias("n"), number(F.sum(money("value"))).alias("amount"))


@query(f"""SELECT n_name AS store, COUNT(o_orderkey) AS n, CAST(COALESCE(SUM({GROSS}), 0) AS DOUBLE) AS gross FROM nation LEFT JOIN customer ON n_nationkey = c_nationkey LEFT JOIN orders ON c_custkey = o_custkey GROUP BY ALL""")
def store_breakdown(t: Tables) -> DataFrame:
    sums = t.orders.join(t.customer, F.col("o_custkey") == F.col("c_custkey")).groupBy("c_nationkey").agg(F.count("*").alias("n"), F.sum(money("o_totalprice")).alias("gross"))
    return t.nation.join(sums, F.col("n_nationkey") == F.col("c_nationkey"), "left").select(F.col("n_name").alias("store"), F.coalesce("n", F.lit(0)).alias("n"), number(F.coalesce("gross", F.lit(0))).alias("gross"))


@query("""SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC NULLS LAST, o_orderdate DESC, o_orderkey LIMIT 50""")
def top_transactions(t: Tables) -> DataFrame:
    return t.orders.orderBy(F.desc_nulls_last("o_totalprice"), F.desc("o_orderdate"), "o_orderkey").limit(50).select("o_orderkey", "o_totalprice")


@query(f"""WITH g AS (SELECT o_orderpriority, COUNT(*) AS n, SUM({GROSS}) AS amount FROM orders GROUP BY ALL) SELECT o_orderpriority, n, CAST(amount AS DOUBLE) AS amount, COUNT(*) OVER () AS groups, CAST(SUM(amount) OVER () AS DOUBLE) AS grand_total FROM g""")
def review_groups_totals(t: Tables) -> DataFrame:
    groups = t.orders.groupBy("o_orderpriority").agg(F.count("*").alias("n"), F.sum(money("o_totalprice")).alias("amount"))
    whole = Window.partitionBy(F.lit(0))  # over a row per group
    return groups.select("o_orderpriority", "n", number("amount").alias("amount"), F.count("*").over(whole).alias("groups"), number(F.sum("amount").over(whole)).alias("grand_total"))


@query(f"""WITH m AS (SELECT o_custkey, date_trunc('month', o_orderdate) AS month, SUM({GROSS}) AS v FROM orders GROUP BY ALL), l AS (SELECT *, LEAD(month) OVER (PARTITION BY o_custkey ORDER BY month) AS next FROM m)
SELECT o_custkey, strftime(month + INTERVAL 1 MONTH, '%Y-%m') AS period, CAST(v AS DOUBLE) AS was FROM l WHERE next IS NULL OR next > month + INTERVAL 1 MONTH""")
def dropped_to_zero(t: Tables) -> DataFrame:
    month = t.orders.groupBy("o_custkey", F.trunc("o_orderdate", "month").alias("month")).agg(F.sum(money("o_totalprice")).alias("v"))
    after = F.lead("month").over(Window.partitionBy("o_custkey").orderBy("month"))
    following = F.add_months("month", 1)
    told = month.withColumn("next", after).where(F.col("next").isNull() | (F.col("next") > following))
    return told.select("o_custkey", text.period(following).alias("period"), number("v").alias("was"))


@query(f"""SELECT p_type AS subject, COUNT(*) AS n, CAST(SUM({PRICE}) AS DOUBLE) AS amount FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY ALL""")
def drill_by_subject(t: Tables) -> DataFrame:
    by_part = t.lineitem.groupBy("l_partkey").agg(F.count("*").alias("n"), F.sum(money("l_extendedprice")).alias("amount"))
    return by_part.join(t.part, F.col("l_partkey") == F.col("p_partkey")).groupBy(F.col("p_type").alias("subject")).agg(F.sum("n").alias("n"), number(F.sum("amount")).alias("amount"))


@query("""SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice FROM lineitem ORDER BY l_extendedprice DESC, l_orderkey, l_linenumber, l_partkey, l_suppkey LIMIT 20 OFFSET 40""")
def drill_page(t: Tables) -> DataFrame:
    order = [F.desc("l_extendedprice"), "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"]
    return t.lineitem.orderBy(*order).offset(40).limit(20).select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice")


@query("""SELECT p_partkey, p_name FROM part WHERE CAST(p_partkey AS VARCHAR) = '42' OR ABS(CAST(p_retailprice AS DECIMAL(20,4)) - 942) <= 0.01 OR p_name LIKE '%ring%' OR p_brand LIKE '%ring%'""")
def search_hits(t: Tables) -> DataFrame:
    hit = (F.col("p_partkey").cast("string") == "42") | (F.abs(money("p_retailprice") - 942) <= F.lit("0.01").cast(MONEY)) | F.col("p_name").contains("ring") | F.col("p_brand").contains("ring")
    return t.part.where(hit).select("p_partkey", "p_name")


@query("""SELECT * FROM (SELECT 'valid_time' AS gate, COUNT(*) FILTER (WHERE o_orderdate IS NULL) AS failures, COUNT(*) AS n_rows FROM orders UNION ALL SELECT 'non_negative', COUNT(*) FILTER (WHERE o_totalprice < 0), COUNT(*) FROM orders
UNION ALL SELECT 'volume_band', COUNT(*) FILTER (WHERE NOT o_totalprice BETWEEN 1000 AND 400000), COUNT(*) FROM orders UNION ALL SELECT 'required', COUNT(*) FILTER (WHERE o_custkey IS NULL), COUNT(*) FROM orders)""")
def quality_gates(t: Tables) -> DataFrame:
    price = F.col("o_totalprice")
    checks = {"valid_time": F.col("o_orderdate").isNotNull(), "non_negative": price >= 0, "volume_band": price.between(1000, 400000), "required": F.col("o_custkey").isNotNull()}
    return invariants.gates(t.orders, checks).select("gate", "failures", F.col("rows").alias("n_rows"))


@query(f"""SELECT strftime(date_trunc('hour', ts), '%Y-%m-%d %H:%M') AS bucket, COUNT(*) AS n, CAST(SUM({AMOUNT.format("value")}) AS DOUBLE) AS amount FROM events GROUP BY ALL""")
def bucket_hours(t: Tables) -> DataFrame:
    return t.events.groupBy(F.date_format(F.date_trunc("hour", "ts"), "yyyy-MM-dd HH:mm").alias("bucket")).agg(F.count("*").alias("n"), number(F.sum(money("value"))).alias("amount"))


@query(f"""SELECT store, period, COUNT(*) AS n, CAST(SUM({GROSS}) AS DOUBLE) AS gross FROM {ORDERS} GROUP BY ALL""")
def store_month_summary(t: Tables) -> DataFrame:
    return orders_of(t).groupBy("store", "period").agg(F.count("*").alias("n"), number(F.sum("gross")).alias("gross"))


@query(f"""WITH c AS (SELECT store, period, SUM({GROSS}) AS v, COUNT(DISTINCT o_orderstatus) = 3 AS complete FROM {ORDERS} GROUP BY ALL)
SELECT period, CAST(COALESCE(SUM(v) FILTER (WHERE complete), 0) AS DOUBLE) AS gross, COUNT(*) FILTER (WHERE complete) AS complete_stores, COUNT(*) AS stores FROM c GROUP BY ALL""")
def period_totals_incomplete(t: Tables) -> DataFrame:
    orders = orders_of(t)
    cells = orders.groupBy("store", "period").agg(F.sum("gross").alias("v"))
    told = cells.join(statement.complete(orders, ["store", "period"], "o_orderstatus", ["F", "O", "P"]), ["store", "period"])
    return told.groupBy("period").agg(number(F.coalesce(F.sum(F.when(F.col("complete"), F.col("v"))), F.lit(0))).alias("gross"), F.count_if("complete").alias("complete_stores"), F.count("*").alias("stores"))


@query("""SELECT user_id, event_type, COUNT(*) AS cases, COUNT(DISTINCT CAST(ts AS DATE)) AS days FROM events GROUP BY ALL HAVING COUNT(*) >= 15 AND COUNT(DISTINCT CAST(ts AS DATE)) >= 10""")
def promotion_candidates(t: Tables) -> DataFrame:
    return t.events.groupBy("user_id", "event_type").agg(F.count("*").alias("cases"), F.count_distinct(F.to_date("ts")).alias("days")).where("cases >= 15 and days >= 10")


@query(f"""SELECT CAST(json_extract_string(props, '$.k') AS INT) AS k, COUNT(*) AS n, CAST(SUM(GREATEST({AMOUNT.format("value")} - 100, 0)) AS DOUBLE) AS above FROM events GROUP BY ALL""")
def json_attribute_facts(t: Tables) -> DataFrame:
    above = F.greatest(money("value") - 100, F.lit(0).cast(MONEY))
    return t.events.groupBy(F.get_json_object("props", "$.k").try_cast("int").alias("k")).agg(F.count("*").alias("n"), number(F.sum(above)).alias("above"))


@query(f"""SELECT metric, COUNT(*) AS n, CAST(SUM(CAST(v AS DECIMAL(20,4))) AS DOUBLE) AS amount FROM (SELECT 'l_quantity' AS metric, l_quantity AS v FROM lineitem UNION ALL SELECT 'l_discount', l_discount FROM lineitem UNION ALL SELECT 'l_tax', l_tax FROM lineitem) GROUP BY ALL""")
def unpivot_metrics(t: Tables) -> DataFrame:
    long = t.lineitem.unpivot("l_orderkey", ["l_quantity", "l_discount", "l_tax"], "metric", "v")
    return long.groupBy("metric").agg(F.count("*").alias("n"), number(F.sum(money("v"))).alias("amount"))


@query(f"""SELECT o_orderkey, CAST({GROSS} AS DOUBLE) AS amount, strftime(o_orderdate, '%Y-%m-%d') AS day FROM orders""")
def dirty_number_date_parse(t: Tables) -> DataFrame:
    amount = F.concat(F.lit(" ¥"), F.format_number("o_totalprice", 2), F.lit("元 "))
    layout = F.element_at(F.array(*[F.date_format("o_orderdate", p) for p in ("yyyy-M-d", "yyyy/MM/dd HH:mm", "yyyyMMdd", "yyyy年M月d日", "yyyy.M.d")]), (F.col("o_orderkey") % 5 + 1).cast("int"))
    dirty = t.orders.select("o_orderkey", amount.alias("amount"), layout.alias("day"))
    return dirty.select("o_orderkey", number(text.parse_number("amount")).alias("amount"), F.date_format(text.parse_date("day"), "yyyy-MM-dd").alias("day"))


@query("""SELECT c_custkey, '<text:len=' || len(c_name) || ':' || substr(sha256(c_name), 1, 12) || '>' AS masked FROM customer""")
def mask_profile(t: Tables) -> DataFrame:
    return t.customer.select("c_custkey", text.mask("c_name").alias("masked"))


@query(f"""SELECT CASE WHEN event_type = 'error' THEN 'explained' WHEN value IS NULL THEN 'no_amount' WHEN value >= 100 THEN 'large' ELSE 'small' END AS bucket, COUNT(*) AS n, CAST(SUM({AMOUNT.format("value")}) AS DOUBLE) AS amount FROM events GROUP BY ALL""")
def unlinked_buckets(t: Tables) -> DataFrame:
    bucket = F.when(F.col("event_type") == "error", "explained").when(F.col("value").isNull(), "no_amount").when(F.col("value") >= 100, "large").otherwise("small")
    return t.events.groupBy(bucket.alias("bucket")).agg(F.count("*").alias("n"), number(F.sum(money("value"))).alias("amount"))


@query("""SELECT o_orderstatus, COUNT(*) AS n FROM orders WHERE o_custkey < 500 GROUP BY ALL ORDER BY o_orderstatus LIMIT 100""")
def certified_sql_guard(t: Tables) -> DataFrame:
    allowed = {"certified": t.orders.where("o_custkey < 500")}
    return run_guarded(t.spark, "SELECT o_orderstatus, COUNT(*) AS n FROM certified GROUP BY o_orderstatus ORDER BY o_orderstatus", allowed, 100)


@query("""SELECT o_orderstatus, COUNT(*) AS n FROM orders GROUP BY ALL ORDER BY o_orderstatus LIMIT 100""")
def certified_sql_guard_all(t: Tables) -> DataFrame:
    """The guarded surface over the whole orders table; only the guard's own row limit holds."""
    return run_guarded(t.spark, "SELECT o_orderstatus, COUNT(*) AS n FROM certified GROUP BY o_orderstatus ORDER BY o_orderstatus", {"certified": t.orders}, 100)


@query("""SELECT DISTINCT store, strftime(m, '%Y-%m') AS period, COALESCE(n, 0) AS evidence FROM (SELECT DISTINCT c_mktsegment AS store FROM customer), (SELECT unnest(generate_series(date_trunc('month', MIN(o_orderdate))::TIMESTAMP, date_trunc('month', MAX(o_orderdate))::TIMESTAMP, INTERVAL 1 MONTH)) AS m FROM orders)
LEFT JOIN (SELECT c_mktsegment AS s, date_trunc('month', o_orderdate) AS om, COUNT(*) AS n FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY ALL) ON s = store AND om = m""")
def target_plan(t: Tables) -> DataFrame:
    low, high = t.orders.agg(*[f(F.trunc("o_orderdate", "month")) for f in (F.min, F.max)]).first()
    months = F.explode(F.sequence(F.lit(low), F.lit(high), F.expr("interval 1 month")))
    grid = t.customer.select(F.col("c_mktsegment").alias("store")).distinct().select("store", months.alias("m")).select("store", text.period("m").alias("period"))
    seen = orders_of(t).groupBy("store", "period").agg(F.count("*").alias("n"))
    return grid.join(seen, ["store", "period"], "left").select("store", "period", F.coalesce("n", F.lit(0)).alias("evidence"))
