"""Plans from metric declarations: links, allocations, times and platforms in one plan."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from saldo.operators import metrics
from saldo.plans.ledger import AMOUNT, GROSS, ORDER, PRICE, number
from saldo.plans.registry import Tables, query

SEGMENTS = ("AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY")
METRICS = [
    {"id": "receipts", "source": "settlements", "value": {"op": "sum", "of": ["o_totalprice"]}, "link": "o_orderkey", "allocate": "even", "by_platform": {"F": {"allocate": "ratio"}}},
    {"id": "refunds", "source": "settlements", "value": {"op": "sum", "of": ["o_totalprice"]}, "where": [{"column": "o_orderstatus", "op": "eq", "value": "F"}], "sign": -1, "link": "o_orderkey", "by_platform": {"O": {"disabled": True}}},
    {
        "id": "fees", "source": "settlements", "value": {"op": "sum", "of": ["o_totalprice"]}, "where": [{"column": "o_orderpriority", "op": "eq", "value": "1-URGENT"}], "sign": -1, "link": "o_orderkey", "time": "paid_on", "allocate": "even",
        "by_platform": {"F": {"where": [{"column": "o_orderpriority", "op": "in", "value": ["2-HIGH", "3-MEDIUM"]}]}},
    },
    {"id": "ads", "source": "campaigns", "value": {"op": "sum", "of": ["value"]}, "where": [{"column": "event_type", "op": "eq", "value": "click"}], "sign": -1, "time": "ts", "platform": "F"},
]
NODES = [{"id": "net", "op": "add", "of": ["receipts", "refunds", "fees"]}, {"id": "profit", "op": "add", "of": ["net", "ads"], "total": True, "applies": ["F"]}]


def spine(t: Tables) -> metrics.Spine:
    """Order lines but for a fifth of the orders, with store, platform and date."""
    orders = t.orders.join(t.customer, F.col("o_custkey") == F.col("c_custkey")).select("o_orderkey", F.col("c_mktsegment").alias("store"), "o_orderdate")
    rows = t.lineitem.where("l_orderkey % 5 <> 0").withColumnRenamed("l_linestatus", "platform").join(orders, F.col("l_orderkey") == F.col("o_orderkey")).drop("o_orderkey")
    order = ["platform" if c == "l_linestatus" else c for c in ORDER]
    return metrics.Spine(rows, "l_orderkey", ["store", "platform"], "platform", "o_orderdate", order, "l_extendedprice")


def sources(t: Tables) -> dict[str, DataFrame]:
    segment = F.get(F.array(*map(F.lit, SEGMENTS)), (F.col("user_id") % 5).cast("int"))
    campaigns = t.events.select(segment.alias("store"), F.when(F.col("event_id") % 2 == 0, "F").otherwise("O").alias("platform"), "ts", "value", "event_type")
    return {"settlements": t.orders.withColumn("paid_on", F.date_add("o_orderdate", 40)), "campaigns": campaigns}


PARTS = f"""spine AS (SELECT l_orderkey, l_linestatus AS platform, c_mktsegment AS store, strftime(o_orderdate, '%Y-%m') AS own, {PRICE} AS price, COUNT(*) OVER (PARTITION BY l_orderkey) AS n, SUM({PRICE}) OVER (PARTITION BY l_orderkey) AS whole,
   ROW_NUMBER() OVER (PARTITION BY l_orderkey ORDER BY {", ".join(ORDER)}) AS rn FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey WHERE l_orderkey % 5 <> 0),
 placed AS (SELECT *, CAST(1.0::DOUBLE / n AS DECIMAL(18,12)) AS even, CAST(CAST(price AS DOUBLE) / CAST(whole AS DOUBLE) AS DECIMAL(18,12)) AS share FROM spine),
 met AS (SELECT o.o_orderkey, {GROSS} AS v, o_orderstatus, o_orderpriority, strftime(o_orderdate + INTERVAL 40 DAY, '%Y-%m') AS paid, p.*, p.l_orderkey IS NOT NULL AS is_met FROM orders o LEFT JOIN placed p ON o_orderkey = p.l_orderkey),
 parts AS (SELECT o_orderkey, store, platform, own AS period, CASE WHEN NOT is_met THEN v ELSE ROUND(v * CASE platform WHEN 'F' THEN share ELSE even END, 6) END AS receipts,
    CASE WHEN o_orderstatus <> 'F' OR platform = 'O' OR rn > 1 THEN 0 ELSE -v END AS refunds, 0 AS fees, 0 AS ads FROM met
  UNION ALL SELECT o_orderkey, store, platform, paid, 0, 0, CASE WHEN o_orderpriority IN ('2-HIGH', '3-MEDIUM') AND platform = 'F' OR o_orderpriority = '1-URGENT' AND COALESCE(platform, '') <> 'F' THEN -CASE WHEN is_met THEN ROUND(v * even, 6) ELSE v END ELSE 0 END, 0 FROM met
  UNION ALL SELECT NULL, ['{"', '".join(SEGMENTS)}'][user_id % 5 + 1], CASE WHEN event_id % 2 = 0 THEN 'F' ELSE 'O' END, strftime(ts, '%Y-%m'), 0, 0, 0, CASE WHEN event_id % 2 = 0 AND event_type = 'click' THEN -{AMOUNT.format("value")} ELSE 0 END FROM events)"""


@query(f"""WITH {PARTS}, sums AS (SELECT store, platform, period, SUM(receipts) AS receipts, SUM(refunds) AS refunds, SUM(fees) AS fees, SUM(ads) AS ads FROM parts GROUP BY ALL)
SELECT store, platform, period, CAST(ROUND(receipts, 2) AS DOUBLE) AS receipts, CAST(ROUND(refunds, 2) AS DOUBLE) AS refunds, CAST(ROUND(fees, 2) AS DOUBLE) AS fees, CAST(ROUND(ads, 2) AS DOUBLE) AS ads,
  CAST(ROUND(receipts + refunds + fees, 2) AS DOUBLE) AS net, CAST(CASE WHEN platform = 'F' THEN ROUND(receipts + refunds + fees + ads, 2) END AS DOUBLE) AS profit FROM sums""")
def declared_metrics(t: Tables) -> DataFrame:
    totals = metrics.compiled(METRICS, sources(t), spine(t))
    out = metrics.stated(totals, [m["id"] for m in METRICS], NODES, "platform")
    return out.select("store", "platform", "period", *[number(c).alias(c) for c in ("receipts", "refunds", "fees", "ads", "net", "profit")])


@query(f"""WITH {PARTS} SELECT CAST(o_orderkey AS VARCHAR) AS link_key, CAST(SUM(receipts) AS DOUBLE) AS receipts, CAST(SUM(refunds) AS DOUBLE) AS refunds, CAST(SUM(fees) AS DOUBLE) AS fees, CAST(SUM(ads) AS DOUBLE) AS ads FROM parts GROUP BY ALL""")
def declared_totals_by_key(t: Tables) -> DataFrame:
    """Sub-cent sums by link key; money without a key comes under a null one."""
    totals = metrics.compiled(METRICS, sources(t), spine(t), by_key=True)
    return totals.select("link_key", *[number(m["id"]).alias(m["id"]) for m in METRICS])
