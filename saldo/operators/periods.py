"""Assignments that must hold on every day of a period, and the states that accounting periods reach."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def assignments(rows: DataFrame, first: str, last: str) -> DataFrame:
    """product, status and the first day that fails, for rows of (product, person, ratio, tier, status, since, until).

    On each day the highest tier that applies counts. The first day without any gives
    'missing', with a conflict or a person twice 'conflict', with shares that do not
    make 1 'ratio'; if all days hold but differ, 'split', else 'ok'. Only days on which
    something begins or has ended are looked at, as the days up to the next are like them.
    """
    begin, end = F.to_date(F.lit(first)), F.to_date(F.lit(last))
    held = rows.where((F.col("since") <= end) & (F.col("until") >= begin))
    held = held.select("product", "person", "tier", "status", F.col("ratio").cast("decimal(10,4)").alias("share"), F.greatest("since", begin).alias("_from"), F.least("until", end).alias("_to"))
    marks = held.select(F.col("product").alias("_product"), F.explode(F.array(begin, "_from", F.date_add("_to", 1))).alias("day")).where(F.col("day") <= end).distinct()
    days = marks.join(held, marks["_product"].eqNullSafe(held["product"]) & (F.col("_from") <= F.col("day")) & (F.col("_to") >= F.col("day")), "left").withColumn("product", F.col("_product"))
    active = F.col("status") == "active"
    by_tier = days.groupBy("product", "day", "tier").agg(
        F.count("_from").alias("held"), F.sum(F.when(active, F.col("share"))).alias("total"), F.count_if(F.col("status") == "conflict").alias("conflicts"), F.count_if(active).alias("n"),
        F.count_distinct(F.when(active, F.col("person"))).alias("persons"), F.bit_xor(F.when(active, F.xxhash64("person", "share"))).alias("signature"),
    )
    top = by_tier.groupBy("product", "day").agg(F.sum("held").alias("held"), F.max_by(F.struct("total", "conflicts", "n", "persons", "signature"), "tier").alias("d"))
    fault = F.when(F.col("held") == 0, "missing").when((F.col("d.conflicts") > 0) | (F.col("d.n") == 0) | (F.col("d.n") != F.col("d.persons")), "conflict").when(F.col("d.total") != 1, "ratio")
    told = top.select("product", "day", "d.signature", fault.alias("fault"))
    whole = told.groupBy("product").agg(F.min(F.when(F.col("fault").isNotNull(), F.struct("day", "fault"))).alias("fault"), F.count_distinct("signature").alias("signatures"))
    status = F.coalesce("fault.fault", F.when(F.col("signatures") > 1, "split").otherwise("ok"))
    return whole.select("product", status.alias("status"), F.col("fault.day").alias("failed_on"))


def period_states(actions: DataFrame, keys: list[str]) -> DataFrame:
    """State and counters of each period from its log of (at, action, id).

    Actions are 'revise' (id: the content's digest), 'preclose', 'finalize' and
    'adjust'. A period opens, is pre-closed, finalized, and restated by adjustments;
    the first preclose counts, then the first finalize after it. Revisions count once
    each until then, adjustments once each after it; everything else is refused.
    """
    w = Window.partitionBy(*keys)
    told = actions.withColumn("closed_at", F.min(F.when(F.col("action") == "preclose", F.col("at"))).over(w))
    told = told.withColumn("final_at", F.min(F.when((F.col("action") == "finalize") & (F.col("at") > F.col("closed_at")), F.col("at"))).over(w))
    before = F.col("final_at").isNull() | (F.col("at") < F.col("final_at"))
    revision = F.when((F.col("action") == "revise") & before, F.col("id"))
    adjustment = F.when((F.col("action") == "adjust") & (F.col("at") > F.col("final_at")), F.col("id"))
    refused = F.when(F.col("action") == "revise", ~before).when(F.col("action") == "adjust", F.coalesce(F.col("at") <= F.col("final_at"), F.lit(True)))
    refused = refused.when(F.col("action") == "preclose", F.col("at") != F.col("closed_at")).when(F.col("action") == "finalize", F.coalesce(F.col("at") != F.col("final_at"), F.lit(True)))
    out = told.groupBy(*keys).agg(F.max("closed_at").alias("closed_at"), F.max("final_at").alias("final_at"), F.count_distinct(revision).alias("revisions"), F.count_distinct(adjustment).alias("restatements"), F.count_if(F.coalesce(refused, F.lit(True))).alias("refused"))
    state = F.when(F.col("restatements") > 0, "restated").when(F.col("final_at").isNotNull(), "finalized").when(F.col("closed_at").isNotNull(), "pre_closed").otherwise("open")
    version = F.lit(1) + F.col("revisions") + F.col("restatements") + F.col("closed_at").isNotNull().cast("long") + F.col("final_at").isNotNull().cast("long")
    return out.select(*keys, state.alias("state"), version.alias("version"), "revisions", "restatements", "refused")
