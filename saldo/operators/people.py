"""Whose money it is: commission bases, products, people, exact parts by ratio, money without an order."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from saldo.functions.money import MONEY
from saldo.operators.allocate import exact

UNORDERED = "(no order)"


def order_base(spine: DataFrame, facts: DataFrame, row: str, metrics: Sequence[str], product: str) -> DataFrame:
    """Each spine row's commission base, 0 where it has no money; money of the metrics without a spine row is one row more."""
    wanted = facts.where(F.col("metric_id").isin(*metrics))
    base = wanted.groupBy(F.col(row).alias("_row")).agg(F.sum("amount").cast(MONEY).alias("base"))
    ordered = spine.select(row, product).join(base.where("_row is not null"), F.col(row) == F.col("_row"), "left")
    rest = base.where("_row is null and base <> 0").select(F.lit(None).cast(spine.schema[row].dataType).alias(row), F.lit(UNORDERED).alias(product), "base")
    return ordered.select(row, F.coalesce(F.col(product).cast("string"), F.lit("")).alias(product), F.coalesce("base", F.lit(0).cast(MONEY)).alias("base")).union(rest)


def product_lines(matched: DataFrame, product: str, since: str, rate: str, fallback: str) -> DataFrame:
    """Per product: its base, orders, highest rate, whether any rule was a fallback, and the latest date of a rule (none: unassigned)."""
    return matched.groupBy(product).agg(
        F.sum("base").cast(MONEY).alias("base"), F.count("*").alias("sub_orders"), F.max(rate).alias("total_rate"), F.coalesce(F.bool_or(fallback), F.lit(False)).alias("fallback"), F.max(since).alias("effective_from"), F.max(since).isNull().alias("unassigned")
    )


def by_person(lines: DataFrame, shares: DataFrame, keys: Sequence[str], amount: str, person: str, share: str) -> DataFrame:
    """Each line's amount over its people by ratio, the last one in order of name taking the remainder; ratios must add up to one."""
    split = lines.join(shares.select(*keys, person, F.col(share).cast("decimal(18,12)").alias("_share")), list(keys))
    lines_ = [c for c in lines.columns if c not in keys]
    group = Window.partitionBy(*keys, *lines_)
    told = split.withColumns({"_part": F.bround(F.col(amount).cast(MONEY) * F.col("_share"), 4).cast(MONEY), "_last": F.row_number().over(group.orderBy(F.col(person).desc())) == 1})
    others = F.sum(F.when(~F.col("_last"), F.col("_part")).otherwise(F.lit(0).cast(MONEY))).over(group)
    return told.withColumn("part", F.when(F.col("_last"), F.col(amount).cast(MONEY) - others).otherwise(F.col("_part")).cast(MONEY)).drop("_part", "_last", "_share")


def order_parts(lines: DataFrame, order: str, total: str, net: str, paid: str, by: Sequence[Column | str]) -> DataFrame:
    """An order's amount over its lines, exactly: by net revenue if that is positive, else by what the buyer paid if that is not zero, else evenly."""
    # Windows, as in `exact`: one shuffle by the order serves all, and nothing is joined back.
    group = Window.partitionBy(order)
    told = lines.withColumns({"_net": F.sum(F.col(net).cast(MONEY)).over(group), "_paid": F.sum(F.col(paid).cast(MONEY)).over(group)})
    branch = F.when(F.col("_net") > 0, "net_revenue").when(F.col("_paid") != 0, "buyer_paid").otherwise("equal")
    weight = F.when(F.col("branch") == "net_revenue", F.col(net).cast(MONEY)).when(F.col("branch") == "buyer_paid", F.col(paid).cast(MONEY)).otherwise(F.lit(1).cast(MONEY))
    told = told.withColumn("branch", branch).withColumn("_weight", weight)
    return exact(told, [order], total, "_weight", by).drop("_net", "_paid", "_weight")


def orderless(facts: DataFrame, spine: DataFrame, key: str, slices: Sequence[str], anchor: Sequence[str], flag: str) -> tuple[DataFrame, DataFrame]:
    """(booked, refused): flagged money whose key the spine lacks, with the context of its first physical row. It is booked if the
    spine has that store and month, and refused if it would open a month of its own."""
    lost = facts.where(F.col(flag) & F.col(key).isNotNull()).join(spine.select(F.col(key).alias("_key")).distinct(), F.col(key) == F.col("_key"), "left_anti")
    keyed = lost.groupBy(key).agg(F.sum(F.col("amount").cast(MONEY)).alias("amount"), F.min_by(F.struct(*slices), F.struct(*anchor)).alias("_at")).select(key, "amount", "_at.*")
    known = spine.select(*[F.col(s).alias(f"_{s}") for s in slices]).distinct()
    same = [F.col(s) == F.col(f"_{s}") for s in slices]
    return keyed.join(known, same, "left_semi"), keyed.join(known, same, "left_anti")
