"""Coarse amounts onto finer lines, exactly.

Group totals are aggregates joined back, so a hot key is combined before the shuffle;
only the exact remainder needs the lines of one group in order, and those groups are
the lines of one order, the people of one product or the stores of one month.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from saldo.functions.money import MONEY


def with_totals(df: DataFrame, keys: Sequence[str], **sums: Column) -> DataFrame:
    """The rows with aggregates over their group as further columns; nulls in keys are equal."""
    totals = df.groupBy(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)]).agg(*[c.alias(n) for n, c in sums.items()])
    return df.join(totals, [df[k].eqNullSafe(totals[f"_k{i}"]) for i, k in enumerate(keys)]).select(*df.columns, *sums)


def factors(spine: DataFrame, keys: Sequence[str], how: str = "none", share: str | None = None, paid: str | None = None, refund: str | None = None) -> DataFrame:
    """Each spine row's factor: 1; an even part of its key; or its share by a column or by net receipts.

    Where a key's receipts come to nothing, ratio falls back to even parts.
    """
    if how == "none":
        return spine.withColumn("factor", F.lit(1.0))
    if how == "ratio" and share:
        return spine.withColumn("factor", F.coalesce(F.col(share).cast("double"), F.lit(0.0)))
    even = 1.0 / F.col("_rows")
    if how == "even":
        return with_totals(spine, keys, _rows=F.count("*")).withColumn("factor", even).drop("_rows")
    net = F.greatest(F.coalesce(F.col(paid).cast(MONEY), F.lit(0)) - F.coalesce(F.col(refund).cast(MONEY) if refund else F.lit(0), F.lit(0)), F.lit(0).cast(MONEY))
    told = with_totals(spine.withColumn("_net", net), keys, _rows=F.count("*"), _all=F.sum("_net"))
    by_net = F.col("_net").cast("double") / F.col("_all").cast("double")
    return told.withColumn("factor", F.when(F.col("_all") > 0, by_net).otherwise(even)).drop("_net", "_rows", "_all")


def project(spine: DataFrame, key: str, by_key: DataFrame, amount: str = "amount") -> DataFrame:
    """Spine rows with amount x factor, six decimals; rows whose key has no money are left out, fully offset ones stay as 0."""
    money = by_key.select(F.col("link_key").alias("_key"), F.col(amount).alias("_amount"))
    joined = spine.join(money, F.col(key) == F.col("_key"))
    return joined.withColumn(amount, F.round(F.col("_amount").cast("decimal(20,4)") * F.col("factor").cast("decimal(18,12)"), 6).cast("decimal(26,6)")).drop("_key", "_amount")


def ratio_health(spine: DataFrame, share: str) -> DataFrame:
    """How many ratios are missing, negative, or above one."""
    return spine.agg(F.count_if(F.col(share).isNull()).alias("missing"), F.count_if(F.col(share) < 0).alias("negative"), F.count_if(F.col(share) > 1).alias("above_one"))


def exact(df: DataFrame, keys: Sequence[str], total: str, weight: str, order: Sequence[Column | str], name: str = "allocated") -> DataFrame:
    """Shares of a total by weight that add up to it: the last line in the order takes the remainder.

    Where weights add up to nothing the parts are even. The remainder needs the lines
    of a group in order, so totals come from windows over the same shuffle and sort.
    """
    group = Window.partitionBy(*keys)
    lines = group.orderBy(*order)
    told = df.withColumns({"_weights": F.sum(F.col(weight).cast(MONEY)).over(group), "_rows": F.count("*").over(group)})
    part = F.when(F.col("_weights") != 0, F.try_divide(F.col(weight).cast(MONEY), F.col("_weights").cast(MONEY))).otherwise(F.try_divide(F.lit(1).cast(MONEY), F.col("_rows").cast(MONEY)))
    rounded = F.bround(F.col(total).cast(MONEY).cast("decimal(20,4)") * part.cast("decimal(18,12)"), 4).cast(MONEY)
    told = told.withColumns({"_part": rounded, "_at": F.row_number().over(lines)})
    before = F.coalesce(F.sum("_part").over(lines.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    last = F.col(total).cast(MONEY) - before
    return told.withColumn(name, F.when(F.col("_at") == F.col("_rows"), last).otherwise(F.col("_part")).cast(MONEY)).drop("_weights", "_rows", "_part", "_at")


def overhead(basis: DataFrame, period: str, store: str, receipts: str, totals: DataFrame, amount: str = "amount") -> DataFrame:
    """A month's overhead over its stores by receipts; the largest store takes the remainder, stores without receipts nothing."""
    paying = basis.where(F.col(receipts) > 0).join(totals.select(F.col(period).alias("_period"), F.col(amount).alias("_total")), F.col(period) == F.col("_period")).drop("_period")
    return exact(paying, [period], "_total", receipts, [F.col(receipts).asc(), F.col(store).desc()], amount).drop("_total")


def contribution(facts: DataFrame, spine: DataFrame, key: str, amount: str = "amount") -> DataFrame:
    """What each fact counts for: its amount times the weight of its key on the spine; 0 and not counted where there is none."""
    weight = spine.groupBy(F.col(key).alias("_key")).agg(F.sum("factor").alias("_weight"))
    told = facts.join(weight, F.col("link_key") == F.col("_key"), "left")
    return told.withColumns({"counted": F.col("_weight").isNotNull(), "contribution": F.round(F.col(amount).cast(MONEY) * F.coalesce(F.col("_weight"), F.lit(0.0)).cast("decimal(18,12)"), 6).cast("decimal(26,6)")}).drop("_key", "_weight")


def loss_policy(base: Column, policy: str = "deduct") -> Column:
    """A negative base is deducted, or skipped as zero."""
    return F.when(base < 0, F.lit(0).cast(MONEY)).otherwise(base) if policy == "skip" else base
