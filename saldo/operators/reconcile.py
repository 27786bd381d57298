"""Two sides of the same money: sums by key, kinds of links, cash bridges, differences."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from saldo.functions.money import MONEY, within
from saldo.operators.graph import components


def link_kind(left: Column, right: Column) -> Column:
    """1:1, 1:N, N:1 or N:M by the numbers of items on either side; one-sided ones by name."""
    return F.when(left == 0, "right_only").when(right == 0, "left_only").when((left == 1) & (right == 1), "1:1").when(left == 1, "1:N").when(right == 1, "N:1").otherwise("N:M")


def two_sided(items: DataFrame, keys: Sequence[str], side: str, amount: str, left: str, right: str, absolute: str = "0.01", relative: str = "0") -> DataFrame:
    """Per key the sums and counts of both sides, the kind of link, the difference and the status.

    One aggregate with conditional sums: a full outer join without a join.
    """
    of = lambda name: F.col(side) == name
    value = F.col(amount).cast(MONEY)
    zero = F.lit(0).cast("decimal(30,4)")
    told = items.groupBy(*keys).agg(
        F.coalesce(F.sum(F.when(of(left), value)), zero).alias("left_amount"),
        F.coalesce(F.sum(F.when(of(right), value)), zero).alias("right_amount"),
        F.count_if(of(left)).alias("left_count"),
        F.count_if(of(right)).alias("right_count"),
    )
    told = told.withColumns({"kind": link_kind(F.col("left_count"), F.col("right_count")), "difference": F.col("left_amount") - F.col("right_amount")})
    one_sided = (F.col("left_count") == 0) | (F.col("right_count") == 0)
    status = F.when(one_sided, "missing_side").when(within(F.col("left_amount"), F.col("right_amount"), absolute, relative), "balanced").otherwise("unbalanced")
    return told.withColumn("status", status)


def cash_bridges(edges: DataFrame, batch: str, cash: str) -> DataFrame:
    """(batch, cash, component, kind): bridges between settlement batches and cash, N:M and repeated pairs being ambiguous."""
    nodes = edges.select(F.concat(F.lit("b:"), F.col(batch).cast("string")).alias("a"), F.concat(F.lit("c:"), F.col(cash).cast("string")).alias("b"))
    labels = components(nodes)
    told = edges.select(batch, cash).withColumn("_id", F.concat(F.lit("b:"), F.col(batch).cast("string"))).join(labels.withColumnRenamed("id", "_id"), "_id").drop("_id")
    sizes = told.groupBy("component").agg(F.count_distinct(batch).alias("batches"), F.count_distinct(cash).alias("cashes"), F.count("*").alias("edges"), F.count_distinct(batch, cash).alias("pairs"))
    kind = F.when(F.col("edges") > F.col("pairs"), "ambiguous").when((F.col("batches") > 1) & (F.col("cashes") > 1), "ambiguous").when(F.col("batches") > 1, "N:1").when(F.col("cashes") > 1, "1:N").otherwise("1:1")
    return told.join(sizes.withColumn("kind", kind), "component").select(batch, cash, "component", "kind")


def difference_class(current: Column, historical: Column, tail: str = "0.0001", rounding: str = "0.05") -> Column:
    """equal, float_tail, rounding or true difference; or present on one side only."""
    gap = F.abs(current - historical)
    named = F.when(current.isNull() & historical.isNull(), "absent").when(historical.isNull(), "current_only").when(current.isNull(), "historical_only")
    return named.when(gap == 0, "equal").when(gap <= F.lit(tail).cast(MONEY), "float_tail").when(gap <= F.lit(rounding).cast(MONEY), "rounding").otherwise("true_difference")


def compare(current: DataFrame, historical: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """Every cell of either table with both values and the class of their difference."""
    told = current.select(*keys, F.col(value).cast(MONEY).alias("current_value")).join(historical.select(*keys, F.col(value).cast(MONEY).alias("historical_value")), list(keys), "full_outer")
    return told.withColumn("difference", difference_class(F.col("current_value"), F.col("historical_value")))


def control_check(details: DataFrame, controls: DataFrame, keys: Sequence[str], amount: str, tolerance: str = "0.01") -> DataFrame:
    """Declared counts and sums against the details: zero amounts do not count as entries."""
    value = F.col(amount).cast(MONEY)
    found = details.groupBy(*keys).agg(F.count_if(value != 0).alias("found_count"), F.sum(value).alias("found_sum"))
    told = controls.join(found, list(keys), "left").withColumns({"found_count": F.coalesce("found_count", F.lit(0)), "found_sum": F.coalesce("found_sum", F.lit(0).cast("decimal(30,4)"))})
    return told.withColumn("ok", (F.col("found_count") == F.col("declared_count")) & (F.abs(F.col("found_sum") - F.col("declared_sum").cast(MONEY)) <= F.lit(tolerance).cast(MONEY)))
