"""What held at a time: backward as-of joins, half-open intervals, owners, tiers.

The as-of join unites both sides and carries the last version forward in one window
per key. A key's rows are spread over time slices with each slice opened by the
version in force, so that one hot key does not have to fit in one task.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def backward(rows: DataFrame, versions: DataFrame, keys: Sequence[str], at: str, since: str, values: Sequence[str], slice_by: str = "month") -> DataFrame:
    """The rows with the values of the latest version of their keys that begins no later; null where there is none.

    Versions of equal keys and beginning are resolved by the greatest values.
    """
    sliced = lambda c: F.date_trunc(slice_by, F.col(c).cast("timestamp"))
    one = versions.groupBy(*keys, since).agg(F.max(F.struct(*values)).alias("_v")).select(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)], F.col(since).cast("timestamp").alias("_at"), "_v")
    # The version in force when each slice that has rows begins.
    named = rows.select(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)], F.col(at).cast("timestamp").alias("_at"), F.struct(*rows.columns).alias("_row"))
    ids = [f"_k{i}" for i in range(len(keys))]
    starts = named.select(*ids, F.date_trunc(slice_by, "_at").alias("_slice")).where("_slice is not null").distinct()
    last_in = one.groupBy(*ids, F.date_trunc(slice_by, "_at").alias("_slice")).agg(F.max_by("_v", "_at").alias("_v"))
    marks = starts.select(*ids, "_slice", F.lit(None).cast(one.schema["_v"].dataType).alias("_v"), F.lit(0).alias("_kind")).unionByName(last_in.select(*ids, "_slice", "_v", F.lit(1).alias("_kind")))
    before = Window.partitionBy(*ids).orderBy("_slice", "_kind").rowsBetween(Window.unboundedPreceding, -1)
    openings = marks.withColumn("_v", F.last("_v", ignorenulls=True).over(before)).where("_kind = 0 and _v is not null").select(*ids, "_slice", F.col("_slice").alias("_at"), "_v")
    empty_row = F.lit(None).cast(named.schema["_row"].dataType).alias("_row")
    both = (
        named.select(*ids, F.date_trunc(slice_by, "_at").alias("_slice"), "_at", F.lit(2).alias("_kind"), F.lit(None).cast(one.schema["_v"].dataType).alias("_v"), "_row")
        .unionByName(openings.select(*ids, "_slice", "_at", F.lit(0).alias("_kind"), "_v", empty_row))
        .unionByName(one.select(*ids, F.date_trunc(slice_by, "_at").alias("_slice"), "_at", F.lit(1).alias("_kind"), "_v", empty_row))
    )
    running = Window.partitionBy(*ids, "_slice").orderBy("_at", "_kind").rowsBetween(Window.unboundedPreceding, 0)
    carried = both.withColumn("_v", F.last("_v", ignorenulls=True).over(running)).where("_kind = 2")
    return carried.select("_row.*", *[F.when(F.col("_at").isNotNull(), F.col(f"_v.{v}")).alias(v) for v in values])


def with_fallback(rows: DataFrame, versions: DataFrame, key: str, group: str, at: str, since: str, values: Sequence[str]) -> DataFrame:
    """As-of by the item's own versions, and by its group's (versions without an item) where it has none."""
    own = versions.where(F.col(key).isNotNull())
    common = versions.where(F.col(key).isNull())
    told = backward(rows, own.withColumn("_has", F.lit(True)), [group, key], at, since, ["_has", *values])
    told = told.withColumnsRenamed({v: f"_own_{v}" for v in values})
    told = backward(told, common, [group], at, since, values)
    chosen = {v: F.when(F.col("_has"), F.col(f"_own_{v}")).otherwise(F.col(v)) for v in values}
    level = F.when(F.col("_has"), "item").when(F.col(values[0]).isNotNull(), "group").otherwise("none")
    return told.select(*rows.columns, *[c.alias(v) for v, c in chosen.items()], level.alias("matched_by"))


def segments(versions: DataFrame, key: str, since: str, until: str, value: str) -> DataFrame:
    """(_k, _from, _to, _n, _v): the stretches of a key's time through which the same versions hold, how many they are, and the value of a single one.

    A version adds its number in its key where it begins and takes it off where it ends, so that the sum of the numbers
    tells which one it is where one holds.
    """
    named = versions.select(F.col(key).alias("_k"), F.col(since).alias("_from"), F.col(until).alias("_to"), F.col(value).alias("_v"))
    named = named.where(F.col("_k").isNotNull() & F.col("_from").isNotNull() & (F.col("_to").isNull() | (F.col("_from") < F.col("_to"))))
    named = named.withColumn("_id", F.row_number().over(Window.partitionBy("_k").orderBy("_from", "_to", "_v")).cast("long"))
    edges = named.select("_k", "_id", F.posexplode(F.array("_from", "_to")).alias("_end", "_at")).where("_at is not null")
    sign = 1 - 2 * F.col("_end")
    steps = edges.groupBy("_k", "_at").agg(F.sum(sign).alias("_n"), F.sum(sign * F.col("_id")).alias("_only"))
    running = Window.partitionBy("_k").orderBy("_at")
    told = steps.select("_k", F.col("_at").alias("_from"), F.lead("_at").over(running).alias("_to"), F.sum("_n").over(running).alias("_n"), F.sum("_only").over(running).alias("_only")).where("_n > 0")
    values = named.select(F.col("_k").alias("_vk"), F.col("_id").alias("_vid"), "_v")
    return told.join(values, (F.col("_k") == F.col("_vk")) & (F.when(F.col("_n") == 1, F.col("_only")) == F.col("_vid")), "left").select("_k", "_from", "_to", "_n", "_v")


def interval(rows: DataFrame, versions: DataFrame, key: str, at: str, since: str, until: str, value: str) -> DataFrame:
    """The one version whose half-open interval holds the time; none and several are reported as such.

    Versions are cut into segments that don't overlap, so that a row meets one at most: the rows are joined once, and
    neither made distinct nor counted. The condition has an equality on the key; the segments of a task's keys are hashed
    in memory, so that the rows, which are many more, are not sorted.
    """
    cut = segments(versions, key, since, until, value).hint("shuffle_hash")
    held = (rows[key] == F.col("_k")) & (F.col("_from") <= rows[at]) & (F.col("_to").isNull() | (rows[at] < F.col("_to")))
    out = rows.join(cut, held, "left")
    status = F.when(F.col("_n").isNull(), "absent").when(F.col("_n") > 1, "overlapping").otherwise("found")
    return out.select(*[rows[c] for c in rows.columns], F.col("_v").alias(value), status.alias("status"))


def owners_at(owners: DataFrame, period: str, key: str, since: str, values: Sequence[str]) -> DataFrame:
    """Each key's values of the latest period no later than the given one."""
    return owners.where(F.col(since) <= period).groupBy(key).agg(F.max_by(F.struct(*values), F.struct(since, *values)).alias("_v")).select(key, *[F.col(f"_v.{v}").alias(v) for v in values])


def split(rows: DataFrame, shares: DataFrame, keys: Sequence[str], amount: str, share: str) -> DataFrame:
    """Each row once for every share of its keys, with its part of the amount."""
    return rows.join(shares, list(keys)).withColumn("part", F.round(F.col(amount).cast("decimal(20,4)") * F.col(share).cast("decimal(8,4)"), 6).cast("decimal(26,6)"))


def best_tier(rows: DataFrame, tier: Column, keys: Sequence[str]) -> DataFrame:
    """The rows of the highest tier above zero in each group."""
    told = rows.withColumn("tier", tier).where("tier > 0")
    top = told.groupBy(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)]).agg(F.max("tier").alias("_top"))
    return told.join(top, [*[told[k].eqNullSafe(top[f"_k{i}"]) for i, k in enumerate(keys)], told["tier"] == top["_top"]]).select(*told.columns)
