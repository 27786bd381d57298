"""Linking money to the order spine: keys, membership, bridges, coverage.

Keys are normalised once on both sides. Key tables are reduced to a row per key
before they are joined, so a join never multiplies money; whether a side is small
enough to be broadcast is left to the optimiser's size estimates.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from saldo.functions.text import norm_key
from saldo.operators.dedupe import first_wins


def key_of(df: DataFrame, name: Column | str) -> Column:
    """A column's normalised key; whole numbers need no mending."""
    if isinstance(name, str) and isinstance(df.schema[name].dataType, T.IntegralType):
        return F.col(name).cast("string")
    return norm_key(name)


def spine_index(spine: DataFrame, role: str, order: Sequence[str], context: Sequence[str] = ()) -> DataFrame:
    """(key, context...) of the first spine row of each normalised key."""
    if not context:
        return spine.select(key_of(spine, role).alias("key")).where("key is not null").distinct()
    keyed = spine.select(key_of(spine, role).alias("key"), *context, *[c for c in order if c not in context]).where("key is not null")
    return first_wins(keyed, ["key"], order).select("key", *context)


def link(facts: DataFrame, key: Column | str, index: DataFrame, context: Sequence[str] = ()) -> DataFrame:
    """The facts with link_key, whether it is on the spine, and the spine's context where it is."""
    keyed = facts.withColumn("link_key", key_of(facts, key))
    found = index.select(F.col("key").alias("_key"), *[F.col(c).alias(f"spine_{c}") for c in context])
    return keyed.join(found, F.col("link_key") == F.col("_key"), "left").withColumn("linked", F.col("_key").isNotNull()).drop("_key")


def bridge(table: DataFrame, source: str, target: str, order: Sequence[str]) -> DataFrame:
    """(source_key, target_key): the first target of every source key, both normalised, neither null."""
    pairs = table.select(norm_key(source).alias("source_key"), norm_key(target).alias("target_key"), *order).where("source_key is not null and target_key is not null")
    return first_wins(pairs, ["source_key"], order).select("source_key", "target_key")


def through(facts: DataFrame, key: str, bridges: Sequence[DataFrame], name: str = "bridged_key") -> DataFrame:
    """The key after each bridge in turn (tracking number to shipment to order); null where a hop is missing."""
    out = facts.withColumn(name, norm_key(key))
    for hop in bridges:
        out = out.join(hop.withColumnsRenamed({"source_key": "_from", "target_key": "_to"}), F.col(name) == F.col("_from"), "left").withColumn(name, F.col("_to")).drop("_from", "_to")
    return out


def with_fallback(linked: DataFrame, crosswalk: DataFrame, index: DataFrame) -> DataFrame:
    """Unlinked keys tried again through a crosswalk (source_key, target_key); linked ones stay as they are."""
    other = crosswalk.join(index.select("key"), F.col("target_key") == F.col("key"), "left_semi").select(F.col("source_key").alias("_from"), F.col("target_key").alias("_to"))
    tried = linked.join(other, (F.col("link_key") == F.col("_from")) & ~F.col("linked"), "left")
    by_fallback = F.col("_to").isNotNull()
    return tried.withColumns({"link_key": F.coalesce("_to", "link_key"), "linked": F.col("linked") | by_fallback, "by_fallback": by_fallback}).drop("_from", "_to")


def link_report(linked: DataFrame, keys: Sequence[str] = (), amount: str | None = None) -> DataFrame:
    """Rows, rows with a key, linked rows, hit rate (and unlinked money) per group."""
    aggregates = [F.count("*").alias("rows"), F.count("link_key").alias("keyed"), F.count_if("linked").alias("hits"), F.round(F.count_if("linked") / F.count("*"), 6).alias("hit_rate")]
    if amount:
        aggregates.append(F.sum(F.when(~F.col("linked"), F.col(amount))).alias("unlinked_amount"))
    return linked.groupBy(*keys).agg(*aggregates)


def coverage(expected: DataFrame, covered: DataFrame, key: str, expect: Column | None = None) -> DataFrame:
    """Distinct expected keys, how many of them are covered, and the share."""
    wanted = (expected.where(expect) if expect is not None else expected).select(norm_key(key).alias("key")).where("key is not null").distinct()
    seen = covered.select(norm_key("link_key").alias("_k")).where("_k is not null").distinct()
    told = wanted.join(seen, F.col("key") == F.col("_k"), "left")
    return told.agg(F.count("*").alias("expected"), F.count("_k").alias("covered"), F.round(F.try_divide(F.count("_k"), F.count("*")), 6).alias("coverage"))


def orphans(facts: DataFrame, index: DataFrame, amount: str, keys: Sequence[str] = ()) -> DataFrame:
    """Keys that the spine lacks: how many, and their money."""
    lost = facts.join(index.select(F.col("key").alias("_k")), F.col("link_key") == F.col("_k"), "left_anti")
    return lost.groupBy(*keys).agg(F.count_distinct("link_key").alias("orphan_keys"), F.sum(amount).alias("orphan_amount"))
