"""Components of a graph whose rounds are kept in the shared folder."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from saldo.sources.shared import forget, shared_dir, staged

__all__ = ["components", "forget", "shared_dir", "staged"]


def components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """(id, component, was) for every end of the edges (a, b): the smallest id that can be reached; a staged table.

    Each round takes the least label among the neighbours and then that label's own
    label, so paths shorten at least by half; it ends when no label changes.
    """
    both = staged(edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).where("a <> b").distinct())
    labels = staged(both.groupBy("a").agg(F.least("a", F.min("b")).alias("component")).withColumnRenamed("a", "id"))
    for _ in range(rounds):
        seen = labels.select(F.col("id").alias("b"), "component")
        least = both.join(seen, "b").groupBy(F.col("a").alias("id")).agg(F.min("component").alias("near"))
        lower = labels.join(least, "id").select("id", F.least("component", "near").alias("component"), F.col("component").alias("was"))
        own = labels.select(F.col("id").alias("component"), F.col("component").alias("further"))
        jumped = lower.join(own, "component", "left").select("id", F.least("component", F.coalesce("further", "component")).alias("component"), "was")
        last, labels = labels, staged(jumped)
        forget(last)
        if not labels.where("component <> was").limit(1).count():
            forget(both)
            return labels
    raise RuntimeError(f"labels still change after {rounds} rounds")
