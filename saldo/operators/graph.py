"""Connected components by spreading the least label."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from saldo.sources.shared import shared_dir


def checkpointed(df: DataFrame) -> DataFrame:
    """The table in the shared checkpoint folder: cuts the lineage and survives lost executors."""
    context = df.sparkSession.sparkContext
    if not context.getCheckpointDir():
        context.setCheckpointDir(shared_dir(df.sparkSession))
    return df.checkpoint()


def components(edges: DataFrame, left: str = "a", right: str = "b", rounds: int = 60) -> DataFrame:
    """(id, component) for every end of an edge: the least id that can be reached.

    A round takes the least label among the neighbours and then that label's own label, so
    paths shorten at least by half; no step gathers a node's neighbours.
    """
    pairs = edges.select(F.col(left).alias("a"), F.col(right).alias("b")).where("a is not null and b is not null")
    both = checkpointed(pairs.union(pairs.select("b", "a")).distinct())
    labels = checkpointed(both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("id"), F.least("a", "m").alias("component")))
    for _ in range(rounds):
        near = both.join(labels.withColumnRenamed("id", "b"), "b").groupBy(F.col("a").alias("id")).agg(F.min("component").alias("near"))
        lower = labels.join(near, "id", "left").select("id", F.least("component", "near").alias("component"), F.col("component").alias("was"))
        own = labels.select(F.col("id").alias("component"), F.col("component").alias("further"))
        found = checkpointed(lower.join(own, "component", "left").select("id", F.least("component", "further").alias("component"), "was"))
        labels = found.select("id", "component")
        if found.where("component <> was").isEmpty():
            return labels
    raise RuntimeError(f"labels still change after {rounds} rounds")
