"""Plans that run as streams: the table comes in runs, each into a stream that starts again from its checkpoint."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from saldo.plans import intake, ledger
from saldo.plans.registry import ORACLES, Tables, query
from saldo.sources.shared import new_folder
from saldo.streaming import keyed


def streamed(runs: Sequence[DataFrame], made: Callable[[DataFrame], DataFrame], mode: str = "append") -> DataFrame:
    """What a stream over the runs writes, (batch, ...) of every batch; after each run it is stopped and started again."""
    spark, schema = runs[0].sparkSession, runs[0].schema
    come, gone, checkpoint = new_folder(spark), new_folder(spark), new_folder(spark)

    def write(batch: DataFrame, batch_id: int) -> None:
        # A batch that is tried again overwrites its own folder.
        batch.write.mode("overwrite").parquet(f"{gone}/batch={batch_id}")

    with keyed.rocksdb(spark):
        for run in runs:
            run.write.mode("append").parquet(come)
            stream = made(spark.readStream.schema(schema).parquet(come))
            started = stream.writeStream.outputMode(mode).foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
            started.awaitTermination()
    return spark.read.parquet(gone)


@query(ORACLES[ledger.incremental_dedupe_fingerprint.__name__])
def incremental_dedupe_stream(t: Tables) -> DataFrame:
    rows = t.events.select("event_id", "user_id", "event_type", F.to_date("ts").alias("day"), (F.col("event_id") % 3).alias("src"))
    low, high = rows.agg(F.min("event_id"), F.max("event_id")).first()
    place = F.floor((F.col("event_id") - low) * 3 / (high - low + 1))
    kept = streamed([rows.where(place == k) for k in range(3)], lambda s: keyed.first_source(s, ["user_id", "event_type", "day"], "src", ["event_id"]))
    return kept.agg(F.count("*").alias("kept"), F.count_distinct("user_id").alias("users"))


@query(ORACLES[intake.period_state_log.__name__])
def period_state_stream(t: Tables) -> DataFrame:
    """The runs are out of order: what a period comes to doesn't depend on it."""
    first = F.substring("o_orderpriority", 1, 1)
    action = F.when(first == "1", "preclose").when(first == "2", "finalize").when(first == "3", "adjust").otherwise("revise")
    rows = t.orders.select(F.col("o_custkey").alias("account"), F.col("o_orderdate").cast("timestamp").alias("at"), action.alias("action"), (F.col("o_orderkey") % 7).alias("id"), "o_orderkey")
    out = streamed([rows.where(F.col("o_orderkey") % 3 == k).drop("o_orderkey") for k in (2, 0, 1)], lambda s: keyed.period_log(s, ["account"]), "update")
    last = out.groupBy("account").agg(F.max_by(F.struct("state", "version", "revisions", "restatements", "refused"), "batch").alias("s"))
    return last.select("account", "s.*")
