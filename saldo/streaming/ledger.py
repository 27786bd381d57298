"""Incremental ledgers: overlapping deliveries, late rows for closed months, buckets.

State is bounded by the watermark in all of them.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from saldo.functions.money import money
from saldo.functions.text import period
from saldo.operators.dedupe import fingerprint


def once(stream: DataFrame, columns: Sequence[str], at: str, delay: str = "3 days") -> DataFrame:
    """Each business fingerprint once within the watermark, however often it is delivered."""
    return stream.withColumns({"row_print": fingerprint(columns), at: F.col(at).cast("timestamp")}).withWatermark(at, delay).dropDuplicatesWithinWatermark(["row_print"])


def buckets(stream: DataFrame, at: str, amount: str, every: str = "1 hour", delay: str = "3 days") -> DataFrame:
    """Counts and exact sums in tumbling windows."""
    return stream.withColumn(at, F.col(at).cast("timestamp")).withWatermark(at, delay).groupBy(F.window(at, every)).agg(F.count("*").alias("n"), F.sum(money(amount)).alias("amount")).select(F.col("window.start").alias("bucket"), "n", "amount")


def timing(event: str, arrival: str) -> F.Column:
    """same_period, late_arrival (the event's month is over), or cross_period (it is still to come)."""
    return F.when(period(event) == period(arrival), "same_period").when(period(event) < period(arrival), "late_arrival").otherwise("cross_period")


def route_late(stream: DataFrame, at: str, closed: str, ledger: str, adjustments: str, checkpoint: str):
    """Write rows of open months to the ledger and rows up to the closed month to the adjustments, each exactly once by batch.

    A batch that is tried again overwrites its own folder, so nothing is counted twice.
    """

    def write(batch: DataFrame, batch_id: int) -> None:
        told = batch.withColumn("period", period(at)).persist()
        told.where(F.col("period") > closed).write.mode("overwrite").parquet(f"{ledger}/batch={batch_id}")
        told.where(F.col("period") <= closed).write.mode("overwrite").parquet(f"{adjustments}/batch={batch_id}")
        told.unpersist()

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
