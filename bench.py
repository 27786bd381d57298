"""Seconds that the headline queries take, as one line of JSON."""

from __future__ import annotations

import json
import os
import time

from pyspark.sql import SparkSession

from saldo.catalogue import QUERIES

HEADLINE = [
    "statement_by_store_month", "grouping_sets_store_sku", "rule_chain_winner", "cross_file_dedupe", "incremental_dedupe_fingerprint", "link_hit_rate", "allocate_ratio",
    "allocate_exact_remainder", "reconcile_order_platform", "asof_fallback", "interval_cost_lookup", "diff_classes", "quality_gates", "dropped_to_zero", "dirty_number_date_parse", "unpivot_metrics",
]


def main() -> None:
    sf_dir, cpus = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1"), os.environ.get("BENCH_CPUS", "8")
    conf = {"spark.sql.shuffle.partitions": cpus, "spark.sql.session.timeZone": "UTC", "spark.ui.enabled": "false", "spark.ui.showConsoleProgress": "false", "spark.driver.memory": "8g"}
    spark = SparkSession.builder.master(f"local[{cpus}]").config(map=conf).getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    QUERIES[HEADLINE[0]](spark, sf_dir).write.format("noop").mode("overwrite").save()  # starts Spark and its readers
    took = {}
    for name in HEADLINE:
        began = time.perf_counter()
        QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        took[name] = round(time.perf_counter() - began, 3)
    print(json.dumps({"metric": "headline_queries_total", "value": round(sum(took.values()), 3), "unit": "sec", "queries": took, "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf")}))
    spark.stop()


if __name__ == "__main__":
    main()
