"""Artifacts and snapshots appear whole or not at all."""

import os

import pytest
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from saldo.operators.dedupe import multiset_digest
from saldo.sources.artifacts import ArtifactError, publish_increment, publish_snapshot, read_artifact, write_artifact


def table(spark, rows):
    return spark.createDataFrame(rows, "month string, k int, v double").select("month", "k", F.col("v").cast("decimal(20,4)").alias("v"))


def files(folder):
    return {os.path.join(d, f): os.stat(os.path.join(d, f)).st_mtime_ns for d, _, names in os.walk(folder) for f in names if f.endswith(".parquet")}


def test_one_run_digest_and_manifest(spark, tmp_path):
    df = table(spark, [("a", i, i / 3) for i in range(500)]).repartition(4)
    runs = spark.sparkContext.accumulator(0)

    def counted(batches):
        for b in batches:
            runs.add(b.num_rows)
            yield b

    path, digest = write_artifact(df.mapInArrow(counted, df.schema), str(tmp_path))
    assert runs.value == 500, "the plan runs once"
    assert digest == multiset_digest(df, df.columns).first()["digest"] and path.endswith(f"sha256={digest}")
    again = read_artifact(spark, path, verify=True)
    assert again.schema == df.schema and again.count() == 500
    before = files(tmp_path)
    assert write_artifact(df.orderBy(F.desc("k")), str(tmp_path)) == (path, digest) and files(tmp_path) == before
    assert [n for n in os.listdir(tmp_path) if not n.startswith("sha256=")] == []


def test_a_failed_run_leaves_nothing(spark, tmp_path):
    df = table(spark, [("a", i, 1.0) for i in range(10)])
    with pytest.raises(Exception, match="broken"):
        write_artifact(df.withColumn("k", F.when(F.col("k") == 9, F.raise_error(F.lit("broken")).cast("int")).otherwise(F.col("k"))), str(tmp_path / "out"))
    assert not os.path.exists(tmp_path / "out") or os.listdir(tmp_path / "out") == []
    with pytest.raises(ArtifactError, match="are not"):
        write_artifact(df, str(tmp_path / "out"), StructType.fromDDL("month string, k long, v decimal(20,4)"))
    write_artifact(df, str(tmp_path / "out"), StructType.fromDDL("v decimal(20,4), month string, k int"))


def test_an_empty_result_and_a_changed_artifact(spark, tmp_path):
    path, _ = write_artifact(table(spark, [("a", 1, 1.0)]).where("k > 5"), str(tmp_path))
    assert read_artifact(spark, path, verify=True).count() == 0
    path, _ = write_artifact(table(spark, [("a", 1, 1.0)]), str(tmp_path))
    table(spark, [("a", 2, 1.0)]).write.mode("append").parquet(path)
    with pytest.raises(ArtifactError, match="manifest"):
        read_artifact(spark, path, verify=True)


def test_snapshots_replace_their_months_only(spark, tmp_path):
    path = str(tmp_path / "p")
    publish_snapshot(table(spark, [("2024-01", 1, 1.0), ("2024-02", 2, 2.0)]), path, ["month"])
    old = {f: t for f, t in files(path).items() if "2024-01" in f}
    publish_snapshot(table(spark, [("2024-02", 9, 9.0), ("2024-03", 3, 3.0)]), path, ["month"])
    assert sorted((r["month"], r["k"]) for r in spark.read.parquet(path).collect()) == [("2024-01", 1), ("2024-02", 9), ("2024-03", 3)]
    assert old.items() <= files(path).items()
    with pytest.raises(Exception, match="broken"):
        publish_snapshot(table(spark, [("2024-01", 5, 5.0)]).withColumn("k", F.raise_error(F.lit("broken")).cast("int")), path, ["month"])
    assert old.items() <= files(path).items() and spark.read.parquet(path).count() == 3


def test_increments_skip_what_is_published(spark, tmp_path):
    path = str(tmp_path / "p")
    publish_increment(table(spark, [("2024-01", 1, 1.0), ("2024-01", None, 2.0)]), path, ["month"], ["k"])
    publish_increment(table(spark, [("2024-01", 1, 8.0), ("2024-01", None, 8.0), ("2024-01", 2, 8.0), ("2024-02", 1, 8.0)]), path, ["month"], ["k"])
    got = sorted((r["month"], r["k"] or 0, float(r["v"])) for r in spark.read.parquet(path).collect())
    assert got == [("2024-01", 0, 2.0), ("2024-01", 1, 1.0), ("2024-01", 2, 8.0), ("2024-02", 1, 8.0)]
