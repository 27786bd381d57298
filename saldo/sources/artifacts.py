"""Results that appear whole or not at all: artifacts under the digest of their rows, and snapshots by month."""

from __future__ import annotations

import hashlib
import json
import uuid
from collections.abc import Sequence

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from saldo.operators.dedupe import digest_sums
from saldo.sources.shared import shuffles_freed

MANIFEST = "_manifest.json"


class ArtifactError(ValueError):
    """A result that isn't what was promised, or an artifact that isn't what its name says."""


class _Files:
    """A path of Spark's file systems."""

    def __init__(self, spark: SparkSession, path: str) -> None:
        self.jvm = spark._jvm
        self.path = self.jvm.org.apache.hadoop.fs.Path(path)
        self.system = self.path.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf())

    def exists(self) -> bool:
        return self.system.exists(self.path)

    def delete(self) -> None:
        self.system.delete(self.path, True)

    def moved(self, to: _Files) -> bool:
        """Whether the folder could be given the other name: a rename never goes into a folder that is there."""
        self.system.mkdirs(to.path.getParent())
        return not to.exists() and self.system.rename(self.path, to.path)

    def write(self, text: str) -> None:
        stream = self.system.create(self.path, True)
        try:
            stream.write(bytearray(text.encode()))
        finally:
            stream.close()

    def read(self) -> str:
        stream = self.system.open(self.path)
        try:
            return bytes(stream.readAllBytes()).decode()
        finally:
            stream.close()


def write_artifact(df: DataFrame, folder: str, schema: StructType | None = None) -> tuple[str, str]:
    """Write a result under the digest of its rows, whatever their order; the path and the digest.

    The plan runs once: the rows go to a hidden folder while an observed metric adds up their digests, a
    manifest with schema, rows and digest is put beside them, and the folder is renamed. A run that fails leaves
    nothing to see. Where the same rows have been written before, those stay. With a schema, the result has to
    have its columns and types, in any order and whether nullable or not.
    """
    spark = df.sparkSession
    kinds = lambda s: {f.name: f.dataType.simpleString() for f in s}
    if schema is not None and kinds(schema) != kinds(df.schema):
        raise ArtifactError(f"columns {kinds(df.schema)} are not {kinds(schema)}")
    hidden = _Files(spark, f"{folder.rstrip('/')}/.new-{uuid.uuid4().hex}")
    seen = Observation(f"artifact-{uuid.uuid4().hex}")
    try:
        with shuffles_freed(spark):
            df.observe(seen, F.count(F.lit(1)).alias("rows"), *digest_sums(df.columns)).write.option("compression", "zstd").parquet(str(hidden.path))
        told = seen.get
        parts = [told[f"_part{i}"] for i in range(4)]
        digest = hashlib.sha256(":".join(str(p) for p in parts if p is not None).encode()).hexdigest()
        path = f"{folder.rstrip('/')}/sha256={digest}"
        manifest = {"digest": digest, "rows": told["rows"], "schema": json.loads(df.schema.json())}
        _Files(spark, f"{hidden.path}/{MANIFEST}").write(json.dumps(manifest, sort_keys=True))
        if not hidden.moved(_Files(spark, path)) and not _Files(spark, f"{path}/{MANIFEST}").exists():
            raise ArtifactError(f"{path} could not be made")
    finally:
        if hidden.exists():
            hidden.delete()
    return path, digest


def read_artifact(spark: SparkSession, path: str, verify: bool = False) -> DataFrame:
    """An artifact by its manifest's schema; with `verify` its rows are digested and counted again."""
    manifest = json.loads(_Files(spark, f"{path.rstrip('/')}/{MANIFEST}").read())
    df = spark.read.schema(StructType.fromJson(manifest["schema"])).parquet(path)
    if verify:
        from saldo.operators.dedupe import multiset_digest

        found = multiset_digest(df, [f["name"] for f in manifest["schema"]["fields"]]).first()
        if (found["digest"], found["rows"]) != (manifest["digest"], manifest["rows"]):
            raise ArtifactError(f"{path} is not what its manifest says")
    return df


def publish_snapshot(df: DataFrame, path: str, by: Sequence[str]) -> None:
    """Replace the slices that the rows have (such as months) and no others, whose files stay as they are."""
    with shuffles_freed(df.sparkSession):
        df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").option("compression", "zstd").partitionBy(*by).parquet(path)


def publish_increment(df: DataFrame, path: str, by: Sequence[str], keys: Sequence[str]) -> None:
    """Add the rows whose keys their own slice does not have yet, null keys being equal; other slices are not read."""
    spark = df.sparkSession
    if _Files(spark, path).exists():
        own = [*by, *[k for k in keys if k not in by]]
        told = lambda table, columns: table.select(*[F.col(c).alias(f"_{c}") for c in columns]).distinct()
        same = lambda columns: [F.col(c).eqNullSafe(F.col(f"_{c}")) for c in columns]
        known = spark.read.schema(df.schema).parquet(path).join(told(df, by), same(by), "left_semi")
        df = df.join(told(known, own), same(own), "left_anti")
    with shuffles_freed(spark):
        df.write.mode("append").option("compression", "zstd").partitionBy(*by).parquet(path)
