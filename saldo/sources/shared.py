"""The folder that the driver and all executors share, and tables kept there between steps."""

from __future__ import annotations

import atexit
import contextlib
import tempfile
import uuid
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession

CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
_STAGED: dict[str, SparkSession] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir; where that is unset, a temporary one, if all of Spark is in this one process."""
    context = spark.sparkContext
    folder = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if not folder:
        if context.master.split("[")[0] != "local":
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        context.setCheckpointDir(tempfile.mkdtemp(prefix="saldo-"))
        folder = context.getCheckpointDir()
    return folder.rstrip("/")


@contextlib.contextmanager
def shuffles_freed(spark: SparkSession) -> Iterator[None]:
    """Queries that are run meanwhile delete their shuffle files at their end, not when the driver happens to collect garbage."""
    before = spark.conf.get(CLEANUP, "false")
    spark.conf.set(CLEANUP, "true")
    try:
        yield
    finally:
        spark.conf.set(CLEANUP, before)


def new_folder(spark: SparkSession) -> str:
    """A folder of its own in the shared one; it is deleted when the driver ends."""
    path = f"{shared_dir(spark)}/saldo-{uuid.uuid4().hex}"
    _STAGED[path] = spark
    return path


def staged(df: DataFrame) -> DataFrame:
    """The table written to the shared folder and read again: cuts the lineage and survives lost executors."""
    spark = df.sparkSession
    path = new_folder(spark)
    with shuffles_freed(spark):
        df.write.option("compression", "zstd").parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.staged_path = path
    return out


def forget(*tables: DataFrame) -> None:
    """Delete staged tables that nothing will read any more."""
    for table in tables:
        path = getattr(table, "staged_path", None)
        if path in _STAGED:
            _delete(_STAGED.pop(path), path)


def _delete(spark: SparkSession, path: str) -> None:
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


@atexit.register
def _forget_all() -> None:
    for path, spark in list(_STAGED.items()):
        with contextlib.suppress(Exception):
            _delete(spark, path)
