"""Which row of several stands for all: always by a total order, never by arrival.

Each operator is one window over one shuffle. A key that holds much of a table makes
one large window group; `first_wins` and `latest` therefore reduce with an aggregate
(min_by or max_by over a struct), which combines before the shuffle.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from saldo.sources.shared import staged


def _kept(df: DataFrame, keys: Sequence[str], chosen: Column) -> DataFrame:
    named = {f"_k{i}": F.col(k) for i, k in enumerate(keys)}
    return df.groupBy(*[c.alias(n) for n, c in named.items()]).agg(chosen.alias("_row")).select("_row.*")


def first_wins(df: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """The row of least order for every combination of keys; nulls are equal to each other and come first."""
    every = F.struct(*df.columns)
    return _kept(df, keys, F.min_by(every, F.struct(*order, *[c for c in df.columns if c not in order])))


def latest(df: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """The row of greatest order for every combination of keys; nulls come last."""
    every = F.struct(*df.columns)
    return _kept(df, keys, F.max_by(every, F.struct(*order, *[c for c in df.columns if c not in order])))


def mark_parents(df: DataFrame, keys: Sequence[str], order: Sequence[str], name: str = "is_parent") -> DataFrame:
    """Every row, and whether it is the first of its keys: parent amounts count once."""
    return df.withColumn(name, F.row_number().over(Window.partitionBy(*keys).orderBy(*order)) == 1)


def across_files(df: DataFrame, keys: Sequence[str], file: str) -> DataFrame:
    """Rows of the first file that holds their keys; repeats inside one file stay, null keys are equal."""
    first = df.groupBy(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)]).agg(F.min(file).alias("_first"))
    same = [df[k].eqNullSafe(first[f"_k{i}"]) for i, k in enumerate(keys)]
    return df.join(first, [*same, df[file] == first["_first"]], "left_semi")


def fingerprint(columns: Sequence[str]) -> Column:
    """Digest of a row's business content; null and empty differ."""
    return F.sha2(F.to_json(F.struct(*[F.col(c).cast("string").alias(f"c{i}") for i, c in enumerate(columns)]), {"ignoreNullFields": "false"}), 256)


def incremental(df: DataFrame, columns: Sequence[str], source: str, order: Sequence[str]) -> DataFrame:
    """Rows from the source that delivered their fingerprint first: overlapping deliveries count once."""
    told = df.withColumn("_print", fingerprint(columns))
    first = told.groupBy("_print").agg(F.min_by(source, F.struct(*order)).alias("_source"))
    return told.join(first, "_print").where(F.col(source) == F.col("_source")).drop("_print", "_source")


def preferred(df: DataFrame, anchor: Sequence[str], prefer: Column, order: Sequence[str]) -> DataFrame:
    """One row per physical row, one for which the condition holds if there is any."""
    told = df.withColumn("_other", ~F.coalesce(prefer, F.lit(False)))
    return first_wins(told, anchor, ["_other", *order]).drop("_other")


def numbered(df: DataFrame, order: Sequence[str], name: str = "row_no", parts: int | None = None) -> DataFrame:
    """A gapless row number by a total order, without bringing all rows to one task.

    Rows are dealt in ranges and kept, so that the ranges are drawn once; a row's place in
    its range is in its id, and the sizes of the ranges (one number each) become offsets.
    """
    dealt = df.repartitionByRange(*([parts] if parts else []), *order).sortWithinPartitions(*order)
    kept = staged(dealt.withColumn("_id", F.monotonically_increasing_id()))
    kept = kept.withColumns({"_part": F.shiftright("_id", 33), "_in": F.col("_id").bitwiseAND((1 << 33) - 1)}).drop("_id")
    sizes = kept.groupBy("_part").agg(F.max("_in").alias("_n"))
    offsets = sizes.select(F.col("_part").alias("_p"), (F.sum(F.col("_n") + 1).over(Window.orderBy("_part")) - F.col("_n")).alias("_first"))
    return kept.join(F.broadcast(offsets), F.col("_part") == F.col("_p")).withColumn(name, F.col("_first") + F.col("_in")).drop("_part", "_p", "_in", "_first")


def digest_sums(columns: Sequence[str]) -> list[Column]:
    """Aggregates from which `digest_of` makes the digest of a multiset of rows: their digests added up as numbers, so nothing is gathered or sorted."""
    one = fingerprint(columns)
    return [F.sum(F.conv(F.substring(one, 1 + 15 * i, 15), 16, 10).cast("decimal(20,0)")).alias(f"_part{i}") for i in range(4)]


def digest_of(parts: Sequence[Column]) -> Column:
    return F.sha2(F.concat_ws(":", *[p.cast("string") for p in parts]), 256)


def multiset_digest(df: DataFrame, columns: Sequence[str], keys: Sequence[str] = ()) -> DataFrame:
    """(keys, rows, digest) that are equal for equal multisets of rows in any order."""
    return df.groupBy(*keys).agg(F.count("*").alias("rows"), digest_of(digest_sums(columns)).alias("digest"))
