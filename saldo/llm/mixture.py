"""Mixing sources to target weights by weighted sampling without replacement.

A source's target is its share of all words by weight, but never more than MOST times its own
words; what it can't take is shared anew among the others, until none is above. The target is
first filled with complete epochs, every document once each. What is left is filled in the order
of Efraimidis and Spirakis: each document draws an exponential key, divided by its quality weight,
and documents are taken by ascending key until their words reach the budget; the document at the
edge is cut there, so a source's words are its target, rounded down.

Sorting and summing of a source is done digit by digit, as a source may hold most rows: the
words of BINS ranges of keys are added up by a grouped aggregate, the range in which the budget
ends is split into BINS ranges again, and only documents of that last range (a millionth of a
source) are sorted. What is joined back to the documents is one row a source, broadcast if there
are at most BROADCAST_SOURCES of them, which is counted first, and shuffled beyond.

Edge cases: null and empty texts have size 0 and nothing is taken; a source without words has
target 0; null is a source of its own, the last in order; ties of keys go by id and size. Repeated
rows draw keys of their own: which of several equal rows is taken makes no difference to the
result. A quality weight that is null or no number counts as 1, one that is not above 0 as last in
order. An empty table gives an empty result. Other columns are not read, whatever their names.
Keys come from digests of ids, so reruns agree in any order of rows.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from saldo.llm.shared import forget, staged
from saldo.operators.dedupe import numbered

WORD = r"[^\x20\x09-\x0D]+"
#: Ranges of keys on each of the two levels.
BINS = 1024
#: Rows of one a source are broadcast up to so many (about 100 bytes each).
BROADCAST_SOURCES = 100_000


def uniform(text: Column) -> Column:
    """A number between 0 and 1, exclusive, from a text's digest."""
    return (F.conv(F.substring(F.md5(text), 1, 13), 16, 10).cast("bigint") + F.lit(0.5)) / F.lit(float(1 << 52))


def keyed(docs: DataFrame, quality: DataFrame | None, id_col: str, text_col: str, source_col: str, seed: str) -> DataFrame:
    """(doc_id, source, size, key, range, finer) of every row; `quality` has (doc_id, weight)."""
    size = F.coalesce(F.regexp_count(text_col, F.lit(WORD)), F.lit(0)).cast("bigint")
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(source_col).alias("source"), size.alias("size"))
    if quality is None:
        rows = rows.withColumn("weight", F.lit(1.0))
    else:
        one = quality.groupBy("doc_id").agg(F.avg(F.col("weight").cast("double")).alias("weight"))
        rows = rows.join(one, "doc_id", "left")
    weight = F.when(F.isnan("weight"), 1.0).otherwise(F.coalesce("weight", F.lit(1.0)))
    # Equal rows become one with their number, and as many again, each with a number of its own to draw by.
    rows = rows.withColumn("weight", weight).groupBy("doc_id", "source", "size", "weight").agg(F.count("*").alias("n"))
    rows = rows.select("doc_id", "source", "size", "weight", F.explode(F.sequence(F.lit(1), F.col("n").cast("int"))).alias("copy"))
    drawn = uniform(F.concat_ws(":", F.lit(seed), F.coalesce(F.col("doc_id").cast("string"), F.lit("")), "copy"))
    rows = rows.withColumn("key", F.when(F.col("weight") > 0, -F.log(drawn) / F.col("weight")).otherwise(float("inf")))
    place = F.least(F.floor((1 - F.exp(-F.col("key"))) * BINS * BINS), F.lit(BINS * BINS - 1))
    return rows.select("doc_id", "source", "size", "copy", "key", (place / BINS).cast("int").alias("range"), (place % BINS).cast("int").alias("finer"))


def targets(sizes: DataFrame, shares: Sequence[int], most: int) -> DataFrame:
    """(source, source_size, target) of a table (source, source_size); staged.

    A round finds the sources that what is left would lift above their limit and takes them
    out; it comes to the driver as three sums. It ends when no source is added.
    """
    ordered = numbered(sizes.withColumn("_last", F.col("source").isNull()), ["_last", "source"], "_no")
    cycle = F.array(*[F.lit(s) for s in shares])
    known = staged(ordered.select("source", "source_size", F.get(cycle, ((F.col("_no") - 1) % len(shares)).cast("int")).cast("bigint").alias("share")))
    wide, limit = lambda c: c.cast("decimal(19,0)"), F.col("source_size") * most

    def above(rest: int, weights: int) -> Column:
        return wide(F.lit(rest)) * wide(F.col("share")) > wide(limit) * wide(F.lit(weights))

    total, every = known.agg(F.coalesce(F.sum("source_size"), F.lit(0)), F.coalesce(F.sum("share"), F.lit(0))).first()
    rest, weights, full = total, every, 0
    while True:
        over = above(rest, weights)
        n, taken, gone = known.where(over).agg(F.count("*"), F.coalesce(F.sum(limit), F.lit(0)), F.coalesce(F.sum("share"), F.lit(0))).first()
        if n == full:
            break
        rest, weights, full = total - taken, every - gone, n
    share = F.lit(float(rest)) * F.col("share").cast("double") / F.lit(float(weights))
    return staged(known.select("source", "source_size", F.when(over, limit.cast("double")).otherwise(F.coalesce(share, F.lit(0.0))).alias("target")))


def edges(words: DataFrame, left: DataFrame, place: str) -> DataFrame:
    """Where each source's budget ends: the `place` of (source, place, words) in which `left` of (source, left) falls, and what is left inside it."""
    own = Window.partitionBy("source").orderBy(place).rowsBetween(Window.unboundedPreceding, 0)
    summed = words.withColumn("_upto", F.sum("words").over(own))
    met = summed.join(left.withColumnRenamed("source", "_source"), F.col("source").eqNullSafe(F.col("_source")))
    here = (F.col("_upto") > F.col("left")) & (F.col("_upto") - F.col("words") <= F.col("left"))
    return met.where(here).select("source", place, (F.col("left") - F.col("_upto") + F.col("words")).alias("left"))


def mix(
    docs: DataFrame,
    quality: DataFrame | None = None,
    shares: Sequence[int] = (5, 2, 1),
    most: int = 3,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
    seed: str = "mix",
) -> DataFrame:
    """(doc_id, size, source_size, target, taken) of every row: words, its source's words and target, and the words that the mix takes of it, repeats counted."""
    rows = staged(keyed(docs, quality, id_col, text_col, source_col, seed))
    words = staged(rows.groupBy("source", "range").agg(F.sum("size").alias("words")))
    told = targets(words.groupBy("source").agg(F.sum("words").alias("source_size")), shares, most)
    few = told.count() <= BROADCAST_SOURCES

    def by_source(table: DataFrame, one: DataFrame) -> DataFrame:
        one = one.withColumnRenamed("source", "_source")
        return table.join(F.broadcast(one) if few else one, F.col("source").eqNullSafe(F.col("_source")), "left").drop("_source")

    budget = F.floor("target").cast("bigint")
    epochs = F.when(F.col("source_size") > 0, F.floor(budget / F.col("source_size"))).otherwise(0).cast("bigint")
    plan = told.withColumn("epochs", epochs).withColumn("left", budget - F.col("epochs") * F.col("source_size"))
    coarse = staged(edges(words, plan.select("source", "left"), "range").withColumnRenamed("range", "at"))
    inside = by_source(rows, coarse.select("source", "at")).where("range = at").groupBy("source", "finer").agg(F.sum("size").alias("words"))
    fine = edges(inside, coarse.select("source", "left"), "finer").select(F.col("source").alias("_s"), F.col("finer").alias("finer_at"), F.col("left").alias("rest"))
    ends = coarse.select("source", "at").join(fine, F.col("source").eqNullSafe(F.col("_s"))).select("source", "at", "finer_at", "rest")
    ends = ends.withColumnRenamed("source", "_s")
    plan = staged(plan.join(ends, F.col("source").eqNullSafe(F.col("_s")), "left").select("source", "source_size", "target", "epochs", "at", "finer_at", "rest"))
    met = by_source(rows, plan)
    edge = (F.col("range") == F.col("at")) & (F.col("finer") == F.col("finer_at"))
    before = (F.col("range") < F.col("at")) | ((F.col("range") == F.col("at")) & (F.col("finer") < F.col("finer_at")))
    own = Window.partitionBy("source").orderBy("key", "doc_id", "copy", "size").rowsBetween(Window.unboundedPreceding, 0)
    cut = F.least(F.col("size"), F.greatest(F.lit(0), F.col("rest") - F.sum("size").over(own) + F.col("size")))
    whole = F.when(before, F.col("size")).otherwise(0)
    out = lambda table, more: table.select("doc_id", "size", "source_size", "target", (F.col("epochs") * F.col("size") + more).cast("bigint").alias("taken"))
    forget(words, told, coarse)
    return out(met.where(~F.coalesce(edge, F.lit(False))), F.coalesce(whole, F.lit(0))).unionByName(out(met.where(edge), cut))


def quality_weights(labels: DataFrame) -> DataFrame:
    """(doc_id, weight) of labelled documents: 2 for good ones, 0.5 for others; documents without a label weigh 1."""
    return labels.select("doc_id", F.when(F.col("quality") == 1, 2.0).when(F.col("quality") == 0, 0.5).alias("weight"))
