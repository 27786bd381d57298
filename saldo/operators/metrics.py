"""Metric declarations compiled to one plan over all their sources.

A metric is {id, source, value, where, sign, link, allocate, time, platform, by_platform}:

- `link` names the source's key of the spine; without it the source's own context counts
- `allocate` is 'even', 'ratio' (by the spine's share column), or none: the key's first spine row takes all
- `time` names the source's own date; without it linked money falls in the month of its spine row
- `platform` limits it to one platform; `by_platform` gives platforms a `where`, `sign` or `allocate` of their
  own, or {'disabled': true}

Every source is scanned once: each row is unfolded into the lanes (link, time) that its metrics take, and
summed by key and month before anything is joined. All sources meet the spine in one join by key,
whose parts and first rows come from windows over the same shuffle. Money without a spine row stays in the result,
under a null context. A key's spine rows are brought together in one task, as the rows of one order are.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from saldo.functions.money import MONEY
from saldo.functions.predicates import where
from saldo.functions.text import period
from saldo.operators.link import key_of
from saldo.operators.statement import node, ordered, value

FIELDS = {"id", "source", "value", "where", "sign", "link", "allocate", "time", "platform", "by_platform"}
SUM = "decimal(38,6)"


class MetricError(ValueError):
    """A declaration that can't be compiled."""


@dataclass(frozen=True)
class Variant:
    """How a metric is worked out on one platform; None: on all that have none of their own."""

    platform: str | None
    column: str
    where: Sequence[Mapping]
    sign: int
    allocate: str | None


@dataclass(frozen=True)
class Spine:
    """The rows that money is put on: their key, context, date, order inside a key, and the column that shares are taken from."""

    rows: DataFrame
    key: str
    context: Sequence[str]
    platform: str
    date: str
    order: Sequence[str]
    share: str | None = None


def variants(m: Mapping) -> list[Variant]:
    """The ways in which a metric is worked out, the general one last; platforms on which it is disabled have none."""
    if unknown := set(m) - FIELDS:
        raise MetricError(f"{m.get('id')}: unknown {sorted(unknown)}")
    every = {None: {}} | m.get("by_platform", {}) if m.get("platform", "*") == "*" else {m["platform"]: m.get("by_platform", {}).get(m["platform"], {})}
    out = []
    for i, (platform, own) in enumerate(sorted(every.items(), key=lambda x: (x[0] is None, x[0] or ""))):
        if own.get("disabled"):
            continue
        allocate = own.get("allocate", m.get("allocate"))
        if allocate not in (None, "even", "ratio"):
            raise MetricError(f"{m['id']}: no allocation {allocate}")
        out.append(Variant(platform, f"{m['id']}__{i}", own.get("where", m.get("where", ())), own.get("sign", m.get("sign", 1)), allocate))
    return out


def disabled(m: Mapping) -> list[str]:
    return [p for p, own in m.get("by_platform", {}).items() if own.get("disabled")]


def lanes(source: DataFrame, metrics: Sequence[Mapping], context: Sequence[str]) -> DataFrame:
    """(lane context, link key, month, one sum a variant) of a source's metrics, from one scan."""
    kinds = sorted({(m.get("link") or "", m.get("time") or "") for m in metrics})
    names = [v.column for m in metrics for v in variants(m)]
    entries = []
    for link, time in kinds:
        if not link and not time:
            raise MetricError("money without a key needs a time of its own")
        amounts = {}
        for m in metrics:
            if (m.get("link") or "", m.get("time") or "") == (link, time):
                for v in variants(m):
                    amount = F.bround(value(m["value"]), 4).cast(MONEY)
                    amounts[v.column] = F.when(where(v.where), amount * v.sign)
        own = [(F.lit(None) if link else F.col(c)).cast(source.schema[c].dataType if c in source.columns else "string").alias(c) for c in context]
        key = key_of(source, link) if link else F.lit(None).cast("string")
        month = period(F.col(time)) if time else F.lit(None).cast("string")
        entries.append(F.struct(F.lit(bool(link)).alias("_linked"), *own, key.alias("_key"), month.alias("_month"), *[amounts.get(n, F.lit(None)).cast(MONEY).alias(n) for n in names]))
    unfolded = source.select(F.explode(F.array(*entries)).alias("_e")).select("_e.*") if len(entries) > 1 else source.select(entries[0].alias("_e")).select("_e.*")
    return unfolded.groupBy("_linked", *context, "_key", "_month").agg(*[F.sum(n).cast(SUM).alias(n) for n in names])


def chosen(m: Mapping, platform: Column, amount) -> Column:
    """The amount of the variant that a platform takes; nothing where the metric is disabled or of another platform."""
    own = [v for v in variants(m) if v.platform is not None]
    general = next((v for v in variants(m) if v.platform is None), None)
    out = F
    for p in disabled(m):
        out = out.when(platform == p, F.lit(0).cast(SUM))
    for v in own:
        out = out.when(platform == v.platform, amount(v))
    otherwise = amount(general) if general else F.lit(0).cast(SUM)
    return (otherwise if out is F else out.otherwise(otherwise)).cast(SUM)


def compiled(metrics: Sequence[Mapping], sources: Mapping[str, DataFrame], spine: Spine, by_key: bool = False) -> DataFrame:
    """One row per context and month, or per link key, with the exact sum of every metric, six decimals.

    Money whose key the spine lacks comes under a null context, in the month that its source tells if it tells one.
    """
    ids = [m["id"] for m in metrics]
    if len(set(ids)) != len(ids):
        raise MetricError("ids are not unique")
    summed = {}
    for name in sorted({m["source"] for m in metrics}):
        if name not in sources:
            raise MetricError(f"no source {name}")
        summed[name] = lanes(sources[name], [m for m in metrics if m["source"] == name], spine.context)
    columns = [v.column for m in metrics for v in variants(m)]
    both = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), summed.values())
    grouped = both.groupBy("_linked", *spine.context, "_key", "_month").agg(*[F.sum(c).cast(SUM).alias(c) for c in columns])
    w = Window.partitionBy("_key")
    net = F.greatest(F.coalesce(F.col(spine.share).cast(MONEY), F.lit(0)), F.lit(0).cast(MONEY)) if spine.share else F.lit(0).cast(MONEY)
    rows = spine.rows.select(key_of(spine.rows, spine.key).alias("_key"), *spine.context, period(F.col(spine.date)).alias("_own"), net.alias("_net"), *[F.col(c).alias(f"_o{i}") for i, c in enumerate(spine.order)])
    rows = rows.where("_key is not null").withColumns({
        "_even": F.lit(1.0) / F.count("*").over(w), "_all": F.sum("_net").over(w), "_first": F.row_number().over(w.orderBy(*[f"_o{i}" for i in range(len(spine.order))])) == 1,
    })
    share = F.when(F.col("_all") > 0, F.col("_net").cast("double") / F.col("_all").cast("double")).otherwise(F.col("_even"))
    part = {"even": F.col("_even"), "ratio": share, None: F.when(F.col("_first"), 1.0).otherwise(0.0)}
    placed = rows.select("_key", *[F.col(c).alias(f"_s_{c}") for c in spine.context], "_own", *[part[a].cast("decimal(18,12)").alias(f"_p_{a}") for a in part], F.lit(True).alias("_met"))
    linked = grouped.where("_linked").drop(*spine.context, "_linked").join(placed, "_key", "left")
    platform = F.col(f"_s_{spine.platform}")
    put = lambda v: F.when(F.col("_met"), F.round(F.col(v.column).cast("decimal(20,4)") * F.col(f"_p_{v.allocate}"), 6)).otherwise(F.col(v.column))
    linked = linked.select(*[F.col(f"_s_{c}").alias(c) for c in spine.context], F.coalesce("_month", "_own").alias("period"), F.col("_key").alias("link_key"), *[F.coalesce(chosen(m, platform, put), F.lit(0)).alias(m["id"]) for m in metrics])
    direct = grouped.where("not _linked")
    direct = direct.select(*spine.context, F.col("_month").alias("period"), F.lit(None).cast("string").alias("link_key"), *[F.coalesce(chosen(m, F.col(spine.platform), lambda v: F.col(v.column)), F.lit(0)).alias(m["id"]) for m in metrics])
    keys = ["link_key"] if by_key else [*spine.context, "period"]
    return linked.unionByName(direct).groupBy(*keys).agg(*[F.sum(i).cast(SUM).alias(i) for i in ids])


def stated(totals: DataFrame, metrics: Sequence[str], nodes: Sequence[Mapping], platform: str) -> DataFrame:
    """Sums as cents, halves away from zero, and every node of a statement; a node with `applies` is null on other platforms, and what needs it follows.

    Nodes are worked out from the exact sums, so cents are rounded once.
    """
    def exact(spec: Mapping) -> Column:
        """A node with all six decimals of the sums; ratios and constants are as in a statement."""
        of = [F.col(c).cast(SUM) for c in spec.get("of", ())]
        if spec["op"] == "negate":
            return (-of[0]).cast(SUM)
        if spec["op"] != "add":
            return node(spec)
        if spec.get("total"):
            return reduce(lambda a, b: (a + b).cast(SUM), of)
        return F.when(F.coalesce(*of).isNotNull(), reduce(lambda a, b: (a + b).cast(SUM), [F.coalesce(c, F.lit(0).cast(SUM)) for c in of]))

    wide = totals
    for spec in ordered([{k: v for k, v in n.items() if k != "applies"} for n in nodes], set(metrics)):
        limit = next(n.get("applies") for n in nodes if n["id"] == spec["id"])
        wide = wide.withColumn(spec["id"], F.when(F.coalesce(F.col(platform).isin(*limit), F.lit(False)), exact(spec)) if limit else exact(spec))
    money = [*metrics, *[n["id"] for n in nodes if n["op"] != "ratio"]]
    return wide.withColumns({c: F.round(c, 2).cast("decimal(38,2)") for c in money})
