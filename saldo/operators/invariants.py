"""Assertions over tables: five families of invariants, materiality, trust, gates, and experiments.

Every check is one aggregate that yields a row per scope; nothing is counted on the driver.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from saldo.functions.money import MONEY, WIDE, within
from saldo.functions.predicates import predicate


def _side(spec: Mapping, amount: str) -> Column:
    chosen = predicate(spec["select"])
    return F.coalesce(F.sum(F.when(chosen, F.col(amount).cast(MONEY))), F.lit(0).cast("decimal(30,4)")) * spec.get("sign", 1)


def _verdict(told: DataFrame, expected: Column, absolute: str, relative: str) -> DataFrame:
    told = told.withColumn("difference", (F.col("left_total") - expected).cast("decimal(34,4)"))
    return told.withColumn("holds", within(F.col("left_total"), expected, absolute, relative))


def equality(df: DataFrame, scope: Sequence[str], left: Mapping, right: Mapping, amount: str, absolute: str = "0.01", relative: str = "0") -> DataFrame:
    """Two selected sums agree within the larger tolerance."""
    told = df.groupBy(*scope).agg(_side(left, amount).cast("decimal(34,4)").alias("left_total"), _side(right, amount).cast("decimal(34,4)").alias("right_total"))
    return _verdict(told, F.col("right_total"), absolute, relative)


def conservation(df: DataFrame, scope: Sequence[str], inputs: Sequence[Mapping], outputs: Sequence[Mapping], amount: str, absolute: str = "0.01", relative: str = "0") -> DataFrame:
    """What goes in comes out: sums of several selections on either side."""
    both = [sum((_side(s, amount) for s in sides[1:]), _side(sides[0], amount)).cast("decimal(34,4)") for sides in (inputs, outputs)]
    told = df.groupBy(*scope).agg(both[0].alias("left_total"), both[1].alias("right_total"))
    return _verdict(told, F.col("right_total"), absolute, relative)


def proportionality(df: DataFrame, scope: Sequence[str], target: Mapping, base: Mapping, rate: str, amount: str, absolute: str = "0.01", relative: str = "0") -> DataFrame:
    """A sum is a rate of another."""
    told = df.groupBy(*scope).agg(_side(target, amount).cast("decimal(34,4)").alias("left_total"), _side(base, amount).cast("decimal(24,4)").alias("base_total"))
    told = told.withColumn("right_total", F.bround(F.col("base_total") * F.lit(rate).cast("decimal(10,6)"), 4).cast("decimal(34,4)")).drop("base_total")
    return _verdict(told, F.col("right_total"), absolute, relative)


def uniqueness(df: DataFrame, scope: Sequence[str], keys: Sequence[str]) -> DataFrame:
    """Rows and distinct keys of each scope; it holds if no key repeats."""
    counted = df.groupBy(*scope, *keys).agg(F.count("*").alias("_n"))
    told = counted.groupBy(*scope).agg(F.sum("_n").cast(WIDE).alias("left_total"), F.count("*").cast(WIDE).alias("right_total"), F.count_if(F.col("_n") > 1).alias("repeated"))
    return told.withColumn("holds", F.col("repeated") == 0)


def completeness(left: DataFrame, right: DataFrame, keys: Sequence[str], scope: Sequence[str] = ()) -> DataFrame:
    """Every key of the left is on the right."""
    need = left.select(*scope, *keys).distinct()
    have = right.select(*[F.col(k).alias(f"_r{i}") for i, k in enumerate(keys)]).distinct()
    told = need.join(have, [F.col(k).eqNullSafe(F.col(f"_r{i}")) for i, k in enumerate(keys)], "left").withColumn("_hit", F.col("_r0").isNotNull() if keys else F.lit(True))
    out = told.groupBy(*scope).agg(F.count("*").alias("needed"), F.count_if(~F.col("_hit")).alias("missing"))
    return out.withColumn("holds", F.col("missing") == 0)


def materiality(df: DataFrame, difference: str, scope: Sequence[str], revenue: str, single: str, cumulative: str, share: str) -> DataFrame:
    """Which legs make a scope's differences material: one item, all of them, or their share of revenue."""
    gap = F.abs(F.col(difference).cast(MONEY))
    told = df.groupBy(*scope).agg(F.max(gap).alias("largest"), F.sum(gap).alias("cumulative"), F.max(F.col(revenue).cast(MONEY)).alias("revenue"))
    legs = [
        F.when(F.col("largest") >= F.lit(single).cast(MONEY), "single_item"),
        F.when(F.col("cumulative") >= F.lit(cumulative).cast(MONEY), "cumulative"),
        F.when((F.col("revenue") > 0) & (F.col("cumulative") >= (F.col("revenue") * F.lit(share).cast("decimal(8,6)"))), "revenue_share"),
    ]
    return told.withColumn("reasons", F.concat_ws(",", *legs)).withColumn("material", F.col("reasons") != "")


def trust_tier(reconciled: Column, complete: Column, material: Column, disclosed: Column) -> Column:
    """certified, conditional, or unverified."""
    sure = lambda c: F.coalesce(c, F.lit(False))
    return F.when(sure(reconciled) & sure(complete) & ~sure(material), "certified").when(sure(complete) & sure(disclosed), "conditional").otherwise("unverified")


def gates(df: DataFrame, checks: Mapping[str, Column], name: str = "table") -> DataFrame:
    """(gate, failures, rows, passed) for conditions that must hold in every row, in one pass."""
    aggregates = [F.count_if(~F.coalesce(c, F.lit(False))).alias(f"g{i}") for i, c in enumerate(checks.values())]
    row = df.agg(F.count("*").alias("rows"), *aggregates)
    entries = F.array(*[F.struct(F.lit(gate).alias("gate"), F.col(f"g{i}").alias("failures")) for i, gate in enumerate(checks)])
    out = row.select("rows", F.explode(entries).alias("_e")).select("_e.gate", "_e.failures", "rows")
    return out.withColumn("passed", (F.col("failures") == 0) & (F.col("rows") > 0))


def compare_outcomes(before: DataFrame, after: DataFrame, subject: str, status: str, exposure: str) -> DataFrame:
    """Subjects of either run: newly resolved, newly unresolved, larger exposure, or unchanged."""
    joined = before.select(subject, F.col(status).alias("was"), F.col(exposure).alias("was_exposure")).join(after.select(subject, F.col(status).alias("now"), F.col(exposure).alias("now_exposure")), subject, "full_outer")
    was, now = F.coalesce("was", F.lit("absent")), F.coalesce("now", F.lit("absent"))
    change = (
        F.when((was == "unresolved") & (now == "resolved"), "newly_resolved")
        .when((was != "unresolved") & (now == "unresolved"), "newly_unresolved")
        .when((was == "unresolved") & (now == "unresolved") & (F.abs("now_exposure") > F.abs("was_exposure")), "exposure_increase")
        .otherwise("unchanged")
    )
    return joined.withColumn("change", change)


def experiment(compared: DataFrame, least_gain: int = 1) -> DataFrame:
    """One row: the counts of changes, the change of exposure, and the verdict."""
    count = lambda kind: F.count_if(F.col("change") == kind)
    told = compared.agg(
        count("newly_resolved").alias("newly_resolved"),
        count("newly_unresolved").alias("newly_unresolved"),
        count("exposure_increase").alias("exposure_increases"),
        (F.coalesce(F.sum(F.abs("now_exposure")), F.lit(0)) - F.coalesce(F.sum(F.abs("was_exposure")), F.lit(0))).cast("decimal(34,4)").alias("exposure_change"),
    )
    worse = (F.col("newly_unresolved") > 0) | (F.col("exposure_increases") > 0)
    return told.withColumn("verdict", F.when(worse, "rejected").when(F.col("newly_resolved") >= least_gain, "supported").otherwise("inconclusive"))


# The metrics that two runs are compared by.
METRICS = (
    "unresolved_count", "unresolved_amount_abs", "line_auto_rate", "amount_weighted_auto_rate", "explained_amount_ratio", "control_total_gap", "invariant_pass_delta",
    "major_reversal_count", "newly_unresolved_count", "baseline_regression_count", "evidence_integrity_failures", "certifiable", "profit_completeness", "claim_acceptance_rate",
)


def metric_deltas(before: DataFrame, after: DataFrame, keys: Sequence[str]) -> DataFrame:
    """(keys, metric, before, after, delta) of every metric of two runs; a metric or a run that is missing counts as zero, and of a
    gap against control totals only the size counts."""
    zero = F.lit(0).cast(MONEY)

    def figures(df: DataFrame, side: str) -> DataFrame:
        known = [F.coalesce(F.col(m).cast(MONEY), zero) if m in df.columns else zero for m in METRICS]
        return df.select(*keys, F.struct(*[c.alias(m) for c, m in zip(known, METRICS, strict=True)]).alias(side))

    def told(m: str) -> Column:
        was, now = (F.coalesce(F.col(side)[m], zero) for side in ("_was", "_now"))
        delta = F.abs(now) - F.abs(was) if m == "control_total_gap" else now - was
        return F.struct(F.lit(m).alias("metric"), was.alias("before"), now.alias("after"), delta.cast(MONEY).alias("delta"))

    both = figures(before, "_was").join(figures(after, "_now"), list(keys), "full")
    return both.select(*keys, F.explode(F.array(*map(told, METRICS))).alias("_m")).select(*keys, "_m.*")


def situation(amount: Column, key: Column, side: Column) -> Column:
    """Fingerprint of a difference: its sign, its size as a power of ten, the key's shape, its side."""
    value = amount.cast(MONEY)
    sign = F.when(value > 0, "+").when(value < 0, "-").otherwise("0")
    whole = F.floor(F.abs(value)).cast("decimal(20,0)").cast("string")
    size = F.when(F.abs(value) < 1, F.lit(0)).otherwise(F.length(whole))
    shape = F.regexp_replace(F.regexp_replace(key.cast("string"), r"\p{L}+", "A"), r"\p{Nd}+", "D")
    return F.concat_ws("|", sign, size.cast("string"), shape, side)
