"""Checks over a period's figures: findings, gaps, orphaned categories, differences between two runs.

A check is declared as {id, kind, threshold, blocking, ...}; every kind becomes an aggregate over
the rows that it concerns, and all findings have one shape: (keys, check, value, limit, passed, blocking).
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from saldo.functions.money import MONEY, column
from saldo.operators.profile import MOST_BROADCAST
from saldo.sources.shared import staged

KINDS = ("link_rate", "coverage", "unclassified", "orphan_major", "completeness", "tie_out", "unlinked")
#: Gaps from the gravest to the lightest.
SEVERITIES = ("blocking", "missing", "empty", "zero_with_rows", "nothing_linked", "dropped_to_zero", "coverage", "unclassified", "unlinked")


class CheckError(ValueError):
    """A declaration that is no check."""


def checked(spec: Mapping) -> Mapping:
    """The check, if its kind is known, its threshold a number and a tie-out has two sides."""
    if spec.get("kind") not in KINDS or not spec.get("id"):
        raise CheckError(f"no check: {dict(spec)}")
    if spec["kind"] == "tie_out" and not (spec.get("left") and spec.get("right")):
        raise CheckError(f"{spec['id']} lacks a side")
    float(spec.get("threshold", 0))
    return spec


def finding(spec: Mapping, figures: DataFrame, keys: Sequence[str], value: Column, at_least: bool) -> DataFrame:
    """One finding per keys: the value against the threshold; a value that is null passes, as there is nothing to judge."""
    limit = F.lit(float(spec.get("threshold", 0)))
    value = value.cast("double")
    passed = F.coalesce(value >= limit if at_least else value <= limit, F.lit(True))
    told = figures.select(*keys, F.lit(spec["id"]).alias("check"), value.alias("value"), limit.alias("limit"), passed.alias("passed"))
    return told.withColumn("blocking", ~F.col("passed") & F.lit(bool(spec.get("blocking"))))


def findings(specs: Sequence[Mapping], tables: Mapping[str, DataFrame], keys: Sequence[str]) -> DataFrame:
    """Findings of all checks. Tables by name: `links` (linked), `majors` (major, covered, amount), `sources` (required, arrived),
    `statement` (a column for each node)."""
    out = []
    for spec in map(checked, specs):
        kind = spec["kind"]
        if kind == "link_rate":
            figures = tables["links"].groupBy(*keys).agg(F.avg(F.col("linked").cast("double")).alias("v"))
        elif kind == "unlinked":
            figures = tables["links"].groupBy(*keys).agg(F.sum(F.when(~F.col("linked"), F.abs("amount")).otherwise(F.lit(0).cast(MONEY))).alias("v"))
        elif kind == "unclassified":
            figures = tables["majors"].groupBy(*keys).agg(F.count_if(F.col("major").isNull()).alias("v"))
        elif kind == "orphan_major":
            figures = tables["majors"].groupBy(*keys).agg(F.sum(F.when(F.col("major").isNotNull() & ~F.col("covered"), F.abs("amount")).otherwise(F.lit(0).cast(MONEY))).alias("v"))
        elif kind in ("coverage", "completeness"):
            figures = tables["sources"].where("required").groupBy(*keys).agg(F.avg(F.col("arrived").cast("double")).alias("v"))
        else:
            sides = [reduce(lambda a, b: a + b, [F.col(c).cast(MONEY) for c in spec[s]]) for s in ("left", "right")]
            figures = tables["statement"].select(*keys, F.abs(sides[0] - sides[1]).alias("v"))
        out.append(finding(spec, figures, keys, F.col("v"), kind in ("link_rate", "coverage", "completeness")))
    return reduce(DataFrame.unionByName, out)


def unmatched(rows: DataFrame, label: str, major: str, amount: str, anchor: Sequence[str]) -> DataFrame:
    """(label, rows, amount) of rows that no rule claims; a physical row that several metrics look at counts once per label."""
    lost = rows.where(F.col(major).isNull()).groupBy(*anchor, label).agg(F.min(F.col(amount).cast(MONEY)).alias("_amount"))
    return lost.groupBy(label).agg(F.count("*").alias("rows"), F.sum("_amount").alias("amount"))


def orphan_majors(rows: DataFrame, metrics: DataFrame, platform: str, major: str, amount: str, anchor: Sequence[str]) -> DataFrame:
    """(platform, major, rows, amount) of categories for which some platform has a metric (platform, major), but not this one.

    Metrics are counted first, and up to 100,000 of them go to the rows, of which few are then left to tell apart; more
    of them choose among the categories' sums. Rows are never dealt by category, as there are few.
    """
    known = metrics.select(F.col(major).alias("_known")).distinct()
    covered = metrics.select(F.col(platform).alias("_p"), F.col(major).alias("_m")).distinct()
    few = metrics.limit(MOST_BROADCAST + 1).count() <= MOST_BROADCAST
    if few:
        known, covered = F.broadcast(known), F.broadcast(covered)

    def lost(df: DataFrame) -> DataFrame:
        some = df.join(known, F.col(major) == F.col("_known"), "left_semi")
        return some.join(covered, (F.col(platform) == F.col("_p")) & (F.col(major) == F.col("_m")), "left_anti")

    named = rows.where(F.col(major).isNotNull() & (F.col(major) != ""))
    once = (lost(named) if few else named).groupBy(*anchor, platform, major).agg(F.min(F.col(amount).cast(MONEY)).alias("_amount"))
    told = once.groupBy(platform, major).agg(F.count("*").alias("rows"), F.sum("_amount").alias("amount"))
    return told if few else lost(told)


def gaps(figures: DataFrame, keys: Sequence[str], node: str, value: str, before: str, rows: str, linked: str, expected: str, blocking: str | None = None, every: bool = False, unclassified: str | None = None) -> DataFrame:
    """The gravest gap of every (keys, node): a blocking finding, missing, empty, zero though it has rows, nothing linked, money last month
    but none now, fewer linked rows than expected, rows that no rule claims (the column `unclassified` counts them), or rows
    that are not linked; none where all is well. With `every`, all its gaps, a row each."""
    v, n = F.col(value), F.coalesce(F.col(rows), F.lit(0))
    kinds = [
        ("blocking", F.col(blocking) if blocking else F.lit(False)),
        ("missing", (n == 0) & F.coalesce(F.col(expected) > 0, F.lit(False))),
        ("empty", v.isNull()),
        ("zero_with_rows", (v == 0) & (n > 0)),
        ("nothing_linked", (n > 0) & (F.col(linked) == 0)),
        ("dropped_to_zero", (v == 0) & (F.coalesce(F.col(before), F.lit(0)) != 0)),
        ("coverage", F.col(linked) < F.col(expected)),
        ("unclassified", F.col(unclassified) > 0 if unclassified else F.lit(False)),
        ("unlinked", F.col(linked) < n),
    ]
    found = [F.when(F.coalesce(test, F.lit(False)), F.lit(k)) for k, test in kinds]
    kind = F.explode(F.array_compact(F.array(*found))) if every else F.coalesce(*found)
    rank = F.array_position(F.array(*map(F.lit, SEVERITIES)), F.col("kind")).cast("int")
    return figures.select(*keys, node, kind.alias("kind"), v.alias("amount")).where("kind is not null").withColumn("severity", rank)


def slice_keys(facts: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Distinct keys, none of them null or empty."""
    return facts.where(reduce(lambda a, b: a & b, [F.col(k).isNotNull() & (F.col(k).cast("string") != "") for k in keys])).select(*keys).distinct()


def replayed(current: DataFrame, baseline: DataFrame, keys: Sequence[str], fields: Sequence[str]) -> DataFrame:
    """(keys, path, was, now, change) of every field that differs between two runs: changed, or added or removed with its row; a field
    that turns null has changed."""

    def flat(df: DataFrame, name: str) -> DataFrame:
        entries = F.array(*[F.struct(F.lit(f).alias("path"), F.col(f).cast("string").alias(name), F.lit(True).alias(f"_{name}")) for f in fields])
        return df.select(*keys, F.explode(entries).alias("_e")).select(*keys, "_e.*")

    both = flat(current, "now").join(flat(baseline, "was"), [*keys, "path"], "full")
    change = F.when(F.col("_was").isNull(), "added").when(F.col("_now").isNull(), "removed").otherwise("changed")
    return both.where(~F.col("was").eqNullSafe(F.col("now")) | F.col("_was").isNull() | F.col("_now").isNull()).select(*keys, "path", "was", "now", change.alias("change"))


def flattened(df: DataFrame, keys: Sequence[str], document: str) -> DataFrame:
    """(keys, path, kind, value) of every leaf of JSON documents, however deep: its type and its JSON text.

    A null in a document is a leaf of kind VOID, an empty object or array a leaf too; a text that is no JSON is one
    of kind INVALID at the root; a null document has none. Each level of nesting is one step, kept in the shared folder.
    """
    raw = df.where(F.col(document).isNotNull()).select(*keys, F.lit("$").alias("path"), F.try_parse_json(document).alias("v"), F.col(document).alias("_raw"))
    out = raw.where("v is null").select(*keys, "path", F.lit("INVALID").alias("kind"), F.col("_raw").alias("value"))
    level = staged(raw.where("v is not null").drop("_raw"))
    while True:
        told = level.withColumns({"kind": F.regexp_extract(F.schema_of_variant("v"), "^[A-Z]+", 0), "value": F.to_json("v")})
        inner = F.col("kind").isin("OBJECT", "ARRAY") & ~F.col("value").isin("{}", "[]")
        out = out.unionByName(told.where(~inner).drop("v"))
        if not told.where(inner).limit(1).count():
            return out
        named = ", ".join(f"`{k}`" for k in keys)
        step = "CASE WHEN e.key IS NULL THEN concat('[', e.pos, ']') WHEN e.key RLIKE '^[A-Za-z_][A-Za-z0-9_]*$' THEN concat('.', e.key) ELSE concat('[', to_json(named_struct('k', e.key)), ']') END"
        level = staged(df.sparkSession.sql(f"SELECT {named}, concat(path, {step}) AS path, e.value AS v FROM {{level}}, LATERAL variant_explode(v) AS e(pos, key, value)", level=told.where(inner).drop("kind", "value")))


def replayed_documents(current: DataFrame, baseline: DataFrame, keys: Sequence[str], document: str) -> DataFrame:
    """(keys, path, was, now, change) of every leaf that differs between two runs' JSON documents: added, removed, type or changed.

    A leaf that is null is there: turning null is a change of type, and only a leaf that is gone is removed.
    """
    side = lambda df, name: flattened(df, keys, document).select(*keys, "path", F.struct("kind", "value").alias(name))
    both = side(current, "now").join(side(baseline, "was"), [*keys, "path"], "full")
    change = F.when(F.col("was").isNull(), "added").when(F.col("now").isNull(), "removed").when(F.col("was.kind") != F.col("now.kind"), "type").when(F.col("was.value") != F.col("now.value"), "changed")
    return both.select(*keys, "path", F.col("was.value").alias("was"), F.col("now.value").alias("now"), change.alias("change")).where("change is not null")


def conserved(detail: DataFrame, summary: DataFrame, keys: Sequence[str], amount: str, rows: str) -> DataFrame:
    """Whether sums and numbers of detail rows are those that a summary (keys, amount, rows) states, for the keys of both."""
    found = detail.groupBy(*keys).agg(F.sum(F.col(amount).cast(MONEY)).alias("found_amount"), F.count("*").alias("found_rows"))
    stated = summary.select(*keys, F.col(amount).cast("decimal(30,4)").alias("stated_amount"), F.col(rows).alias("stated_rows"))
    both = found.join(stated, list(keys), "full")
    return both.withColumn("ok", F.coalesce((F.col("found_amount") == F.col("stated_amount")) & (F.col("found_rows") == F.col("stated_rows")), F.lit(False)))


def residual(row_total: Column | str, parts: Sequence[Column | str], tolerance: str = "0.01") -> tuple[Column, Column]:
    """(what a reference formula leaves over, whether that is within the tolerance); a missing part leaves nothing to judge."""
    left = (column(row_total).cast(MONEY) - reduce(lambda a, b: a + b, [column(p).cast(MONEY) for p in parts])).cast(MONEY)
    return left, F.abs(left) <= F.lit(tolerance).cast(MONEY)


def number_guard(shown: DataFrame, ledger: DataFrame, ref: str, value: str) -> DataFrame:
    """Shown numbers (ref, value) that the ledger does not hold under that reference with that value to the cent."""
    held = ledger.select(F.col(ref).alias("_ref"), F.round(F.col(value).cast(MONEY), 2).alias("_value")).distinct()
    return shown.join(held, (F.col(ref) == F.col("_ref")) & (F.round(F.col(value).cast(MONEY), 2) == F.col("_value")), "left_anti")


def certified_gates(products: DataFrame, keys: Sequence[str], metrics: Mapping[str, str], profit: str, parts: Sequence[str]) -> DataFrame:
    """Per product the reasons against certification: a metric that is null, and a profit that its parts do not add up to."""
    missing = [F.when(F.col(c).isNull(), F.lit(f"missing_{name}")) for name, c in metrics.items()]
    left, ok = residual(profit, parts)
    reasons = F.array_compact(F.array(*missing, F.when(F.coalesce(~ok, F.lit(False)), F.lit("profit_mismatch"))))
    return products.select(*keys, F.concat_ws(",", reasons).alias("reasons"), (F.size(reasons) == 0).alias("certified"))


def eligibility(runs: DataFrame, gates: DataFrame, run: str) -> DataFrame:
    """(run, eligible, blockers): a closed period, an unpublished contract or rule package, no required gate, and each required gate
    (run, gate_code, required, status) that has not passed."""
    own = gates.where("required").groupBy(F.col(run).alias("_run")).agg(F.array_sort(F.collect_set(F.when(F.col("status") != "passed", F.col("gate_code")))).alias("_failed"))
    told = runs.join(own, F.col(run) == F.col("_run"), "left")
    fixed = [(F.col("period_state") == "closed", "period_closed"), (F.col("contract_status") != "published", "contract_not_published"), (F.col("rules_status") != "published", "rules_not_published"), (F.col("_run").isNull(), "required_gates_missing")]
    blockers = F.concat(F.array_compact(F.array(*[F.when(c, F.lit(code)) for c, code in fixed])), F.coalesce(F.col("_failed"), F.array().cast("array<string>")))
    return told.select(run, (F.size(blockers) == 0).alias("eligible"), F.concat_ws(",", blockers).alias("blockers"))
