"""Read models over runs: which run counts, what is in scope, what is still to be decided, and what a publication replaces."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from saldo.functions.money import MONEY, ratio
from saldo.operators.dedupe import latest


def latest_runs(runs: DataFrame, job: Sequence[str], finished: str, run: str) -> DataFrame:
    """Of every job the run that finished last; unfinished ones come behind all others, ties go to the greater run."""
    return latest(runs, job, [finished, run])


def facts_of_latest(facts: DataFrame, runs: DataFrame, job: Sequence[str], finished: str, run: str) -> DataFrame:
    """Facts of runs that count; those of stale runs are left out."""
    return facts.join(latest_runs(runs, job, finished, run).select(F.col(run).alias("_run")), F.col(run) == F.col("_run"), "left_semi")


def stale_runs(runs: DataFrame, job: Sequence[str], finished: str, run: str) -> DataFrame:
    """Runs that a later one has replaced; a run without an id is not among them."""
    named = runs.where(F.col(run).isNotNull())
    return named.join(latest_runs(named, job, finished, run).select(F.col(run).alias("_run")), F.col(run) == F.col("_run"), "left_anti")


def selected(df: DataFrame, scope: Mapping[str, object]) -> DataFrame:
    """Rows in scope: a list is any of its values, a pair of bounds (from, to) is both included, None is no restriction."""
    tests = []
    for name, wanted in scope.items():
        if isinstance(wanted, tuple):
            tests += [F.col(name) >= wanted[0]] if wanted[0] is not None else []
            tests += [F.col(name) <= wanted[1]] if wanted[1] is not None else []
        elif wanted is not None:
            tests.append(F.col(name).isin(*wanted))
    return df.where(reduce(lambda a, b: a & b, tests, F.lit(True)))


def undecided(reviews: DataFrame, decisions: DataFrame, key: str) -> DataFrame:
    """Reviews for which there is no decision."""
    return reviews.join(decisions.select(F.col(key).alias("_key")), F.col(key) == F.col("_key"), "left_anti")


def empty_items(json: str, path: str = "$.items") -> Column:
    """Whether a JSON value's count of items is zero, missing or no number."""
    return F.coalesce(F.get_json_object(json, path).try_cast("int"), F.lit(0)) == 0


def requirements(checklist: DataFrame, periods: DataFrame, since: str, until: str, start: str, end: str, keys: Sequence[str]) -> DataFrame:
    """Checklist entries that hold at some time of a period; an open end holds for good.

    Both sides are spread over their months and meet by month; a pair is kept in the first month that they share,
    so it comes once. An open end reaches to the last period's end, the one value that comes to the driver.
    """
    last = periods.agg(F.max(end)).first()[0]
    months = lambda low, high: F.explode(F.sequence(F.trunc(low, "month"), F.trunc(high, "month"), F.expr("interval 1 month")))
    wanted = checklist.withColumn("_until", F.coalesce(until, F.lit(last))).where(F.col(since) <= F.col("_until"))
    wanted = wanted.withColumn("_month", months(since, "_until")).withColumnsRenamed({k: f"_{k}" for k in keys})
    spread = periods.where(F.col(start) <= F.col(end)).withColumn("_m", months(start, end))
    overlap = (F.col(since) <= F.col(end)) & (F.col("_until") >= F.col(start)) & (F.col("_m") == F.trunc(F.greatest(since, start), "month"))
    met = spread.join(wanted, [F.col("_m") == F.col("_month"), *[F.col(k) == F.col(f"_{k}") for k in keys]])
    return met.where(overlap).drop("_m", "_month", "_until", *[f"_{k}" for k in keys])


def coverage(slices: DataFrame, keys: Sequence[str], needed: str, done: str, unresolved: str) -> DataFrame:
    """Per slice how many of the needed jobs are done, and whether it is certifiable, partial or missing."""
    told = slices.groupBy(*keys).agg(F.count_if(needed).alias("needed"), F.count_if(F.col(needed) & F.col(done)).alias("done"), F.sum(unresolved).alias("unresolved"))
    status = F.when(F.col("done") == 0, "missing").when((F.col("done") < F.col("needed")) | (F.col("unresolved") > 0), "partial").otherwise("certifiable")
    return told.withColumn("status", status)


def json_totals(runs: DataFrame, keys: Sequence[str], json: str) -> DataFrame:
    """(keys, metric, amount) from totals that runs keep as a JSON object; values that are no numbers are left out."""
    each = runs.select(*keys, F.explode(F.from_json(json, "map<string, string>")).alias("metric", "_value"))
    return each.select(*keys, "metric", F.col("_value").try_cast(MONEY).alias("_amount")).where("_amount is not null").groupBy(*keys, "metric").agg(F.sum("_amount").alias("amount"))


def catalogue(df: DataFrame, platform: str, store: str, day: str) -> DataFrame:
    """What can be chosen: every platform and store with its months and first and last day."""
    return df.groupBy(platform, store).agg(F.count_distinct(F.date_format(day, "yyyy-MM")).alias("periods"), F.min(F.to_date(day)).alias("first_day"), F.max(F.to_date(day)).alias("last_day"))


def working_period(cells: DataFrame, period: str, store: str) -> DataFrame:
    """The month to show first: of those written as months the one with most stores, the latest of several; others only if there is none."""
    counted = cells.groupBy(period).agg(F.count_distinct(store).alias("stores"))
    return counted.agg(F.max_by(period, F.struct(F.col(period).rlike(r"^\d{4}-\d{2}$"), "stores", period)).alias(period))


def trend(cells: DataFrame, nodes: Sequence[str], ratios: Mapping[str, tuple[str, str]], period: str) -> DataFrame:
    """(period, node, value, stores) of cells, one for each store and month: a node's months over all stores that have it. A missing value is not zero; a ratio is worked out
    from its summed parts over stores that have both, never summed."""
    parts = {f"{r}_{side}": F.when(F.col(top).isNotNull() & F.col(bottom).isNotNull(), F.col(c)) for r, (top, bottom) in ratios.items() for side, c in (("top", top), ("bottom", bottom))}
    sums = {n: F.col(n) for n in nodes} | parts
    told = cells.groupBy(period).agg(*[F.sum(c.cast(MONEY)).alias(f"{n}_v") for n, c in sums.items()], *[F.count(c).alias(f"{n}_n") for n, c in sums.items()])
    plain = [F.struct(F.lit(n).alias("node"), F.col(f"{n}_v").cast("decimal(30,4)").alias("value"), F.col(f"{n}_n").alias("stores")) for n in nodes]
    made = [F.struct(F.lit(r).alias("node"), ratio(f"{r}_top_v", f"{r}_bottom_v").cast("decimal(30,4)").alias("value"), F.col(f"{r}_top_n").alias("stores")) for r in ratios]
    return told.select(period, F.explode(F.array(*plain, *made)).alias("_e")).select(period, "_e.*")


def consensus(votes: DataFrame, subject: str, suggestion: Sequence[str], action: str, valid: str) -> DataFrame:
    """(subject, outcome, action): the suggestion of most valid votes if at least two agree, the first in order of several."""
    counted = votes.where(valid).groupBy(subject, *suggestion, action).agg(F.count("*").alias("_n"))
    order = F.struct((-F.col("_n")).alias("n"), *suggestion, action)
    best = counted.groupBy(subject).agg(F.min_by(F.struct("_n", action), order).alias("_best"))
    agreed = F.col("_best._n") >= 2
    every = votes.select(subject).distinct().join(best, subject, "left")
    return every.select(subject, F.when(agreed, "agreement").otherwise("disagreement").alias("outcome"), F.when(agreed, F.col(f"_best.{action}")).alias("action"))


def votes_by_group(cases: DataFrame, keys: Sequence[str], accepted: str, corrected: str) -> DataFrame:
    """Of each group of suggestions: cases, accepted and corrected ones, and the share of accepted among those decided."""
    told = cases.groupBy(*keys).agg(F.count("*").alias("cases"), F.count_if(accepted).alias("accepted"), F.count_if(corrected).alias("corrected"))
    return told.withColumn("accuracy", F.round(F.try_divide(F.col("accepted"), F.col("accepted") + F.col("corrected")), 6))


def occurrences(known: DataFrame, seen: DataFrame, print_: str, at: str, amount: str) -> DataFrame:
    """Known fingerprints (print, occurrences, first_seen, last_seen, exposure) with those seen now: counts add up, dates widen."""
    new = seen.groupBy(print_).agg(F.count("*").alias("occurrences"), F.min(at).alias("first_seen"), F.max(at).alias("last_seen"), F.sum(F.abs(F.col(amount).cast(MONEY))).alias("exposure"))
    both = known.select(*new.columns).unionByName(new)
    return both.groupBy(print_).agg(F.sum("occurrences").alias("occurrences"), F.min("first_seen").alias("first_seen"), F.max("last_seen").alias("last_seen"), F.sum("exposure").alias("exposure"))


def claim_stats(claims: DataFrame, keys: Sequence[str], status: str, amount: str, recovered: str) -> DataFrame:
    """Claims by group: how many, filed, accepted, money claimed and recovered, and both rates."""
    of = lambda *s: F.col(status).isin(*s)
    told = claims.groupBy(*keys).agg(
        F.count("*").alias("claims"), F.count_if(of("filed", "accepted", "rejected")).alias("filed"), F.count_if(of("accepted")).alias("accepted"), F.coalesce(F.sum(F.when(of("filed", "accepted", "rejected"), F.col(amount).cast(MONEY))), F.lit(0)).alias("claimed"), F.coalesce(F.sum(F.col(recovered).cast(MONEY)), F.lit(0)).alias("recovered")
    )
    rates = {"acceptance": F.round(F.try_divide("accepted", "filed"), 6), "recovery": F.round(F.try_divide(F.col("recovered").cast("double"), F.col("claimed").cast("double")), 6)}
    return told.withColumns(rates)


def claims_found(unresolved: DataFrame, balances: DataFrame, contracts: DataFrame, key: str, contract: str, least: str, violated: Sequence[tuple[str, Column]]) -> DataFrame:
    """Unresolved keys with a balance of at least `least` and a contract, each with the first invariant that it violates, the largest first."""
    found = unresolved.join(balances, key).join(contracts, contract).where(F.abs(F.col("balance").cast(MONEY)) >= F.lit(least).cast(MONEY))
    why = F.coalesce(*[F.when(test, F.lit(name)) for name, test in violated])
    told = found.withColumn("violates", why).where("violates is not null")
    return told.withColumn("rank", F.row_number().over(Window.partitionBy(contract).orderBy(F.abs("balance").desc(), key)))


def resolved_sku(rows: DataFrame, keys: Sequence[str], orders: DataFrame, row: str, explicit: str) -> DataFrame:
    """Each row's product: the only one that its order keys lead to in orders (order_key, sku); else the one it names itself if orders know it."""
    named = orders.select(F.lower(F.trim("order_key")).alias("_key"), F.trim("sku").alias("_sku")).where("_key <> '' and _sku <> ''").distinct()
    each = rows.select(row, F.explode(F.array_distinct(F.array(*[F.lower(F.trim(F.col(k).cast("string"))) for k in keys]))).alias("_key")).where("_key <> ''")
    found = each.join(named, "_key").groupBy(row).agg(F.min("_sku").alias("_low"), F.max("_sku").alias("_high"))
    known = named.select(F.col("_sku").alias("_own")).distinct()
    told = rows.join(found, row, "left").join(known, F.trim(F.col(explicit)) == F.col("_own"), "left")
    return told.select(*rows.columns, F.when(F.col("_low") == F.col("_high"), F.col("_low")).otherwise(F.col("_own")).alias("resolved_sku"))


def published(ledger: DataFrame, batch: DataFrame, keys: Sequence[str], mode: str, period: str) -> DataFrame:
    """A ledger after a publication: `incremental` appends rows whose keys it lacks, `snapshot` replaces the months that the batch has."""
    if mode == "snapshot":
        months = batch.select(F.col(period).alias("_period")).distinct()
        return ledger.join(months, F.col(period).eqNullSafe(F.col("_period")), "left_anti").unionByName(batch)
    have = ledger.select(*[F.col(k).alias(f"_{k}") for k in keys]).distinct()
    return ledger.unionByName(batch.join(have, [F.col(k).eqNullSafe(F.col(f"_{k}")) for k in keys], "left_anti"))


def candidate(rows: DataFrame, keys: Sequence[str], digest: str, evidence: Mapping[str, Column], order: Sequence[str]) -> DataFrame:
    """Of several candidates for one key the chosen one and why: all of one digest (identical: the first), else the only one for which
    a test of the evidence holds, the tests in turn; else none (ambiguous)."""
    first = F.struct(*order)
    told = rows.groupBy(*keys).agg(F.count_distinct(digest).alias("_digests"), F.min(first).alias("_first"), *[F.count_if(test).alias(f"_n{i}") for i, test in enumerate(evidence.values())], *[F.min_by(first, F.struct((~F.coalesce(test, F.lit(False))).alias("t"), *order)).alias(f"_c{i}") for i, test in enumerate(evidence.values())])
    reason = F.when(F.col("_digests") == 1, "identical")
    chosen = F.when(F.col("_digests") == 1, F.col("_first"))
    for i, name in enumerate(evidence):
        reason, chosen = reason.when(F.col(f"_n{i}") == 1, name), chosen.when(F.col(f"_n{i}") == 1, F.col(f"_c{i}"))
    return told.select(*keys, reason.otherwise("ambiguous").alias("reason"), chosen.alias("_row")).select(*keys, "reason", *[F.col(f"_row.{c}").alias(c) for c in order])


def one_sided_basis(rows: DataFrame, keys: Sequence[str], side: str, amount: str) -> DataFrame:
    """How much money a key is about: the greater of its sides' sums of absolute amounts."""
    sides = rows.groupBy(*keys, side).agg(F.sum(F.abs(F.col(amount).cast(MONEY))).alias("_sum"))
    return sides.groupBy(*keys).agg(F.max("_sum").alias("basis"))


def control_differences(rows: DataFrame, keys: Sequence[str], kind: str, amount: str) -> DataFrame:
    """Detail less control of every source; null where a source has only one of them."""
    of = lambda k: F.sum(F.when(F.col(kind) == k, F.col(amount).cast(MONEY)))
    told = rows.groupBy(*keys).agg(of("detail").alias("detail"), of("control").alias("control"))
    return told.withColumn("difference", F.col("detail") - F.col("control"))


def import_status(imports: DataFrame, kind: str, status: str, rows: str, issues: str) -> DataFrame:
    """(kind, status, snapshots, row_count, issue_count) of imports; what is not stated counts as none."""
    stated = lambda c: F.coalesce(F.sum(F.col(c).cast("long")), F.lit(0))
    return imports.groupBy(kind, status).agg(F.count("*").alias("snapshots"), stated(rows).alias("row_count"), stated(issues).alias("issue_count"))


def scopes_certified(scopes: DataFrame, scope: Sequence[str], order: Sequence[str], results: DataFrame, key: str, by: Sequence[str]) -> DataFrame:
    """(by, expected, certified): of each scope the latest entry is expected, and certified if a complete result has its key."""
    done = results.select(F.col(key).alias("_done")).distinct()
    told = latest(scopes, scope, order).join(done, F.col(key) == F.col("_done"), "left")
    return told.groupBy(*by).agg(F.count("*").alias("expected"), F.count("_done").alias("certified"))


def found_across(rows: DataFrame, test: Column, slices: Sequence[str], order: Sequence[Column], most: int) -> DataFrame:
    """The first `most` hits of every slice, each with the number of all hits there: the list ends, the count does not."""
    hit = rows.where(test)
    counts = hit.groupBy(*slices).agg(F.count("*").alias("hits"))
    first = hit.withColumn("_at", F.row_number().over(Window.partitionBy(*slices).orderBy(*order))).where(F.col("_at") <= most).drop("_at")
    return first.join(counts, list(slices))
