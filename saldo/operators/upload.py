"""Uploaded tables: canonical rows, their gates and summaries, and what a run's figures come to."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from decimal import Decimal
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from saldo.functions.money import MONEY, column
from saldo.functions.text import norm_key, parse_number
from saldo.operators.dedupe import fingerprint, first_wins

FINE = "decimal(24,6)"
#: A time of day with the zone that stands behind it.
ZONED = r"(?s)^.*\d:\d{2}.*?(Z|z|[+-]\d{2}:?\d{2})$"


def utc(c: Column | str, zone: str) -> Column:
    """The UTC time, without a zone, of a text: by its own offset, or else as a time of the given zone, whatever the session's is."""
    text = F.trim(column(c).cast("string"))
    offset = F.regexp_extract(text, ZONED, 1)
    local = F.translate(F.substring(text, F.lit(1), F.length(text) - F.length(offset)), "/", "-").try_cast("timestamp_ntz")
    digits = F.translate(offset, "+-:", "")
    minutes = (F.substring(digits, 1, 2).try_cast("int") * 60 + F.substring(digits, 3, 2).try_cast("int")) * F.when(offset.startswith("-"), -1).otherwise(1)
    shifted = local - F.make_dt_interval(mins=F.coalesce(minutes, F.lit(0)))
    return F.when(offset != "", shifted).otherwise(F.convert_timezone(F.lit(zone), F.lit("UTC"), local))


def canonical(df: DataFrame, key: str, at: str, amounts: Mapping[str, str], dedupe: Sequence[str], order: Sequence[str], zone: str = "UTC", defaults: Mapping[str, object] | None = None) -> DataFrame:
    """Rows as an upload keeps them; of equal values of `dedupe` the first in order stays, and `row_hash` is their digest.

    business_key is the normalised key, occurred_at the UTC time. Amounts have six decimals and the
    sign that they came with; those declared "negative" are turned over, the others are "as_is". A column that is
    not there is 0, as is an empty or unreadable cell; `unread` counts the cells that are filled and cannot be read.
    """
    unknown = {c: how for c, how in amounts.items() if how not in ("as_is", "negative")}
    if unknown:
        raise ValueError(f"no directions: {unknown}")
    blank = lambda c: F.coalesce(F.trim(F.col(c).cast("string")), F.lit("")) == ""
    read = {c: parse_number(F.col(c).cast("string")) for c in amounts if c in df.columns}
    value = lambda c: F.coalesce(read[c], F.lit(0)) if c in read else F.lit(0)
    unread = [F.when(v.isNull() & ~blank(c), 1).otherwise(0) for c, v in read.items()]
    told = df.withColumns({
        "business_key": norm_key(key),
        "occurred_at": utc(at, zone),
        **{c: (-value(c) if how == "negative" else value(c)).cast(FINE) for c, how in amounts.items()},
        **{c: F.when(blank(c), F.lit(v)).otherwise(F.trim(F.col(c).cast("string"))) for c, v in (defaults or {}).items()},
        "unread": reduce(lambda a, b: a + b, unread, F.lit(0)),
    })
    return first_wins(told.withColumn("row_hash", fingerprint(dedupe)), ["row_hash"], order)


def upload_gates(df: DataFrame, key: str, at: str, amount: str, scope: Sequence[str], known: DataFrame | None = None) -> DataFrame:
    """(gate, value, passed) of an upload in one pass: it has rows, times and amounts can be read, scope is filled, keys are there and
    not repeated, amounts are neither all of one sign nor all zero; and, with known keys, how many of the keys have a partner."""
    n = F.count("*")
    scoped = reduce(lambda a, b: a & b, [F.col(c).isNotNull() for c in scope], F.lit(True))
    checks = [
        ("row_count", n.cast("double"), n > 0),
        ("valid_time", F.try_divide(F.count(at), n), F.count(at) == n),
        ("amount_format", F.try_divide(F.count(amount), n), F.count(amount) == n),
        ("scope", F.try_divide(F.count_if(scoped), n), F.count_if(scoped) == n),
        ("key_present", F.try_divide(F.count(key), n), F.count(key) == n),
        ("duplicate_keys", (F.count(key) - F.count_distinct(key)).cast("double"), F.count(key) == F.count_distinct(key)),
        ("amount_signs", F.count_distinct(F.signum(amount)).cast("double"), F.coalesce(F.max(F.abs(amount)) > 0, F.lit(False))),
    ]
    told = df.agg(F.array(*[F.struct(F.lit(g).alias("gate"), F.round(v, 6).alias("value"), F.coalesce(p, F.lit(False)).alias("passed")) for g, v, p in checks]).alias("_g")).select(F.explode("_g").alias("_g")).select("_g.*")
    if known is None:
        return told
    lost = df.where(F.col(key).isNotNull()).select(F.col(key).alias("_key")).distinct().join(known.select(norm_key(key).alias("_key")).distinct(), "_key", "left_anti")
    return told.union(lost.agg(F.lit("cross_source").alias("gate"), F.count("*").cast("double").alias("value"), (F.count("*") == 0).alias("passed")))


def declared_gates(df: DataFrame, rules: Sequence[Mapping], keys: Sequence[str] = ()) -> DataFrame:
    """(keys, rule, gate, status, value, least, most) of each group and each declared rule, all in one aggregate.

    A rule is {type, ...}: required_field and non_negative (field; value: the rows that break it), unique (fields; value:
    the rows beyond the first of their values, a null being a value), row_count and order_count (min, max; field: the orders'
    key), expected_volume (expected, tolerance: a share, 0.20), control_total (field, expected, tolerance: 0.01). Status is passed or
    failed, or not_applicable for a rule on amounts whose field the table has not and for a volume or total without an
    expected one; a required field that the table has not is failed. A group without rows has no row; an empty table
    without keys has one for each rule.
    """
    out, n = [], F.count("*")
    zero = F.lit(0).cast("decimal(30,4)")
    for i, r in enumerate(rules):
        kind, name = r["type"], r.get("field")
        there = name in df.columns
        least = most = value = None
        if kind == "required_field":
            value, most = n - F.count(name) if there else n, 0
        elif kind == "non_negative" and there:
            value, most = F.count_if(F.col(name) < 0), 0
        elif kind == "unique":
            value, most = n - F.count_distinct(F.struct(*[F.col(c) for c in r["fields"]])), 0
        elif kind in ("row_count", "order_count"):
            value, least, most = n if kind == "row_count" else F.count_distinct(name), r.get("min", 0), r.get("max")
        elif kind == "expected_volume" and r.get("expected"):
            share = Decimal(str(r.get("tolerance", "0.20")))
            value, least, most = n, int(r["expected"] * (1 - share)), int(r["expected"] * (1 + share))
        elif kind == "control_total" and there and r.get("expected") is not None:
            expected, off = Decimal(str(r["expected"])), Decimal(str(r.get("tolerance", "0.01")))
            value, least, most = F.coalesce(F.sum(F.col(name)), zero), expected - off, expected + off
        elif kind not in ("non_negative", "expected_volume", "control_total"):
            raise ValueError(f"no rule {kind}")
        amount = lambda x: (F.lit(None) if x is None else F.lit(str(x)) if not isinstance(x, Column) else x).cast("decimal(30,4)")
        low, high, told = amount(least), amount(most), amount(value)
        passed = F.coalesce(told >= low, F.lit(True)) & F.coalesce(told <= high, F.lit(True))
        if kind == "required_field" and not there:
            passed = F.lit(False)
        status = F.when(passed, "passed").otherwise("failed") if value is not None else F.lit("not_applicable")
        gate = f"{kind}:{name}" if name and kind != "order_count" else f"{kind}:{','.join(r['fields'])}" if kind == "unique" else kind
        out.append(F.struct(F.lit(i).alias("rule"), F.lit(gate).alias("gate"), status.alias("status"), told.alias("value"), low.alias("least"), high.alias("most")))
    return df.groupBy(*keys).agg(F.array(*out).alias("_g")).select(*keys, F.explode("_g").alias("_g")).select(*keys, "_g.*")


def upload_summary(df: DataFrame, keys: Sequence[str], key: str, at: str, amount: str) -> DataFrame:
    """Per group rows, distinct keys, first and last time, and incoming, outgoing and net money."""
    value = F.col(amount)
    part = lambda test: F.coalesce(F.sum(F.when(test, value)), F.lit(0))
    return df.groupBy(*keys).agg(F.count("*").alias("rows"), F.count_distinct(key).alias("keys"), F.min(at).alias("first_at"), F.max(at).alias("last_at"), part(value > 0).alias("incoming"), part(value < 0).alias("outgoing"), F.coalesce(F.sum(value), F.lit(0)).alias("net"))


def amounts(df: DataFrame, keys: Sequence[str], columns: Sequence[str], order: str) -> DataFrame:
    """The registry of sums: one for each column, null as zero, and the number of distinct orders."""
    return df.groupBy(*keys).agg(*[F.coalesce(F.sum(F.col(c).cast(MONEY)), F.lit(0)).alias(c) for c in columns], F.count_distinct(order).alias("orders"))


def recomputed(df: DataFrame, key: str, amount: str) -> DataFrame:
    """Figures of an edge worked out anew from its text: rows, rows without a key, keys, the sum over one row per key and repeats."""
    told = df.select(norm_key(key).alias("_key"), parse_number(F.col(amount).cast("string")).alias("_v"))
    once = told.where("_key is not null").groupBy("_key").agg(F.min("_v").alias("_v"), F.count("*").alias("_n"))
    kept = once.agg(F.count("*").alias("keys"), F.coalesce(F.sum("_v"), F.lit(0)).alias("amount"), F.coalesce(F.sum(F.col("_n") - 1), F.lit(0)).alias("repeats"))
    return told.agg(F.count("*").alias("rows"), F.count_if(F.col("_key").isNull()).alias("blank_keys")).crossJoin(kept)  # one row each


def own_store(df: DataFrame, aliases: DataFrame, store: str) -> DataFrame:
    """The rows under their stores' own names; aliases (alias, store) are a dimension with a row for each alias."""
    known = first_wins(aliases, ["alias"], ["store"]).select(F.col("alias").alias("_alias"), F.col("store").alias("_own"))
    return df.join(known, F.trim(F.col(store)) == F.col("_alias"), "left").withColumn(store, F.coalesce("_own", F.trim(F.col(store)))).drop("_alias", "_own")


def platform_of(name: Column | str, store_id: Column | str, rules: Sequence[tuple[str, str, str]], otherwise: str = "unknown") -> Column:
    """The platform by how a store's name, or else its id, begins or ends: rules (starts or ends, text, platform) in their order."""
    text = F.coalesce(F.nullif(F.trim(column(name)), F.lit("")), column(store_id))
    out = F
    for how, mark, platform in rules:
        out = out.when(text.startswith(mark) if how == "starts" else text.endswith(mark), platform)
    return out.otherwise(otherwise)


def with_latest_profile(snapshots: DataFrame, profiles: DataFrame, key: str, at: str) -> DataFrame:
    """Snapshots, each with its latest profile if it has any."""
    newest = profiles.groupBy(F.col(key).alias("_key")).agg(F.max_by(F.struct("*"), F.struct(at)).alias("profile"))
    return snapshots.join(newest, F.col(key) == F.col("_key"), "left").drop("_key")


def evidence_of(reviews: DataFrame, bindings: DataFrame, records: DataFrame, review: str, record: str) -> DataFrame:
    """(review, ordinal, record...) of all records that are bound to reviews, in the order in which they were bound."""
    return reviews.select(review).join(bindings.select(review, record, "ordinal"), review).join(records, record)


def home_figures(facts: DataFrame, store: str, period: str, amount: str, complete: str) -> DataFrame:
    """Per month the stores, those that are complete, and the money of the complete ones only: an incomplete store is left out, not zero."""
    by_store = facts.groupBy(period, store).agg(F.bool_and(complete).alias("_ok"), F.sum(F.col(amount).cast(MONEY)).alias("_sum"))
    return by_store.groupBy(period).agg(F.count("*").alias("stores"), F.count_if("_ok").alias("complete_stores"), F.sum(F.when(F.col("_ok"), F.col("_sum"))).alias("amount"))


def run_summary(outcomes: DataFrame, run: str, status: str, exposure: str) -> DataFrame:
    """A run's shadow: keys by status, unresolved money, and the digest of all outcomes, which is equal for equal runs."""
    return outcomes.groupBy(run).agg(
        F.count("*").alias("keys"), F.count_if(F.col(status) == "resolved").alias("resolved"), F.count_if(F.col(status) == "unresolved").alias("unresolved"), F.coalesce(F.sum(F.when(F.col(status) == "unresolved", F.col(exposure).cast(MONEY))), F.lit(0)).alias("exposure"), F.bit_xor(F.xxhash64(*[c for c in outcomes.columns if c != run])).alias("digest")
    )


def rederived(summary: DataFrame, breakdown: DataFrame, keys: Sequence[str], sums: Sequence[str]) -> DataFrame:
    """(keys, column, stated, derived) of a report's sums that its own breakdown does not add up to."""
    derived = breakdown.groupBy(*keys).agg(*[F.sum(F.col(c).cast(MONEY)).alias(f"_{c}") for c in sums])
    both = summary.join(derived, list(keys), "left")
    each = F.explode(F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).cast("decimal(30,4)").alias("stated"), F.coalesce(f"_{c}", F.lit(0)).cast("decimal(30,4)").alias("derived")) for c in sums]))
    return both.select(*keys, each.alias("_e")).select(*keys, "_e.*").where("stated <> derived")
