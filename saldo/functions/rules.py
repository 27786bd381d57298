"""Ordered rules, the first that matches wins, as Columns.

A chain is compiled to the index of its winner and then to outcomes by that index,
so a rule that matches with an empty outcome still ends the chain.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from saldo.functions.money import column
from saldo.functions.predicates import predicate
from saldo.functions.text import first_group, fold_header
from saldo.operators.dedupe import first_wins

NONE = -1


def matcher(c: Column | str, how: str, value: object = None) -> Column:
    """Whether a text equals one of, contains any of, starts with, or matches the value; blank text matches nothing."""
    text = column(c).cast("string")
    values = [value] if isinstance(value, str) else list(value or [])
    tests = {
        "equals": lambda: text.isin(*values),
        "folded": lambda: fold_header(text).isin(*values),
        "starts": lambda: reduce(or_, [text.startswith(v) for v in values], F.lit(False)),
        "contains": lambda: reduce(or_, [text.contains(v) for v in values], F.lit(False)),
        "regex": lambda: reduce(or_, [text.rlike(v) for v in values], F.lit(False)),
        "notnull": lambda: F.trim(text) != "",
        "always": lambda: F.lit(True),
    }
    return F.coalesce(tests[how](), F.lit(False))


def winner(masks: Sequence[Column]) -> Column:
    """Index of the first true mask, or -1."""
    return F.coalesce(*[F.when(m, F.lit(i)) for i, m in enumerate(masks)], F.lit(NONE))


def outcome(index: Column | str, values: Sequence[Column | str | None], otherwise: Column | str | None = None) -> Column:
    """The value of the winner; texts stand for themselves."""
    lifted = [v if isinstance(v, Column) else F.lit(v) for v in (*values, otherwise)]
    out = F
    for i, v in enumerate(lifted[:-1]):
        out = out.when(column(index) == i, v)
    return out.otherwise(lifted[-1]) if len(lifted) > 1 else lifted[-1]


def classify(df: DataFrame, rules: Sequence[Mapping], outputs: Sequence[str], index: str = "winner", otherwise: str | None = None) -> DataFrame:
    """The rows with the winner's index and its outputs; a rule is {column, how, value} or {when: predicate}, and the outputs."""
    masks = [predicate(r["when"]) if "when" in r else matcher(r["column"], r["how"], r.get("value")) for r in rules]
    told = df.withColumn(index, winner(masks))
    return told.withColumns({name: outcome(index, [r.get(name) for r in rules], otherwise) for name in outputs})


def looked_up(df: DataFrame, dictionary: DataFrame, label: str, platform: str, outputs: Sequence[str]) -> DataFrame:
    """Outputs from a dictionary (platform, raw, ...), where a row of the platform goes before one of platform *.

    The dictionary is reduced to its least row per platform and label, so the join never adds rows.
    """
    rows = dictionary.select("platform", "raw", *outputs)
    named = first_wins(rows.where("platform <> '*'"), ["platform", "raw"], outputs).select(F.col("platform").alias("_p"), F.col("raw").alias("_r"), *[F.col(o).alias(f"_own_{o}") for o in outputs], F.lit(True).alias("_own"))
    common = first_wins(rows.where("platform = '*'"), ["raw"], outputs).select(F.col("raw").alias("_c"), *[F.col(o).alias(f"_any_{o}") for o in outputs])
    joined = df.join(named, (F.col(platform) == F.col("_p")) & (F.col(label) == F.col("_r")), "left").join(common, F.col(label) == F.col("_c"), "left")
    chosen = {o: F.when(F.col("_own"), F.col(f"_own_{o}")).otherwise(F.col(f"_any_{o}")) for o in outputs}
    return joined.select(*[c for c in df.columns if c not in outputs], *[v.alias(o) for o, v in chosen.items()])


def key_chain(rules: Sequence[Mapping]) -> tuple[Column, Column]:
    """(index of the winner, key) of a chain of {column, pattern, group} rules; {exclude: true} ends the chain without a key."""
    masks, keys = [], []
    for r in rules:
        text = column(r["column"]).cast("string")
        masks.append(F.coalesce(text.rlike(r["pattern"]) if r.get("pattern") else F.trim(text) != "", F.lit(False)))
        keys.append(F.lit(None).cast("string") if r.get("exclude") else first_group(text, r["pattern"], r.get("group", 1)) if r.get("pattern") else F.trim(text))
    index = winner(masks)
    return index, outcome(index, keys)


def rewritten(c: Column | str, steps: Sequence[tuple[Column, str]]) -> Column:
    """A label after each of the steps (condition, new label) in turn: a later step that applies overrides."""
    out = column(c)
    for condition, label in steps:
        out = F.when(F.coalesce(condition, F.lit(False)), F.lit(label)).otherwise(out)
    return out


def only_key(c: Column | str, pattern: str, group: int = 1) -> tuple[Column, Column]:
    """(key, status) of a text: the one distinct match, or none with the status ambiguous or missing."""
    found = F.array_distinct(F.filter(F.regexp_extract_all(column(c), F.lit(pattern), group), lambda x: x != ""))
    count = F.coalesce(F.size(found), F.lit(0))
    return F.when(count == 1, F.get(found, 0)), F.when(count == 1, "found").when(count > 1, "ambiguous").otherwise("missing")
