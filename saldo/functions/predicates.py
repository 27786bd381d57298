"""Declared predicates as Columns: flat conditions with a null policy, and a closed nested language.

A condition that is null is false, unless it says include_null. Nothing here sees
a row: a declaration becomes one expression that Catalyst can push to a scan.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from functools import reduce
from operator import and_, or_

from pyspark.sql import Column
from pyspark.sql import functions as F

from saldo.functions.money import WIDE
from saldo.functions.text import shape_pattern

MOST_DEPTH, MOST_LEAVES = 3, 32


def _text(name: str) -> Column:
    return F.col(name).cast("string")


CONDITIONS: dict[str, Callable[[str, object], Column]] = {
    "eq": lambda c, v: _text(c) == str(v),
    "ne": lambda c, v: _text(c) != str(v),
    "in": lambda c, v: _text(c).isin(*map(str, v)),
    "not_in": lambda c, v: ~_text(c).isin(*map(str, v)),
    "contains": lambda c, v: _text(c).contains(str(v)),
    "not_contains": lambda c, v: ~_text(c).contains(str(v)),
    "gt": lambda c, v: F.col(c).try_cast("double") > float(v),
    "lt": lambda c, v: F.col(c).try_cast("double") < float(v),
    "notnull": lambda c, _: F.trim(_text(c)) != "",
}


def where(conditions: Sequence[Mapping]) -> Column:
    """All of the conditions {column, op, value, include_null}; an empty list is true."""
    leaves = [F.coalesce(CONDITIONS[c["op"]](c["column"], c.get("value")), F.lit(bool(c.get("include_null")))) for c in conditions]
    return reduce(and_, leaves, F.lit(True))


def field(name: str) -> Column:
    """A column, or with a prefix attributes. a member of the JSON column attributes_json."""
    if name.startswith("attributes."):
        return F.get_json_object("attributes_json", "$." + name.removeprefix("attributes."))
    return F.col(name)


def _amount(name: str) -> Column:
    return field(name).try_cast(WIDE)


LEAVES: dict[str, Callable[[str, object], Column]] = {
    "eq": lambda c, v: field(c).cast("string").eqNullSafe(F.lit(None if v is None else str(v))),
    "ne": lambda c, v: ~field(c).cast("string").eqNullSafe(F.lit(None if v is None else str(v))),
    "in": lambda c, v: field(c).cast("string").isin(*map(str, v)),
    "not_in": lambda c, v: ~F.coalesce(field(c).cast("string").isin(*map(str, v)), F.lit(False)),
    "prefix": lambda c, v: field(c).cast("string").startswith(v),
    "suffix": lambda c, v: field(c).cast("string").endswith(v),
    "contains": lambda c, v: field(c).cast("string").contains(v),
    "range": lambda c, v: _amount(c).between(F.lit(str(v[0])).cast(WIDE), F.lit(str(v[1])).cast(WIDE)),
    "sign": lambda c, v: F.signum(_amount(c)) == {"positive": 1, "negative": -1, "zero": 0}[v],
    "is_null": lambda c, _: field(c).isNull(),
    "not_null": lambda c, _: field(c).isNotNull(),
    "matches_shape": lambda c, v: field(c).cast("string").rlike(shape_pattern(v)),
}
COMBINED = {"all_of": lambda p: reduce(and_, p, F.lit(True)), "any_of": lambda p: reduce(or_, p, F.lit(False)), "none_of": lambda p: ~reduce(or_, p, F.lit(False))}


class PredicateError(ValueError):
    """A declaration outside the closed language."""


def checked(spec: Mapping, columns: set[str] | None = None, depth: int = 1) -> int:
    """The number of leaves, if the declaration is well formed, shallow and small enough, and names known columns only."""
    if len(spec) == 1 and next(iter(spec)) in COMBINED:
        parts = next(iter(spec.values()))
        if depth > MOST_DEPTH or not isinstance(parts, Sequence) or isinstance(parts, str) or not parts:
            raise PredicateError(f"too deep or empty: {spec}")
        leaves = sum(checked(p, columns, depth + 1) for p in parts)
        if leaves > MOST_LEAVES:
            raise PredicateError(f"{leaves} leaves; {MOST_LEAVES} at most")
        return leaves
    if set(spec) - {"field", "op", "value"} or spec.get("op") not in LEAVES or not isinstance(spec.get("field"), str):
        raise PredicateError(f"not a leaf: {spec}")
    if columns is not None and spec["field"] not in columns and not spec["field"].startswith("attributes."):
        raise PredicateError(f"unknown field {spec['field']}")
    return 1


def _compiled(spec: Mapping) -> Column:
    if len(spec) == 1 and next(iter(spec)) in COMBINED:
        kind, parts = next(iter(spec.items()))
        return COMBINED[kind]([_compiled(p) for p in parts])
    return F.coalesce(LEAVES[spec["op"]](spec["field"], spec.get("value")), F.lit(False))


def predicate(spec: Mapping, columns: set[str] | None = None) -> Column:
    """A nested declaration of all_of, any_of, none_of and leaves {field, op, value} as one expression."""
    checked(spec, columns)
    return _compiled(spec)
