"""Exact money as Columns: fixed scales, both rounding rules, safe ratios."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

MONEY = "decimal(20,4)"
WIDE = "decimal(38,4)"


def column(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def money(c: Column | str) -> Column:
    """A number as an amount of four decimals; what cannot be one is null."""
    return column(c).try_cast(MONEY)


def cents(c: Column | str) -> Column:
    """Two decimals, halves away from zero: for final figures only."""
    return F.round(column(c).cast(WIDE), 2).cast("decimal(38,2)")


def half_even(c: Column | str) -> Column:
    """Four decimals, halves to the even neighbour."""
    return F.bround(column(c), 4).cast(WIDE)


def ratio(numerator: Column | str, denominator: Column | str) -> Column:
    """Quotient of two amounts with four decimals, halves to even; null over zero or null.

    Operands are brought to decimal(20,4) first: of wider ones a quotient keeps only six digits.
    """
    top, bottom = column(numerator).cast(MONEY), column(denominator).cast(MONEY)
    return F.bround(F.try_divide(top, bottom), 4).cast(MONEY)


def total(*columns: Column | str) -> Column:
    """Sum of columns in which null counts as zero."""
    return reduce(lambda a, b: a + b, [F.coalesce(column(c), F.lit(0)) for c in columns])


def within(left: Column, right: Column, absolute: float | str, relative: float | str = 0) -> Column:
    """Whether two amounts differ by no more than the larger of the absolute and the relative tolerance."""
    scale = F.greatest(F.abs(left), F.abs(right))
    return F.abs(left - right) <= F.greatest(F.lit(str(absolute)).cast(MONEY), scale * F.lit(str(relative)).cast("decimal(10,6)"))
