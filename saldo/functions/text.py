"""Dirty text as Columns: header folding, keys, numbers, dates, periods, masks."""

from __future__ import annotations

import re
from collections.abc import Callable, Mapping

from pyspark.sql import Column
from pyspark.sql import functions as F

from saldo.functions.money import MONEY, column

# What counts as no value, total-row markers, and the date layouts in the order they are tried.
NULL_TOKENS = ("", "-", "--", "无", "N/A", "null", "NULL")
TOTAL_MARKERS = ("合计", "总计", "小计", "汇总")
DATE_LAYOUTS = (
    "%Y-%m-%d %H:%M:%S", "%Y-%m-%d %H:%M", "%Y-%m-%d",
    "%Y/%m/%d %H:%M:%S", "%Y/%m/%d %H:%M", "%Y/%m/%d",
    "%Y%m%d%H%M%S", "%Y%m%d",
    "%Y年%m月%d日", "%Y.%m.%d",
)
PARTS = {"%Y": r"\d{4}", "%m": r"\d{1,2}", "%d": r"\d{1,2}", "%H": r"([01]?\d|2[0-3])", "%M": r"[0-5]?\d", "%S": r"[0-5]?\d"}
#: The layouts without separators, which have two digits a part, and those with; no text has two of them.
COMPACT = r"^\d{8}(([01]\d|2[0-3])[0-5]\d[0-5]\d)?$"
LAID_OUT = "|".join(f"^{re.sub('%.', lambda m: PARTS[m[0]], layout.replace('.', '[.]'))}$" for layout in DATE_LAYOUTS if not layout.startswith("%Y%m"))
#: A date as it is usually written, and how whatever `parse_date` reads begins.
USUAL_DATE = r"^\d{4}-\d{2}-\d{2}( ([01]\d|2[0-3]):[0-5]\d(:[0-5]\d)?)?\z"
DATE_BEGINS = r"^(\d{5}|\d{4}[-/.年]|20)"
NUMBER_MARKS, QUOTES_AND_BLANKS = "¥￥$€£元, \t\n\u000b\f\r\u3000\ufeff", " \t\n\u000b\f\r\u3000\ufeff\"'`"
WIDE_MARKS, NARROW_MARKS = "（）［］｛｝：，．／", "()[]{}:,./"
# How a file's name tells its month, and the century that is left out.
PERIODS = (
    (r"(20\d{2})\s*[-年._]\s*(1[0-2]|0?[1-9])\s*月?", ""),
    (r"(20\d{2})(1[0-2]|0[1-9])(?!\d)", ""),
    (r"(?<!\d)(2[0-9])(1[0-2]|0[1-9])(?!\d)", "20"),
)
#: One form more: a year of two digits that is marked as one.
MARKED_PERIOD = (r"(?<!\d)(\d{2})\s*年\s*(1[0-2]|0?[1-9])\s*月", "20")
BLANKS = r"[\s　﻿]+"
EDGES = r"^[\s　﻿]+|[\s　﻿]+$"


def clean_cell(c: Column | str, nulls: tuple[str, ...] = NULL_TOKENS) -> Column:
    """A cell without blanks at its edges; null tokens are null."""
    trimmed = F.regexp_replace(column(c), EDGES, "")
    return F.when(~trimmed.isin(*nulls), trimmed)


def fold_header(c: Column | str) -> Column:
    """A header without blanks, its full-width marks made half-width."""
    return F.translate(F.regexp_replace(column(c), BLANKS, ""), WIDE_MARKS, NARROW_MARKS)


def norm_key(c: Column | str) -> Column:
    """An order key without blanks, quotes and leading at-signs; a final .0 goes only behind digits; empty is null."""
    bare = F.ltrim(F.translate(column(c).cast("string"), QUOTES_AND_BLANKS, ""), F.lit("@"))
    # Most keys do not end so, and are not looked at by a pattern.
    bare = F.when(bare.endswith(".0") & bare.rlike(r"^[0-9]+\.0$"), F.left(bare, F.length(bare) - 2)).otherwise(bare)
    return F.nullif(bare, F.lit(""))


def once(c: Column, made: Callable[[Column], Column]) -> Column:
    """What is made of a value that is worked out once, however often it is used; not compiled, so for the rarer cells."""
    return F.get(F.transform(F.array(c), made), F.lit(0))


def parse_number(c: Column | str) -> Column:
    """A dirty number as an amount: currency marks, thousands, per cent and brackets are understood, else null.

    What is a number as it stands takes one cast; only other cells with a digit are looked at further.
    """
    text = column(c).cast("string")

    def marked(bare: Column) -> Column:
        bracketed = (bare.startswith("(") & bare.endswith(")")) | (bare.startswith("（") & bare.endswith("）"))
        inner = F.when(bracketed, F.substr(bare, F.lit(2), F.length(bare) - 2)).otherwise(bare)
        percent = inner.endswith("%")
        number = F.when(percent, F.left(inner, F.length(inner) - 1)).otherwise(inner).try_cast("decimal(30,10)")
        signed = F.when(bracketed, -number).otherwise(number)
        return F.when(percent, signed / 100).otherwise(signed).cast(MONEY)

    dirty = F.when(text.rlike(r"\p{Nd}"), once(F.translate(text, NUMBER_MARKS, ""), marked))
    return F.coalesce(text.try_cast("decimal(30,10)").cast(MONEY), dirty)


def parse_date(c: Column | str) -> Column:
    """A dirty date: one of the layouts, with or without a zone; a spreadsheet's day number; or else what begins as a date of this century.

    The usual layout is told by one pattern and read by one cast. Of other cells those that begin like a date are
    looked at further.
    """
    shown = column(c).cast("string")
    plain = F.trim(F.substring_index(F.translate(clean_cell(shown), "T", " "), "+", 1))

    def read(plain: Column) -> Column:
        compact = plain.rlike(COMPACT)
        parted = F.regexp_replace(plain, r"(?s)^(\d{4})\D+(\d{1,2})\D+(\d{1,2}).*$", "$1-$2-$3")
        whole = F.concat_ws("-", F.substring(plain, 1, 4), F.substring(plain, 5, 2), F.substring(plain, 7, 2))
        serial = F.date_add(F.lit("1899-12-30").cast("date"), F.floor(plain.try_cast("double")).cast("int"))
        dated = F.when(plain.startswith("20") | plain.rlike(LAID_OUT), parted.try_cast("date"))
        return F.when(compact, whole.try_cast("date")).when(plain.rlike(r"^\d{5}(\.\d+)?$"), serial).otherwise(dated)

    return F.when(shown.rlike(USUAL_DATE), F.substring(shown, 1, 10).try_cast("date")).when(plain.rlike(DATE_BEGINS), once(plain, read))


def period(c: Column | str) -> Column:
    """The month of a time as yyyy-MM."""
    return F.date_format(column(c), "yyyy-MM")


def period_in(c: Column | str) -> Column:
    """A month named in free text, such as 2024-05, 2024年5月, 202405, 2405 or 24年5月; null if there is none."""
    found = [F.concat(F.lit(century), first_group(c, p, 1), F.lit("-"), F.lpad(first_group(c, p, 2), 2, "0")) for p, century in (*PERIODS, MARKED_PERIOD)]
    return F.coalesce(*found)


def first_group(c: Column | str, pattern: str, group: int = 1) -> Column:
    """The group of the first match; null where the pattern does not occur or the group is empty."""
    return F.nullif(F.regexp_extract(column(c), pattern, group), F.lit(""))


def shape_pattern(shape: str) -> str:
    """A shape such as D{1,4}-A{2} (digits, letters, everything else as it stands) as an anchored pattern."""
    out, at = [], 0
    while at < len(shape):
        mark, count = shape[at], ""
        at += 1
        if mark in "DA" and at < len(shape) and shape[at] == "{":
            end = shape.index("}", at)
            count, at = shape[at : end + 1], end + 1
        out.append({"D": r"\p{Nd}", "A": r"\p{L}"}.get(mark, "\\" + mark if not mark.isalnum() else mark) + count)
    return "^" + "".join(out) + "$"


def mask(c: Column | str) -> Column:
    """A value's kind and twelve digits of its digest, for profiles that must not show it."""
    text = column(c).cast("string")
    digest = F.substring(F.sha2(text, 256), 1, 12)
    decimals = F.length(F.regexp_extract(text, r"\.([0-9]+)$", 1))
    number = F.concat(F.lit("<number:scale="), decimals.cast("string"), F.lit(":"), digest, F.lit(">"))
    return F.when(text.rlike(r"^-?[0-9]+(\.[0-9]+)?$"), number).when(text.isNotNull(), F.concat(F.lit("<text:len="), F.length(text).cast("string"), F.lit(":"), digest, F.lit(">")))


#: The kinds that a column's values may all be of, the first that does.
KINDS = ("id", "number", "time")


def kinds_of(value: Column | str) -> dict[str, Column]:
    """Whether a cleaned cell is an id (11 digits or more), a number, a time; null where it is empty."""
    v = column(value)
    tests = (v.rlike(r"^[@'\"]?[0-9]{11,}$"), parse_number(v).isNotNull(), parse_date(v).isNotNull())
    return {kind: F.when(v.isNotNull(), test) for kind, test in zip(KINDS, tests, strict=True)}


def shape_of_kinds(flags: Mapping[str, Column]) -> Column:
    """Aggregate: the kind that all of a column's cells are of by what `kinds_of` says of each, else text; empty if there are none."""
    out = F.when(F.count(flags[KINDS[0]]) == 0, "empty")
    for kind in KINDS:
        out = out.when(F.bool_and(flags[kind]), kind)
    return out.otherwise("text")


def shape_of(c: Column | str) -> Column:
    """Aggregate: whether a column's values are ids (11 digits or more), numbers, times, text, or there are none."""
    return shape_of_kinds(kinds_of(clean_cell(c)))


def repaired(c: Column | str) -> Column:
    """Text that was read as Latin-1 though it was UTF-8, mended where its bytes are valid UTF-8."""
    text = column(c)
    mangled = text.rlike("[\u00c2-\u00f4][\u0080-\u00bf]") & ~text.rlike("[^\\x{00}-\\x{ff}]")
    read = F.when(mangled, F.encode(text, "ISO-8859-1").cast("string"))
    return F.when(F.is_valid_utf8(read), read).otherwise(text)


def guarded(c: Column | str) -> Column:
    """A cell that a spreadsheet will not take for a formula."""
    text = column(c).cast("string")
    return F.when(text.rlike(r"^[\s]*[=+\-@\t\r]"), F.concat(F.lit("'"), text)).otherwise(text)
