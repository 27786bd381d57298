"""Which declared template a file's header fits, and whether a file was made from another."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from saldo.functions import text

# What pivot tables put before a column's name.
PIVOT_PREFIXES = ("求和项:", "求和项：", "计数项:", "计数项：", "平均值项:", "最大值项:", "Sum of ", "Count of ", "Average of ")
# How a sheet says that it was taken from another, or exported by its platform.
TAKEN_FROM = r"(?:来源|路径)\s*[：:].{0,40}?(?:提取|筛选|粘贴|复制|来自|取自)"
EXPORTED = r"路径\s*[：:][^\n]{0,80}?(?:导出|下载)"

NEAR, SHARE = 0.6, 0.25


@dataclass(frozen=True)
class Template:
    """The columns that a header must and must not have, and what its file names contain."""

    name: str
    needs: tuple[str, ...]
    without: tuple[str, ...] = ()
    file_hint: str | None = None


def _folded(names: tuple[str, ...]) -> Column:
    return F.transform(F.array(*map(F.lit, names)).cast("array<string>"), text.fold_header)


def fits(files: DataFrame, templates: list[Template], headers: str = "headers", file_name: str = "file_name", strict: bool = False) -> DataFrame:
    """The files with `template`, `candidates` and `near` (names of templates with most of their columns).

    Of several templates that fit, those whose file hint holds come first, then those
    that need more columns, then the one declared first. When strict, several are none.
    """
    present = F.array_distinct(F.filter(F.transform(headers, text.fold_header), lambda h: h != ""))
    ranked, near = [], []
    for place, t in enumerate(templates):
        shared = F.size(F.array_intersect(present, _folded(t.needs)))
        needed = F.size(F.array_distinct(_folded(t.needs)))
        blocked = F.arrays_overlap(present, _folded(t.without)) if t.without else F.lit(False)
        hit = (shared == needed) & ~blocked
        hinted = F.col(file_name).contains(t.file_hint) if t.file_hint else F.lit(False)
        rank = F.struct(F.coalesce(hinted, F.lit(False)).cast("int").alias("hinted"), needed.alias("needed"), F.lit(-place).alias("place"), F.lit(t.name).alias("name"))
        ranked.append(F.when(hit, rank))
        near.append(F.when((shared < needed) & (shared >= F.ceil(needed * NEAR)), F.lit(t.name)))
    told = files.withColumns({"_hits": F.array_compact(F.array(*ranked)), "near": F.array_compact(F.array(*near))})
    best = F.array_max("_hits")["name"]
    if strict:
        best = F.when(F.size("_hits") == 1, best)
    return told.withColumns({"template": best, "candidates": F.size("_hits")}).drop("_hits")


def made_from_others(headers: Column | str, first_cells: Column | str) -> Column:
    """Why a file counts as derived: 'pivot', 'repeated_headers' or 'provenance'; null if it does not.

    first_cells are the first header and the first cell of the first rows. A cell that
    tells of an export ends the search for one that tells of another sheet.
    """
    names = F.col(headers) if isinstance(headers, str) else headers
    cells = F.slice(F.col(first_cells) if isinstance(first_cells, str) else first_cells, 1, 4)
    filled = F.filter(names, lambda h: F.trim(h) != "")
    n = F.size(filled)
    pivots = F.size(F.filter(names, lambda h: F.exists(F.array(*map(F.lit, PIVOT_PREFIXES)), lambda p: h.startswith(p))))
    repeated = F.size(F.filter(F.array_distinct(filled), lambda h: F.size(F.filter(filled, lambda o: o == h)) > 1))
    # 2 for an export, 1 for another sheet, 0 for neither: the first that is not 0 decides.
    said = F.filter(F.transform(cells, lambda c: F.when(c.rlike(EXPORTED), 2).when(c.rlike(TAKEN_FROM), 1).otherwise(0)), lambda v: v > 0)
    return F.when((n > 0) & (pivots > 0) & (pivots >= n * SHARE), "pivot").when((n > 0) & (repeated >= n * SHARE), "repeated_headers").when(F.get(said, F.lit(0)) == 1, "provenance")
