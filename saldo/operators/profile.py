"""What an unknown table holds: profiles without values, roles proposed for columns, a template tried on rows.

Profiles are one aggregate over all columns; what is proposed is decided on the driver from as many
rows as the table has columns.
"""

from __future__ import annotations

import re
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from saldo.functions.text import KINDS, TOTAL_MARKERS, clean_cell, fold_header, kinds_of, mask, parse_date, parse_number, shape_of_kinds

# How many rows of a declaration are broadcast, and headers that tell what a file is for.
MOST_BROADCAST = 100_000
PURPOSES = (("orders", frozenset(("order_id", "paid_amount"))), ("advertising", frozenset(("campaign", "spend"))), ("settlement", frozenset(("order_id", "income"))), ("product_cost", frozenset(("sku", "unit_cost"))), ("shipping", frozenset(("tracking_no", "freight"))))


def profile(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """(name, kind, rows, filled, empty_share, samples) of each column; samples are the least and the greatest masked value."""
    # Each cell is cleaned once, and read once as each kind; the aggregate sees flags only.
    cells = df.select(*[clean_cell(F.col(name).cast("string")).alias(f"_{i}") for i, name in enumerate(columns)])
    read = cells.select(*[c.alias(f"_{i}_{what}") for i in range(len(columns)) for what, c in {**kinds_of(f"_{i}"), "mask": mask(f"_{i}")}.items()])
    out = []
    for i, name in enumerate(columns):
        seen = F.array_distinct(F.array_compact(F.array(F.min(f"_{i}_mask"), F.max(f"_{i}_mask"))))
        out.append(F.struct(F.lit(name).alias("name"), shape_of_kinds({k: F.col(f"_{i}_{k}") for k in KINDS}).alias("kind"), F.count("*").alias("rows"), F.count(f"_{i}_mask").alias("filled"), seen.alias("samples")))
    return read.agg(F.array(*out).alias("_p")).select(F.explode("_p").alias("_p")).select("_p.*").withColumn("empty_share", F.round(F.try_divide(F.col("rows") - F.col("filled"), F.col("rows")), 6))


def structure(lines: DataFrame, file: str, line: str, delimiter: str = ",") -> DataFrame:
    """Per file of text lines: lines, blank ones, comments, the number of fields that most lines have and how many lines have another."""
    fields = F.size(F.split(line, re.escape(delimiter), -1))
    kept = (F.trim(line) != "") & ~F.col(line).startswith("#")
    counted = lines.groupBy(file, F.when(kept, fields).alias("_f")).agg(F.count("*").alias("_n"), F.count_if(F.trim(line) == "").alias("_blank"), F.count_if(F.col(line).startswith("#")).alias("_notes"))
    usual = F.max_by("_f", F.when(F.col("_f").isNotNull(), F.struct("_n", "_f")))
    told = counted.groupBy(file).agg(F.sum("_n").alias("lines"), F.sum("_blank").alias("blank"), F.sum("_notes").alias("comments"), usual.alias("fields"), F.max(F.when(F.col("_f").isNotNull(), F.col("_n"))).alias("_usual"), F.sum(F.when(F.col("_f").isNotNull(), F.col("_n"))).alias("_kept"))
    return told.withColumn("odd_lines", F.coalesce(F.col("_kept") - F.col("_usual"), F.lit(0))).drop("_usual", "_kept")


def propose(profiles: Sequence[Mapping], roles: Mapping[str, Mapping]) -> dict[str, tuple[str, float]]:
    """Role -> (column, score). A role is {words, kind}; a column scores by words in its folded name, by its kind and by how filled
    it is. A role goes to its best column and a column to its best role, the higher score first."""
    scored = []
    for p in profiles:
        name = re.sub(r"\s+", "", p["name"]).lower()
        for role, spec in roles.items():
            hit = max((len(w) / max(len(name), 1) for w in spec["words"] if w.lower() in name), default=0.0)
            if hit:
                score = 0.6 * min(1.0, hit) + 0.3 * (p["kind"] == spec.get("kind", p["kind"])) + 0.1 * (p["filled"] / max(1, p["rows"]))
                scored.append((-score, role, p["name"]))
    out, used = {}, set()
    for score, role, name in sorted(scored):
        if role not in out and name not in used:
            out[role] = (name, round(-score, 4))
            used.add(name)
    return out


def dry_run(df: DataFrame, binding: Mapping[str, tuple[str, str]]) -> DataFrame:
    """(role, rows, filled, failed, errors) of a drafted binding role -> (column, kind): cells with a value that cannot be read as their kind."""
    read = {"number": parse_number, "time": parse_date}
    out = []
    for role, (name, kind) in binding.items():
        value = clean_cell(F.col(name).cast("string"))
        failed = value.isNotNull() & (read[kind](value).isNull() if kind in read else F.lit(False))
        out.append(F.struct(F.lit(role).alias("role"), F.count("*").alias("rows"), F.count(value).alias("filled"), F.count_if(failed).alias("failed")))
    told = df.agg(F.array(*out).alias("_r")).select(F.explode("_r").alias("_r")).select("_r.*")
    return told.withColumn("ok", F.col("failed") == 0)


def purpose(headers: Sequence[str], hint: str | None = None) -> tuple[str, str]:
    """(purpose, confidence) of a file by its folded headers: the one kind whose headers are all there, else the hint."""
    folded = {re.sub(r"\s+", "_", h.strip().lower()) for h in headers}
    found = [name for name, needed in PURPOSES if needed <= folded]
    if len(found) == 1:
        return found[0], "high"
    if hint in dict(PURPOSES):
        return hint, "medium"
    return ("needs_confirmation", "ambiguous") if found else ("unknown", "low")


def header_row(rows: DataFrame, file: str, row_no: str, cells: str, known: Sequence[Sequence[str]], most: int = 30) -> DataFrame:
    """(file, header_row, template) of the first of the leading rows whose folded cells hold all headers of a template, the fullest one."""
    folded = F.transform(cells, lambda c: fold_header(F.coalesce(c, F.lit(""))))
    hits = F.array_compact(F.array(*[F.when(F.size(F.array_except(F.array(*[fold_header(F.lit(h)) for h in headers]), "_f")) == 0, F.struct(F.lit(len(headers)).alias("n"), F.lit(-i).alias("i"))) for i, headers in enumerate(known)]))
    told = rows.where(F.col(row_no) <= most).withColumn("_f", folded).withColumn("_best", F.array_max(hits)).where("_best is not null")
    return told.groupBy(file).agg(F.min(row_no).alias("header_row"), (-F.min_by("_best", row_no)["i"]).alias("template"))


def without_totals(df: DataFrame, marker: str) -> tuple[DataFrame, DataFrame]:
    """(details, total rows): rows whose marker is null, blank or says that they are a total are totals."""
    plain = F.trim(F.col(marker).cast("string"))
    detail = F.coalesce(~plain.isin("", *TOTAL_MARKERS), F.lit(False))
    return df.where(detail), df.where(~detail)


def total_gaps(df: DataFrame, marker: str, amounts: Sequence[str], keys: Sequence[str] = ()) -> DataFrame:
    """(keys, column, declared, found, gap) of columns whose total rows say something else than their details add up to, in one pass."""
    plain = F.trim(F.col(marker).cast("string"))
    detail = F.coalesce(~plain.isin("", *TOTAL_MARKERS), F.lit(False))
    read = df.select(*keys, detail.alias("_detail"), *[parse_number(F.col(c).cast("string")).alias(f"_{i}") for i, c in enumerate(amounts)])
    of = lambda i, test: F.sum(F.when(test, F.col(f"_{i}")))
    sums = [F.struct(F.lit(c).alias("column"), of(i, ~F.col("_detail")).alias("declared"), of(i, F.col("_detail")).alias("found")) for i, c in enumerate(amounts)]
    told = read.groupBy(*keys).agg(F.array(*sums).alias("_s")).select(*keys, F.explode("_s").alias("_s")).select(*keys, "_s.*")
    return told.withColumn("gap", F.col("declared") - F.col("found")).where(F.abs("gap") >= 0.005)


def time_slots(df: DataFrame, slot: str, fallbacks: Sequence[tuple[str, str]]) -> DataFrame:
    """A time slot, filled where it is empty from the first fallback (column, pattern with one group) that gives a date; never overwritten."""
    own = parse_date(slot)
    others = [parse_date(F.nullif(F.regexp_extract(F.col(c).cast("string"), pattern, 1), F.lit(""))) for c, pattern in fallbacks]
    source = F.coalesce(F.when(own.isNotNull(), F.lit(slot)), *[F.when(o.isNotNull(), F.lit(c)) for o, (c, _) in zip(others, fallbacks, strict=True)])
    return df.withColumns({f"{slot}_from": source, slot: F.coalesce(own, *others)})


def store_in(text: Column | str, stores: Sequence[str]) -> Column:
    """The longest known store whose folded name the folded text contains; null if there is none."""
    hay = fold_header(text)
    known = sorted({s for s in stores if s.strip()}, key=lambda s: (-len(s), s))
    return F.coalesce(F.lit(None).cast("string"), *[F.when(hay.contains(fold_header(F.lit(s))), F.lit(s)) for s in known])


def kinds_of_query(query: str) -> list[str]:
    """What a search text may be: an order id, an amount, text; several at once rather than one too few."""
    plain = query.strip()
    if not plain:
        return []
    kinds = ["order"] if re.fullmatch(r"[A-Za-z0-9-]{8,}", plain) and re.search(r"\d{6}", plain) else []
    number = plain.replace(",", "")
    return kinds + (["amount"] if re.fullmatch(r"-?\d+(\.\d+)?", number) and any(c in number for c in ".-") else []) + ["text"]


def narrowed(facts: DataFrame, **wanted: str | None) -> DataFrame:
    """Facts of a subject, of a file, and with a keyword in any text column (`keyword`); what is None narrows nothing."""
    out = facts
    for name, value in wanted.items():
        if value is None:
            continue
        if name == "keyword":
            texts = [c for c, kind in facts.dtypes if kind == "string"]
            out = out.where(F.contains(F.lower(F.concat_ws("\u001f", *texts)), F.lit(value.lower())))
        else:
            out = out.where(F.col(name) == value)
    return out


def claimed(facts: DataFrame, metrics: DataFrame) -> DataFrame:
    """Facts that their metric claims: metrics (metric_id, major) with a category own the facts of that category only, others all.

    Metrics are counted first, and up to 100,000 of them go to the facts: dealt by metric, all facts of one would be one task's.
    """
    named = metrics.select(F.col("metric_id").alias("_id"), F.col("major").alias("_major"))
    if named.limit(MOST_BROADCAST + 1).count() <= MOST_BROADCAST:
        named = F.broadcast(named)
    return facts.join(named, (F.col("metric_id") == F.col("_id")) & (F.col("_major").isNull() | (F.col("_major") == F.col("major"))), "left_semi")
