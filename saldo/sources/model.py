"""The model's own tables from files: dictionaries, fee rules, ownership; and evidence, inventories and reviews.

All are read by Spark with a given schema; every cell is trimmed, as people write these files.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from saldo.functions.money import MONEY
from saldo.functions.text import guarded
from saldo.operators.dedupe import fingerprint
from saldo.sources.tables import read_csv

# How a comment line states a control total, and the side that its label means.
CONTROL = r"^#\s*([^：:]{2,12})\s*[：:]\s*(?:(-?[\d,]+)\s*笔\s*[，,]?\s*)?(?:共\s*)?(-?[\d,]+\.?\d*)\s*元"
DIRECTIONS = {"支出合计": "outgo", "收入合计": "income"}


def typed_csv(spark: SparkSession, path: str, types: Mapping[str, str]) -> DataFrame:
    """A CSV file with a header as the named columns of the given types, trimmed; what cannot be one is null."""
    raw = read_csv(spark, path)
    lacking = [c for c in types if c not in raw.columns]
    if lacking:
        raise ValueError(f"{path} lacks the columns {lacking}")
    return raw.select(*[F.col(f"`{c}`").try_cast(kind).alias(c) for c, kind in types.items()])


TABLES = {
    "dictionary": {"platform": "string", "raw": "string", "major": "string", "minor": "string"},
    "fee_rules": {"platform": "string", "stage": "string", "priority": "int", "column": "string", "how": "string", "value": "string", "major": "string", "minor": "string"},
    "commission": {"product_id": "string", "person": "string", "share": "decimal(18,12)", "effective_from": "date"},
    "overhead": {"period": "string", "amount": MONEY},
    "ownership": {"product_id": "string", "store": "string", "person": "string", "period": "string"},
}


def model_table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """One of the model's tables by name, from `<folder>/<name>.csv`."""
    return typed_csv(spark, f"{folder.rstrip('/')}/{name}.csv", TABLES[name])


def overlaid(template: Sequence[Mapping], fees: Sequence[Mapping], platform: str) -> list[Mapping]:
    """The rule chain in force: a platform's fee rules of the stage `before`, the template's own in their order, those of `after`."""
    own = sorted((f for f in fees if f["platform"] in (platform, "*")), key=lambda f: f["priority"])
    stage = lambda s: [{k: v for k, v in f.items() if k not in ("platform", "stage", "priority")} for f in own if f["stage"] == s]
    return [*stage("before"), *template, *stage("after")]


def rule_checked(rule: Mapping) -> Mapping:
    """A rule, if it is of a known kind, has a matcher where it needs one, and what its kind gives."""
    gives = {"classify": "major", "route": "route", "extract": "pattern", "map": "values", "derive": "expression"}
    if rule.get("kind") not in gives or not rule.get("id"):
        raise ValueError(f"no rule: {dict(rule)}")
    if not rule.get(gives[rule["kind"]]):
        raise ValueError(f"{rule['id']} lacks {gives[rule['kind']]}")
    if rule["kind"] in ("classify", "route") and not ("when" in rule or rule.get("how") == "always" or {"column", "how"} <= set(rule)):
        raise ValueError(f"{rule['id']} has no condition")
    return rule


def fee_changes(wanted: DataFrame, known: DataFrame, keys: Sequence[str], fields: Sequence[str]) -> DataFrame:
    """(keys, change) of a table of fee rules against the known one: added, removed, changed; equal ones are left out."""
    told = lambda df, side: df.select(*keys, fingerprint(fields).alias(side))
    both = told(wanted, "_new").join(told(known, "_old"), list(keys), "full")
    change = F.when(F.col("_old").isNull(), "added").when(F.col("_new").isNull(), "removed").when(F.col("_new") != F.col("_old"), "changed")
    return both.select(*keys, change.alias("change")).where("change is not null")


def control_totals(lines: DataFrame, file: str, line: str) -> DataFrame:
    """(file, label, count, amount, direction) of every comment line that states a control total."""
    part = lambda i: F.nullif(F.regexp_extract(F.trim(line), CONTROL, i), F.lit(""))
    number = lambda i, kind: F.translate(part(i), ",", "").try_cast(kind)
    label = F.trim(part(1))
    direction = F.coalesce(*[F.when(label == k, F.lit(v)) for k, v in DIRECTIONS.items()], F.lit("both"))
    return lines.where(F.trim(line).rlike(CONTROL)).select(file, label.alias("label"), number(2, "long").alias("count"), number(3, MONEY).alias("amount"), direction.alias("direction"))


def inventory(spark: SparkSession, path: str, pattern: str = "*", quiet_seconds: int = 0, now: Column | None = None) -> DataFrame:
    """(path, name, length, modified, stable) of the files under a path, without reading them; stable ones have not changed for so long."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", pattern).load(path)
    age = F.unix_timestamp(now if now is not None else F.current_timestamp()) - F.unix_timestamp("modificationTime")
    return files.select("path", F.element_at(F.split("path", "/"), -1).alias("name"), "length", F.col("modificationTime").alias("modified"), (age >= quiet_seconds).alias("stable"))


def hashed(spark: SparkSession, path: str, pattern: str = "*") -> DataFrame:
    """(path, sha256) of the files under a path: what addresses their content."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", pattern).load(path)
    return files.select("path", F.sha2("content", 256).alias("sha256"))


def keep_evidence(facts: DataFrame, path: str, run: str, slices: Sequence[str] = ("store", "period")) -> None:
    """Facts of a run under its own folder, by slice; a run that is tried again replaces its folder, so nothing is kept twice."""
    facts.write.mode("overwrite").partitionBy(*slices).parquet(f"{path.rstrip('/')}/run={run}")


def evidence_around(rows: DataFrame, file: str, sheet: str, row_no: int, width: int = 5, most_cells: int = 200) -> DataFrame:
    """Source rows around one of them, `width` to either side, each with its first cells only."""
    near = rows.where((F.col("file") == file) & F.col("sheet").eqNullSafe(F.lit(sheet)) & F.col("row_no").between(row_no - width, row_no + width))
    return near.withColumn("cells", F.slice("cells", 1, most_cells)).withColumn("hit", F.col("row_no") == row_no)


def exported_reviews(reviews: DataFrame, key: str, fields: Sequence[str]) -> DataFrame:
    """Reviews for a spreadsheet: guarded cells, the digest of what was offered, and an empty decision."""
    return reviews.select(F.col(key).cast("string").alias(key), *[guarded(f).alias(f) for f in fields], fingerprint(fields).alias("candidate_hash"), F.lit("").alias("decision"))


def imported_reviews(returned: DataFrame, reviews: DataFrame, key: str, fields: Sequence[str], allowed: Sequence[str] = ("accept", "reject")) -> DataFrame:
    """(key, decision, status) of returned rows: ok, undecided, unknown (no such review), changed (no longer what was offered), invalid or
    repeated (decided twice, differently)."""
    current = reviews.select(F.col(key).cast("string").alias("_key"), fingerprint(fields).alias("_hash"))
    decision = F.lower(F.trim(F.coalesce("decision", F.lit(""))))
    told = returned.select(F.trim(F.col(key)).alias(key), F.trim("candidate_hash").alias("candidate_hash"), decision.alias("decision"))
    once = told.groupBy(key).agg(F.min("candidate_hash").alias("candidate_hash"), F.max("decision").alias("decision"), F.count_distinct(F.nullif("decision", F.lit(""))).alias("_n"))
    joined = once.join(current, F.col(key) == F.col("_key"), "left")
    status = F.when(F.col("_key").isNull(), "unknown").when(F.col("candidate_hash") != F.col("_hash"), "changed").when(F.col("_n") > 1, "repeated").when(F.col("decision") == "", "undecided").when(F.col("decision").isin(*allowed), "ok").otherwise("invalid")
    return joined.select(key, "decision", status.alias("status"))


def renamed(df: DataFrame, aliases: Mapping[str, Sequence[str]]) -> DataFrame:
    """Columns under their canonical names: of a name's aliases the first that the table has, by folded header; other columns stay."""
    plain = {"".join(c.lower().split()): c for c in df.columns}
    found = {next(plain[k] for a in names if (k := "".join(a.lower().split())) in plain): canonical for canonical, names in aliases.items() if canonical not in df.columns and any("".join(a.lower().split()) in plain for a in names)}
    return df.withColumnsRenamed(found)


def with_hints(df: DataFrame, file: str, store: Column, period: Column) -> DataFrame:
    """Rows with the store and the month that their file's name tells, where they have none of their own."""
    own = lambda name, hint: F.coalesce(F.col(name), hint) if name in df.columns else hint
    return df.withColumns({"store": own("store", store), "period": own("period", period)})


def appended(df: DataFrame, table: str) -> None:
    """Rows at the end of a table of the catalogue, by name of column; the table is made if there is none."""
    if df.sparkSession.catalog.tableExists(table):
        df.select(*df.sparkSession.table(table).columns).write.insertInto(table)
    else:
        df.write.saveAsTable(table)
