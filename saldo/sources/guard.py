"""A read-only SQL surface over allowed tables, checked on Spark's own parsed plan."""

from __future__ import annotations

import re
from collections.abc import Mapping

from pyspark.sql import DataFrame, SparkSession

# Node names of parsed plans that may occur, and functions that reach outside the rows.
ALLOWED_NODES = frozenset("Project Filter Aggregate Sort GlobalLimit LocalLimit Join SubqueryAlias UnresolvedRelation Union Distinct UnresolvedHaving Except Intersect OneRowRelation UnresolvedSubqueryColumnAliases UnresolvedWith".split()) - {"UnresolvedWith"}
FORBIDDEN = re.compile(r"\b(reflect|java_method|try_reflect|input_file_\w+|current_user|session_user|version|read_files|sql_keywords)\s*\(", re.I)


class GuardError(ValueError):
    """A statement that is no single read of allowed tables."""


def checked(spark: SparkSession, sql: str, allowed: Mapping[str, object]) -> None:
    """Raise unless the statement is one SELECT, or a union of them, without CTE, over allowed tables."""
    if FORBIDDEN.search(sql):
        raise GuardError("a function that is not allowed")
    try:
        plan = spark._jsparkSession.sessionState().sqlParser().parsePlan(sql)
    except Exception as e:
        raise GuardError(f"not one statement of SQL: {str(e).splitlines()[0]}") from e
    nodes = [plan]
    while nodes:
        node = nodes.pop()
        if (name := node.nodeName()) not in ALLOWED_NODES:
            raise GuardError(f"{name} is not allowed")
        if name == "UnresolvedRelation" and node.tableName() not in allowed:
            raise GuardError(f"table {node.tableName()} is not allowed")
        for inner in (node.children(), node.subqueriesAll()):
            nodes += [inner.apply(i) for i in range(inner.size())]


def run_guarded(spark: SparkSession, sql: str, allowed: Mapping[str, DataFrame], most: int = 1000) -> DataFrame:
    """Rows of a checked statement, `most` at the most; the tables are visible under their allowed names only."""
    checked(spark, sql, allowed)
    hidden = {name: spark.table(name) for name in allowed if spark.catalog.tableExists(name)}
    try:
        for name, table in allowed.items():
            table.createOrReplaceTempView(name)
        # The statement is resolved here, so the names need not stay.
        return spark.sql(sql).limit(most)
    finally:
        for name in allowed:
            spark.catalog.dropTempView(name)
        for name, table in hidden.items():
            table.createOrReplaceTempView(name)
