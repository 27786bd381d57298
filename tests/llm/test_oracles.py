"""Operators that SQL can express give the rows that SQL gives."""

import duckdb
import pytest

from saldo.llm.queries import ORACLES, QUERIES


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_equals_sql(spark, sf01_dir, name):
    with duckdb.connect() as db:
        for table in ("documents", "benchmark", "labels", "conversations"):
            db.execute(f"CREATE VIEW {table} AS SELECT * FROM '{sf01_dir}/{table}.parquet'")
        want = db.execute(ORACLES[name])
        columns = [c[0] for c in want.description]
        rows = want.fetchall()
    got = QUERIES[name](spark, sf01_dir)
    assert sorted(got.columns) == sorted(columns)
    assert sorted(map(tuple, got.select(*columns).collect())) == sorted(rows)
