"""Every registered query against the SQL that says the same."""

import datetime
import decimal
from collections import Counter

import duckdb
import pytest

from saldo.catalogue import ORACLES, QUERIES

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="session")
def duck(sf01_dir):
    connection = duckdb.connect()
    connection.execute("SET TimeZone = 'UTC'")
    for name in TABLES:
        connection.execute(f"CREATE VIEW {name} AS SELECT * FROM '{sf01_dir}/{name}.parquet'")
    return connection


def plain(v):
    if isinstance(v, decimal.Decimal):
        v = float(v)
    if isinstance(v, float):
        return round(v, 6) + 0.0
    return v.isoformat() if isinstance(v, datetime.date | datetime.datetime) else v


def counted(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return Counter(tuple(plain(r[i]) for i in order) for r in rows)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_equals_its_sql(spark, duck, sf01_dir, name):
    got = QUERIES[name](spark, sf01_dir)
    found = duck.execute(ORACLES[name])
    columns = [d[0] for d in found.description]
    assert sorted(got.columns) == sorted(columns)
    want, have = counted(columns, found.fetchall()), counted(got.columns, [tuple(r) for r in got.collect()])
    assert have == want, (list((have - want).items())[:3], list((want - have).items())[:3])
    assert want
