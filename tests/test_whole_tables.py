"""Queries that leave no row of their table out, against brute force."""

import random

from saldo.catalogue import QUERIES
from saldo.operators import graph


def least_reachable(edges):
    parent = {}

    def root(i):
        parent.setdefault(i, i)
        while parent[i] != i:
            i = parent[i]
        return i

    for a, b in edges:
        x, y = sorted((root(a), root(b)))
        parent[y] = x
    return {i: root(i) for i in list(parent)}


def test_components_equal_union_find(spark):
    rng = random.Random(7)
    edges = [(i, i + 1) for i in range(1000, 1040)] + [(rng.randrange(300), 500 + rng.randrange(300)) for _ in range(220)] + [(7, 7)]
    got = graph.components(spark.createDataFrame([*edges, (None, 3), (4, None)], "a long, b long")).collect()
    assert {r["id"]: r["component"] for r in got} == least_reachable(edges) and len(got) == len({r["id"] for r in got})


def test_components_hold_every_order(spark, sf_dir):
    orders = [(r[0], r[1]) for r in spark.read.parquet(f"{sf_dir}/orders.parquet").select("o_custkey", "o_orderkey").collect()]
    got = QUERIES["bridge_components_all"](spark, sf_dir).collect()
    assert {r["id"]: r["component"] for r in got} == least_reachable([(2 * c, 2 * o + 1) for c, o in orders])
    assert sum(r["id"] % 2 for r in got) == len({o for _, o in orders})


def test_guarded_sql_sees_every_order(spark, sf_dir):
    got = QUERIES["certified_sql_guard_all"](spark, sf_dir).collect()
    assert sum(r["n"] for r in got) == spark.read.parquet(f"{sf_dir}/orders.parquet").count()
