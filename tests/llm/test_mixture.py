"""Mixing against a plain loop over documents in memory."""

import hashlib
import math
import re
from collections import Counter, defaultdict

import duckdb
from pyspark.sql import functions as F

from saldo.llm import mixture, oracles, queries

SCHEMA = "doc_id long, text string, source string, size string, taken int"


def plain(rows, weights):
    """Every row's (doc_id, size, source_size, target, taken), by source and key in memory."""
    seen, drawn, sizes = Counter(), defaultdict(list), Counter()
    for doc_id, text, source in rows:
        size = len([w for w in re.split(r"[\x20\x09-\x0D]+", text or "") if w])
        seen[doc_id, source, size] += 1
        copy = seen[doc_id, source, size]
        name = "" if doc_id is None else str(doc_id)
        u = (int(hashlib.md5(f"mix:{name}:{copy}".encode()).hexdigest()[:13], 16) + 0.5) / 2**52
        w = weights.get(doc_id, 1.0)
        key = -math.log(u) / w if w > 0 else math.inf
        drawn[source].append((key, -(10**9) if doc_id is None else doc_id, copy, size))
        sizes[source] += size
    order = sorted((s for s in drawn if s is not None)) + [None] * (None in drawn)
    share = {s: (5, 2, 1)[i % 3] for i, s in enumerate(order)}
    capped, total = set(), sum(sizes.values())
    while True:
        rest = total - sum(3 * sizes[s] for s in capped)
        left = sum(share[s] for s in order if s not in capped)
        over = {s for s in order if s not in capped and rest * share[s] > 3 * sizes[s] * left}
        if not over:
            break
        capped |= over
    out = []
    for s in order:
        target = float(3 * sizes[s]) if s in capped else float(rest) * share[s] / left
        epochs = int(target) // sizes[s] if sizes[s] else 0
        budget = int(target) - epochs * sizes[s]
        for _, doc_id, _, size in sorted(drawn[s]):
            part = min(size, budget)
            budget -= part
            out.append((None if doc_id == -(10**9) else doc_id, size, sizes[s], target, epochs * size + part))
    return sorted(out, key=str)


def got(frame):
    return sorted([(r.doc_id, r["size"], r.source_size, r.target, r.taken) for r in frame.collect()], key=str)


def check(spark, rows, weights=None):
    docs = spark.createDataFrame([(*r, "x", 7) for r in rows], SCHEMA).repartition(3)
    quality = spark.createDataFrame(list(weights.items()), "doc_id long, weight double") if weights else None
    out = mixture.mix(docs, quality)
    want = plain(rows, weights or {})
    assert got(out) == want
    assert all(taken <= 3 * size for _, size, _, _, taken in want)
    return out


def test_sources_above_their_limit_nulls_ties_and_repeated_rows(spark):
    words = lambda n: " ".join(["w"] * n)
    rows = [(i, words(i % 17), f"s{i % 4}") for i in range(200)] + [(i, words(3), None) for i in range(300, 320)]
    rows += [(500, words(9), "s0")] * 40 + [(501, None, "s1"), (502, "", "empty"), (503, " \t\n\x0b\r", "empty"), (None, words(4), "s2"), (None, words(4), "s2"), (500, words(11), "s0")]
    rows += [(600 + i, words(500), "z") for i in range(5)] + [(700, words(20_000), "z")]
    check(spark, rows, {1: 5.0, 2: 0.0, 3: -1.0, 500: 0.25, 9: 100.0})


def test_one_source_takes_each_document_once(spark):
    rows = [(i, "a b c", "only") for i in range(30)]
    assert all(r.taken == 3 for r in check(spark, rows).collect())


def test_each_source_comes_to_its_target_and_reruns_agree(spark, sf01_dir):
    out = queries.op11_mixture(spark, sf01_dir)
    docs = spark.read.parquet(f"{sf01_dir}/documents.parquet").select("doc_id", "source")
    for r in out.join(docs, "doc_id").groupBy("source").agg(F.sum("taken").alias("taken"), F.first("target").alias("target")).collect():
        assert 0 <= r.target - r.taken < 1
    assert got(out) == got(queries.op11_mixture(spark, sf01_dir))


def test_shuffled_joins_give_the_same(spark, monkeypatch):
    monkeypatch.setattr(mixture, "BROADCAST_SOURCES", 0)
    check(spark, [(i, "a " * (i % 7), f"s{i % 5}" if i % 11 else None) for i in range(150)])


def test_an_empty_table_and_sources_without_words(spark):
    docs = spark.createDataFrame([(1, "", "a", "x", 7), (2, None, None, "x", 7)], SCHEMA)
    assert got(mixture.mix(docs)) == [(1, 0, 0, 0.0, 0), (2, 0, 0, 0.0, 0)]
    assert mixture.mix(docs.where("doc_id > 5")).count() == 0


def test_sql_gives_the_same_rows(spark, sf_dir):
    con = duckdb.connect()
    for name in ("documents", "labels"):
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{sf_dir}/{name}.parquet'")
    rows = con.sql(f"SELECT doc_id, size, source_size, target, taken FROM ({oracles.MIXTURE})").fetchall()
    assert sorted(rows, key=str) == got(queries.op11_mixture(spark, sf_dir))
