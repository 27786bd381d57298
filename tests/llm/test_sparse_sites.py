"""Shrinkage over many sparse hosts and paths, against sums by hand."""

import math
from collections import defaultdict

import pytest

from saldo.llm import site_quality


def test_sparse_hosts_and_paths_are_shrunk_by_their_size(spark):
    rows = [(i, f"words of a text number {i} " * (1 + i % 5), f"h{i % 83}.example", f"/p{i % 7 if i % 83 else i % 2}") for i in range(600)]
    rows += [(1000 + i, f"a dense page {i}", "big.example", "/all") for i in range(200)]
    labels = {i: int(hash((i % 83) * 7919) % 3 > 0 if i < 1000 else i % 4 == 0) for i, *_ in rows}
    docs = spark.createDataFrame(rows, "doc_id long, text string, host string, path string")
    got = {r["doc_id"]: r for r in site_quality.scored(docs, spark.createDataFrame(list(labels.items()), "doc_id long, quality int"), host="host", path="path").collect()}
    assert got.keys() == labels.keys()
    paths, hosts = defaultdict(lambda: [0, 0.0]), defaultdict(lambda: [0, 0.0])
    for i, _, host, path in rows:
        soft = 1 / (1 + math.exp(-got[i]["evidence"])) if got[i]["held_out"] else labels[i]
        for group in (paths[host, path], hosts[host]):
            group[0] += 1
            group[1] += soft
    prior = sum(g for _, g in hosts.values()) / len(rows)

    def strengths(groups):
        # rate = (good + k * toward) / (n + k), so every group gives the same k.
        return [(good - n * rate) / (rate - toward) for n, good, rate, toward in groups if abs(rate - toward) > 1e-3]

    first = {(host, path): got[i] for i, _, host, path in rows}
    of_path = strengths([(*paths[k], r["path_rate"], r["host_rate"]) for k, r in first.items()])
    of_host = strengths([(*hosts[k[0]], r["host_rate"], prior) for k, r in first.items()])
    assert len(paths) > 300 and min(n for n, _ in paths.values()) == 1
    for found in (of_path, of_host):
        assert len(found) > 50 and min(found) > 0 and found == pytest.approx([found[0]] * len(found), rel=1e-3)
