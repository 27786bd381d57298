"""Windows of crowded passages are compared by their bytes, whatever their digests say."""

import duckdb
import pytest

from saldo.llm import oracles, repeats


@pytest.mark.parametrize("collide", [False, True])
def test_crowds_and_colliding_digests(spark, monkeypatch, collide):
    monkeypatch.setattr(repeats, "CROWD", 3)
    if collide:
        monkeypatch.setattr(repeats, "window_digests", lambda text, start, window: (text[start].astype("int64") % 2))
    passages = ["".join(chr(97 + (i * i * k + 3 * i) % 26) for i in range(260)) for k in (7, 11, 23)]
    rows = [(d, f"{d} begins " * 3 + passages[d % 3][: 200 + d] + f" and {d * d} ends" + passages[(d + 1) % 3][d : d + 150]) for d in range(30)] + [(100, passages[0]), (101, passages[0]), (102, None)]
    con = duckdb.connect()
    con.execute("CREATE TABLE documents (doc_id BIGINT, text VARCHAR)")
    con.executemany("INSERT INTO documents VALUES (?, ?)", rows)
    columns = "doc_id, n_bytes, n_removed, n_spans, kept_sha256"
    want = sorted(con.sql(f"SELECT {columns} FROM ({oracles.REPEATS})").fetchall())
    got = repeats.removed(spark.createDataFrame(rows, "doc_id long, text string").repartition(4))
    assert sorted(tuple(r) for r in got.select(*columns.split(", ")).collect()) == want
    assert sum(r[2] for r in want) > 5000
