"""Repair of conversations against SQL and against trying every way."""

import hashlib
import itertools
import random
import zlib

import duckdb
import pytest

from saldo.llm import conversations, oracles, queries

NAMES = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]
TURNS = "conv_id long, turn long, role string, text string, segment int, at string"


def by_id(rows):
    return sorted(rows, key=str)


def sql(rows):
    con = duckdb.connect()
    con.execute("CREATE TABLE conversations (conv_id BIGINT, turn BIGINT, role VARCHAR, text VARCHAR)")
    if rows:
        con.executemany("INSERT INTO conversations VALUES (?, ?, ?, ?)", rows)
    return by_id(con.sql(f"SELECT conv_id, {', '.join(NAMES)} FROM ({oracles.CONVERSATIONS})").fetchall())


def got(frame):
    return by_id([tuple(r[c] for c in ["conv_id", *NAMES]) for r in frame.collect()])


def frame(spark, rows):
    return spark.createDataFrame([(*r, 3, "x") for r in rows], TURNS).repartition(3)


def mended(turns):
    return conversations.repair(conversations.damage(turns), turns.select("conv_id").distinct())


def every_way(rows):
    """The cheapest, then least, audit and its lines, by trying all edits of each row and all inserts."""
    seen, faults = set(), []
    for role, text in rows:
        bare = text.strip(" \t\n\x0b\x0c\r")
        faults.append("must" if not bare or (role, text) in seen else "cut" if bare[-1] not in ".!?" else "")
        seen.add((role, text))
    best = None
    for edits in itertools.product("DKR", repeat=len(rows)):
        if any(f == "must" and e != "D" for f, e in zip(faults, edits, strict=True)):
            continue
        for runs in itertools.product(range(3), repeat=len(rows) + 1):
            cost = 2 * sum(runs) + sum({"D": 3, "K": f == "cut", "R": 2 + (f == "cut")}[e] for f, e in zip(faults, edits, strict=True))
            audit = "".join("I" * n + e for n, e in zip(runs, [*edits, ""], strict=True))
            if best and (cost, audit) >= best[:2]:
                continue
            lines, ok = [], True
            for n, e, row in zip(runs, [*edits, ""], [*rows, None], strict=True):
                steps = [None] * n + ([(e, *row)] if e in ("K", "R") else [])
                for step in steps:
                    after = lines[-1][0] if lines else ""
                    due = "assistant" if after == "user" else "user"
                    if step is None:
                        lines.append((due, due + ":"))
                    elif step[0] == "R":
                        lines.append((due, f"{due}:{step[2]}"))
                    else:
                        kind = {"s": "system", "u": "user", "a": "assistant"}.get(step[1][:1])
                        ok = ok and (kind == due or (kind == "system" and not lines))
                        lines.append((kind, f"{step[1]}:{step[2]}"))
            if ok and (not lines or lines[-1][0] == "assistant"):
                best = (cost, audit, "\n".join(x for _, x in lines))
    return best[0], best[1], hashlib.sha256(best[2].encode()).hexdigest()


def random_rows(seed, conversations=40, most=9):
    pick = random.Random(seed)
    texts = ["Yes.", "No", "", " ", "Why?", "So!\n", "and then", "x.y", "\t", "Äh. "]
    roles = ["user", "assistant", "system", "user", "assistant", "tool", "", "umpire"]
    rows = []
    for c in range(conversations):
        for t in range(pick.randrange(most)):
            rows.append((c, pick.choice([t, t, t, t + 1, None]), pick.choice([*roles, None]), pick.choice([*texts, f"t{t}.", f"u{t}", None])))
    return rows + [(None, 0, "user", "Hi."), (None, 1, "assistant", "Ho."), (None, None, None, None)]


@pytest.mark.parametrize("bits", [12, 1])
def test_random_conversations_like_sql(spark, monkeypatch, bits):
    """With bits = 1 a segment has two rows, so conversations are put together from several."""
    monkeypatch.setattr(conversations, "BITS", bits)
    rows = random_rows(bits)
    assert got(mended(frame(spark, rows))) == sql(rows)


def test_every_way_of_small_conversations(spark):
    pick, rows, want = random.Random(5), [], {}
    for c in range(60):
        own = [(pick.choice(["user", "assistant", "system", "tool"]), pick.choice(["Yes.", "No", "", f"{t}?"])) for t in range(pick.randrange(1, 5))]
        rows += [(c, t, *x) for t, x in enumerate(own)]
        want[c] = every_way(own)
    for r in conversations.repair(frame(spark, rows)).collect():
        assert (r.cost, r.audit, r.repaired_sha256) == want[r.conv_id], [x for x in rows if x[0] == r.conv_id]


def test_one_conversation_holds_most_rows(spark, monkeypatch):
    monkeypatch.setattr(conversations, "BITS", 4)
    pick = random.Random(1)
    rows = [(7, t, pick.choice(["user", "assistant"]), pick.choice(["Yes.", f"n{t}", f"m{t}.", ""])) for t in range(600)] + [(8, t, "user", f"{t}.") for t in range(5)]
    assert got(mended(frame(spark, rows))) == sql(rows)


def test_equal_rows_and_nothing_left(spark):
    gone = next(c for c in range(1000) if zlib.crc32(f"{c}:0".encode()) % 20 == 0)
    rows = [(gone, 0, "user", "Hi."), *[(2000, 1, "user", "Same.")] * 50, (2000, 2, "assistant", "Fine.")]
    out = {r.conv_id: r for r in mended(frame(spark, rows)).collect()}
    assert (out[gone].cost, out[gone].audit, out[gone].repaired_sha256) == (0, "", hashlib.sha256(b"").hexdigest())
    assert got(mended(frame(spark, rows))) == sql(rows)


def test_a_very_long_text_and_an_empty_table(spark):
    rows = [(1, 0, "user", "a b. " * 400_000), (1, 1, "assistant", "x" * 1_000_000)]
    assert got(mended(frame(spark, rows))) == sql(rows)
    assert mended(frame(spark, rows).where("conv_id > 5")).count() == 0


def test_whole_table_like_sql(spark, sf_dir):
    rows = [(r.conv_id, r.turn, r.role, r.text) for r in spark.read.parquet(f"{sf_dir}/conversations.parquet").collect()]
    assert got(queries.op12_conversations(spark, sf_dir)) == sql(rows)
