"""Documents of null and repeated ids lose no row and get their own results."""

import hashlib

import pyarrow as pa
import pytest

from saldo.llm import decontaminate, fingerprint, repeats

PASSAGE = "the quick brown fox jumps over the lazy dog again and again today"


@pytest.mark.parametrize("ids", [[None, None, 1, 2, 3, 4], [None, None, None], [7, 7, 7, 7, None, 9], [3, 3, 3], [None, 5]])
@pytest.mark.parametrize("ranges", [1, 128])
def test_every_row_has_a_next_one(spark, ids, ranges):
    docs = [(i, f"text {k} " + chr(97 + k) * 30) for k, i in enumerate(ids)]
    order = sorted(docs, key=lambda r: (r[0] is None, -(r[0] or 0), r[1]))
    want = []
    for k, (i, text) in enumerate(order):
        after, third = order[(k + 1) % len(order)][1], len(text) // 3
        want.append((i, hashlib.sha256((text[: len(text) - third] + after[:third]).encode()).hexdigest()))
    got = fingerprint.compare_with_edits(spark.createDataFrame(docs, "doc_id long, text string"), ranges=ranges).collect()
    assert sorted((str(r["doc_id"]), r["edited_sha256"]) for r in got) == sorted((str(i), d) for i, d in want)


@pytest.mark.parametrize("broadcast", [decontaminate.BROADCAST_WINDOWS, 0])
def test_contaminated_rows_without_ids(spark, broadcast):
    docs = spark.createDataFrame([(None, PASSAGE, "a"), (None, "fine text", "b"), (1, f"x {PASSAGE}", "c"), (1, "fine too", "d"), (None, None, "e"), (2, "short one here", "f")], "doc_id long, text string, items string")
    bench = spark.createDataFrame([(None, PASSAGE), ("b", PASSAGE), (None, "short one")], "item_id string, text string")
    got = sorted((str(r["doc_id"]), r["n_hit"], r["n_items"], r["items_sha256"][:4]) for r in decontaminate.scan_windows(docs, bench, broadcast_windows=broadcast).collect())
    sha = lambda x: hashlib.sha256(x.encode()).hexdigest()[:4]
    assert got == sorted([("None", 13, 2, sha(",b")), ("None", 0, 0, sha("")), ("1", 13, 2, sha(",b")), ("1", 0, 0, sha("")), ("None", 0, 0, sha("")), ("2", 2, 1, sha(""))])
    kept = decontaminate.drop_contaminated(docs, bench, broadcast_windows=broadcast)
    assert kept.columns == docs.columns and sorted(r["items"] for r in kept.collect()) == ["b", "d", "e"]


def test_many_items_in_one_text_and_copies_of_one_item(spark):
    """Both ways of looking agree where a text holds hundreds of items, a third of all items are copies and most texts share a passage."""
    passages = [" ".join(f"w{k}x{j}" for j in range(8 + k % 9)) for k in range(300)]
    items = [(f"i{k}", p) for k, p in enumerate(passages)] + [(f"c{k}", passages[0] + " " + passages[1]) for k in range(150)]
    docs = [(0, " and ".join(passages))] + [(k, f"number {k} {passages[0]} {passages[1]} end") for k in range(1, 60)] + [(k, f"clean {k} " * 8) for k in range(60, 80)]
    table, bench = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id string, text string")
    one, two = (sorted(map(tuple, decontaminate.scan_windows(table, bench, broadcast_windows=b).collect())) for b in (decontaminate.BROADCAST_WINDOWS, 0))
    assert one == two and one[0][3] == 300 and one[1][3] >= 152 and not one[-1][2]


def test_ids_of_text_and_many_ranges(spark):
    docs = [(f"id-{k:03d}", f"text {k} " + chr(97 + k % 26) * 30) for k in range(200)] + [(None, "none")]
    got = fingerprint.compare_with_edits(spark.createDataFrame(docs, "doc_id string, text string"), ranges=40).collect()
    order = sorted(docs, key=lambda r: (r[0] is not None, r[0] or ""), reverse=True)
    want = {i: t[: len(t) - len(t) // 3] + order[(k + 1) % len(order)][1][: len(t) // 3] for k, (i, t) in enumerate(order)}
    assert {r["doc_id"]: r["edited_sha256"] for r in got} == {i: hashlib.sha256(t.encode()).hexdigest() for i, t in want.items()}


def test_ids_beyond_doubles(spark):
    docs = [(None, "none at all"), *[(2**60 + k, f"text {k}") for k in range(50)]]
    got = fingerprint.compare_with_edits(spark.createDataFrame(docs, "doc_id long, text string"), ranges=20).collect()
    assert sorted(r["doc_id"] or 0 for r in got) == sorted(i or 0 for i, _ in docs)


@pytest.mark.parametrize("kind", ["long", "string"])
def test_repeats_without_ids(spark, kind):
    one, other = "abcdefghij" * 3 + "".join(chr(65 + k % 26) + str(k) for k in range(120)), "".join(str(k) + "-" for k in range(100))
    ids = {None: None, 1: "1" if kind == "string" else 1, 2: "2" if kind == "string" else 2}
    docs = [(None, one), (None, one), (1, other), (2, "short"), (2, one + "x"), (1, other)]
    got = repeats.removed(spark.createDataFrame([(ids[i], t) for i, t in docs], f"doc_id {kind}, text string")).collect()
    n = len(one)
    # Of id 2 the text of least digest keeps the id; the null ones come before the other, which ends in a byte that is new.
    key = min(("short", one + "x"), key=lambda t: hashlib.sha256(t.encode()).digest())
    want = [(1, len(other), 0), (1, len(other), 0), (2, 5, 0)]
    want += [(None, n, 0), (None, n, n), (2, n + 1, n)] if key == "short" else [(None, n, n), (None, n, n), (2, n + 1, 0)]
    assert sorted((str(r["doc_id"]), r["n_bytes"], r["n_removed"]) for r in got) == sorted((str(ids[i]), a, b) for i, a, b in want)


def test_crowded_cores_and_batches(spark, monkeypatch):
    """A passage in many documents, each with its own surroundings: sorted groups and split ones say the same."""
    batch = pa.RecordBatch.from_pydict({"key": [1, 1, 2, 2, 2], "id": [1, 2, 1, 3, 3], "at": [0, 5, 0, 0, 9], "more": [2, 1, 0, 1, 0], "bytes": [b"abcd", b"bcd", b"bc", b"abc", b"bc"]})
    for at_once in (200_000, 2):
        monkeypatch.setattr(repeats, "SORTED", at_once)
        found = {(int(r), int(n)) for row, shift in repeats.repeated_suffixes(batch, 2) for r, n in zip(row, shift, strict=True)}
        assert found == {(1, 0), (1, 1), (3, 1), (4, 0)}
    passage = "".join(chr(65 + k * 7 % 26) + str(k * k % 97) for k in range(90))
    docs = [(k, f"{k * 7919 % 1000:03d}" * (k % 5) + passage[: 150 + k % 60] + f"{k * 104729 % 10**6:06d}" * 4) for k in range(60)]
    seen, want = {}, {}
    for k, text in docs:
        gone = [False] * len(text)
        for at in range(len(text) - 99):
            if seen.setdefault(text[at : at + 100], (k, at)) != (k, at):
                gone[at : at + 100] = [True] * 100
        want[k] = sum(gone)
    table = spark.createDataFrame(docs, "doc_id long, text string")
    for crowd in (1000, 3):
        monkeypatch.setattr(repeats, "CROWD", crowd)
        assert {r["doc_id"]: r["n_removed"] for r in repeats.removed(table).collect()} == want
