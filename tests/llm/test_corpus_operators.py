"""Operators over a whole corpus, against brute force or held-out labels."""

import hashlib
import re
from collections import defaultdict

import numpy as np
import pytest

from saldo.llm import fingerprint, neardup, repeats, site_quality, toxicity
from saldo.llm.queries import QUERIES


def rows_of(spark, sf, name, *columns):
    return [tuple(r) for r in spark.read.parquet(f"{sf}/{name}.parquet").select(*columns).collect()]


def shingles(text, n):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return {tuple(words[i : i + n]) for i in range(max(1, len(words) - n + 1))} if words else set()


def linked(docs, n):
    """{id: (set size, smallest id reachable)} by an inverted index over all shingles."""
    sets = {i: shingles(t, n) for i, t in docs}
    holders, shared, parent = defaultdict(list), defaultdict(int), {i: i for i in sets}
    for i, s in sets.items():
        for x in s:
            holders[x].append(i)
    for ids in holders.values():
        for a in range(len(ids)):
            for b in range(a):
                shared[ids[a], ids[b]] += 1

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for (a, b), k in shared.items():
        if 100 * k >= 80 * (len(sets[a]) + len(sets[b]) - k):
            x, y = sorted((root(a), root(b)))
            parent[y] = x
    return {i: (len(s), root(i), root(i) == i) for i, s in sets.items()}


def test_neardup_equals_brute_force(spark, sf01_dir):
    want = linked(rows_of(spark, sf01_dir, "documents", "doc_id", "text"), 4)
    got = {r["doc_id"]: tuple(r)[1:] for r in QUERIES["op4_neardup"](spark, sf01_dir).collect()}
    assert got == want


def test_neardup_chain_and_edges(spark):
    rng = np.random.default_rng(3)
    words = [f"w{rng.integers(10**6)}" for _ in range(120)]
    texts = [(1, None), (2, ""), (3, " \t "), (4, "one two"), (5, "ONE  two"), (6, "one two three four five"), (7, "x " * 3000)]
    for k in range(12):  # each a little further from the last, so the ends are linked through the middle only
        texts.append((20 + k, " ".join(words[5 * k : 5 * k + 60])))
    docs = spark.createDataFrame([(i, t, 0) for i, t in texts], "doc_id long, text string, component long")
    got = {r["doc_id"]: tuple(r)[1:] for r in neardup.groups(docs, size=4).collect()}
    assert got == linked(texts, 4)
    kept = neardup.keep_one(docs.union(docs.where("doc_id = 6")), size=4)
    assert kept.columns == docs.columns and sorted(r["doc_id"] for r in kept.collect()) == sorted(i for i, w in got.items() if w[2])
    assert neardup.groups(docs.limit(0), size=4).collect() == []


def test_neardup_passage_in_many_documents(spark, monkeypatch):
    """A bucket of many texts that share a passage is split; links between them, just above the similarity and below, stay right."""
    rng = np.random.default_rng(5)
    word = lambda n: [f"w{x}" for x in rng.integers(10**6, size=n)]
    passage, texts = word(60), []
    for k in range(60):
        own = word(int(rng.integers(4, 16)))
        texts.append((2 * k, " ".join(passage + own)))
        texts.append((2 * k + 1, " ".join(passage + own[: int(rng.integers(0, len(own)))] + word(int(rng.integers(0, 8))))))
    monkeypatch.setattr(neardup, "CROWD", 4)
    seen = []
    monkeypatch.setattr(neardup, "rarest", lambda *a, real=neardup.rarest: seen.append(1) or real(*a))
    docs = spark.createDataFrame(texts, "doc_id long, text string")
    got = {r["doc_id"]: tuple(r)[1:] for r in neardup.groups(docs, size=4, draws=0).collect()}
    assert got == linked(texts, 4) and seen


def removal(docs, window=100):
    seen, out = set(), {}
    for i, text in sorted(docs):
        data = (text or "").encode()
        gone = [False] * len(data)
        for at in range(len(data) - window + 1):
            part = data[at : at + window]
            if part in seen:
                gone[at : at + window] = [True] * window
            seen.add(part)
        runs = sum(g and not (k and gone[k - 1]) for k, g in enumerate(gone))
        out[i] = (len(data), sum(gone), runs, hashlib.sha256(bytes(b for b, g in zip(data, gone, strict=True) if not g)).hexdigest())
    return out


def test_repeats_equal_brute_force(spark, sf01_dir):
    want = removal(rows_of(spark, sf01_dir, "documents", "doc_id", "text"))
    got = {r["doc_id"]: tuple(r)[1:] for r in QUERIES["op10_repeats"](spark, sf01_dir).collect()}
    assert got == want and any(w[1] for w in want.values())


def test_repeats_edges(spark):
    line = "This line of boilerplate is a little more than one hundred bytes long, so that it counts as a repeat on its own. "
    texts = [(1, None), (2, ""), (3, "x" * 500), (4, "ü" * 300), (5, line), (6, f"a {line} b {line} c"), (7, line), (8, line[:99]), (9, "y" + "x" * 150), (10, line[5:] + line[:60])]
    docs = spark.createDataFrame([(i, t, "n") for i, t in texts], "doc_id long, text string, first string")
    got = {r["doc_id"]: tuple(r)[1:] for r in repeats.removed(docs).collect()}
    assert got == removal(texts)
    assert repeats.removed(docs.limit(0)).collect() == []


def edited(docs):
    order = sorted(docs, key=lambda r: -r[0])
    for k, (i, text) in enumerate(order):
        text, after = text or "", order[(k + 1) % len(order)][1] or ""
        third = len(text) // 3
        yield i, text, text[: len(text) - third] + after[:third], after


def chunk_set(text):
    return {text[k : k + 10] for k in range(0, len(text), 10)}


def share(one, other):
    if not one:
        return float(not other)
    size = lambda chunks: sum(int(c[8:], 16) for c in chunks)
    return size(one & other) / size(one)


def check_prints(rows, docs):
    prints = {r["doc_id"]: r["fingerprint"] for r in rows.values()}
    of_text = {}
    for i, text, changed, after in edited(docs):
        row = rows[i]
        assert row["n_chars"] == len(text) and row["edited_sha256"] == hashlib.sha256(changed.encode()).hexdigest()
        assert of_text.setdefault(text, row["fingerprint"]) == row["fingerprint"]
        own = chunk_set(row["fingerprint"])
        assert row["near_edited"] == pytest.approx(share(own, chunk_set(row["edited_fingerprint"])))
        nexts = [j for j, t in docs if (t or "") == after]
        assert row["near_next"] == pytest.approx(share(own, chunk_set(prints[nexts[0]])))


def test_fingerprints_of_edits(spark, sf_dir):
    docs = rows_of(spark, sf_dir, "documents", "doc_id", "text")
    rows = {r["doc_id"]: r for r in QUERIES["op3_fingerprint"](spark, sf_dir).collect()}
    assert rows.keys() == {i for i, _ in docs}
    check_prints(rows, docs)
    long = [r for r in rows.values() if r["n_chars"] > 600]
    assert np.median([r["near_edited"] for r in long]) > 0.5 > 0.1 > np.median([r["near_next"] for r in long])


def test_fingerprint_edges(spark):
    docs = [(1, None), (2, ""), (3, "ü" * 1000), (4, "abc"), (5, "word " * 3000), (6, "abc")]
    table = spark.createDataFrame([(i, t, "z") for i, t in docs], "doc_id long, text string, bucket string")
    for ranges in (1, 128):
        check_prints({r["doc_id"]: r for r in fingerprint.compare_with_edits(table, ranges=ranges).collect()}, docs)
    assert fingerprint.compare_with_edits(table.where("doc_id = 4")).first()["near_next"] == 1.0
    assert fingerprint.compare_with_edits(table.limit(0)).collect() == []


def test_chunks_resist_shifts():
    rng = np.random.default_rng(1)
    text = " ".join(f"w{x}" for x in rng.integers(0, 10**5, 800))
    import pyarrow as pa

    one, other = fingerprint.chunk_sets(pa.array([text, "Some words before. " + text]))
    assert fingerprint.likeness(one, other) > 0.95


def plain_chunks(text: bytes) -> list[bytes]:
    """Byte by byte: the hash of the last bytes, the mask by the chunk's size, the limits."""
    out, start = [], 0
    while start < len(text):
        end = start
        while end < len(text):
            end += 1
            size, h = end - start, 0
            for b in text[max(0, end - fingerprint.REACH) : end]:
                h = (h << 1) + int(fingerprint.GEAR[b]) & 0xFFFFFFFF
            mask = int(fingerprint.HARD) if size < fingerprint.NORMAL else int(fingerprint.EASY)
            if size >= fingerprint.LARGEST or size >= fingerprint.SMALLEST and not h & mask:
                break
        out.append(text[start:end])
        start = end
    return out


def test_chunks_equal_a_plain_loop():
    rng = np.random.default_rng(5)
    texts = [b"", b"abc", b"a" * 700, bytes(rng.integers(97, 123, 3000).astype(np.uint8)), b"one two three " * 120]
    for text in texts:
        starts, _ = fingerprint.cuts(np.frombuffer(text, np.uint8), np.array([0, len(text)]))
        assert [text[a:b] for a, b in zip(starts[:-1], starts[1:], strict=True)] == plain_chunks(text)
    # The cuts of a text do not depend on the texts before it, but for the bytes that the hash reaches back to.
    joined = np.frombuffer(b"".join(texts), np.uint8)
    starts, counts = fingerprint.cuts(joined, np.cumsum([0, *map(len, texts)]))
    assert counts[-1] == len(starts) - 1


def auc(score, label):
    order = np.argsort(score, kind="stable")
    rank = np.empty(len(score))
    rank[order] = np.arange(1, len(score) + 1)
    pos = label == 1
    return (rank[pos].sum() - pos.sum() * (pos.sum() + 1) / 2) / (pos.sum() * (~pos).sum())


def held_out_pairs(spark, result, sf, label, score):
    labels = dict(rows_of(spark, sf, "labels", "doc_id", label))
    rows = [(r[score], labels[r["doc_id"]]) for r in result.collect() if r["held_out"] and labels.get(r["doc_id"]) is not None]
    return np.array([r[0] for r in rows]), np.array([r[1] for r in rows])


def test_toxicity_on_held_out_labels(spark):
    sf = "/root/testdata/sf0.1"
    result = QUERIES["op2_toxicity"](spark, sf).cache()
    score, label = held_out_pairs(spark, result, sf, "toxic", "score")
    found = score >= toxicity.THRESHOLD
    # A tenth of the labels or so are noise: texts without any of the words that the others have.
    assert auc(score, label) > 0.93 and found[label == 1].mean() > 0.85 and found[label == 0].mean() < 0.01
    assert result.where("score < 0 or score > 1 or predicted <> if(score >= 0.7, 1, 0)").count() == 0


def test_toxicity_edges(spark, sf_dir):
    docs = spark.createDataFrame([(1, None, 9), (2, "", 9), (3, "1 2 3", 9), (4, "fine words", 9), (4, "fine words", 9), (None, "x", 9)], "doc_id long, text string, score int")
    labels = spark.createDataFrame([(1, 1), (2, None)], "doc_id long, toxic int")
    rows = toxicity.scored(docs, labels).collect()
    assert len(rows) == 6 and {r["score"] for r in rows if r["doc_id"] in (1, 2, 3)} == {rows[0]["score"]}
    assert toxicity.drop_toxic(docs, labels).columns == docs.columns
    assert toxicity.scored(docs.limit(0), labels.limit(0)).collect() == []


def test_site_quality_on_held_out_labels(spark):
    sf = "/root/testdata/sf0.1"
    result = QUERIES["op9_site_quality"](spark, sf).cache()
    assert result.count() == spark.read.parquet(f"{sf}/documents.parquet").count()
    score, label = held_out_pairs(spark, result, sf, "quality", "score")
    assert auc(score, label) > 0.9


def test_site_quality_edges_and_shrinkage(spark):
    docs = spark.createDataFrame([(1, None, None, "en"), (2, "", "a", None), (3, "good words here", "a", "en"), (3, "good words here", "a", "en")], "doc_id long, text string, source string, lang string")
    labels = spark.createDataFrame([(3, 1), (1, 0)], "doc_id long, quality int")
    rows = site_quality.scored(docs, labels).collect()
    assert len(rows) == 4 and all(0 <= r["score"] <= 1 for r in rows)
    assert site_quality.scored(docs.limit(0), labels.limit(0)).collect() == []
