"""Benchmark passages in documents by winnowing.

Of the hashes of k consecutive words, the smallest in every w consecutive ones is
a fingerprint, for items and documents alike. With k + w - 1 words in a window,
any shared window shares a fingerprint. Hits are extended to the windows around
them, which are compared whole. An item with fewer words than a window is a
window of its own, found by the hashes of all runs of that many words.

The items' windows go to every task while there are at most `broadcast_windows`
of them, which bounds what is broadcast; with more of them, the documents'
fingerprints are joined with the items', and the windows around hits in a second join.

Edge cases: null and empty texts have no words, so nothing hits them and as items
they hit nothing; repeated items each count; items that share a window all count;
an item of null id has the id ""; a document of null or repeated id has the results of
its own text.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from saldo.llm.arrays import Words, gram_hash, runs, sliding_min, small_batches, text_buffers
from saldo.llm.shared import staged

#: Words per window, words per hashed gram; a fingerprint is the least of WINDOW - GRAM + 1 grams.
WINDOW, GRAM = 10, 5
BROADCAST_WINDOWS = 2_000_000
#: Rows of one hash go to as many tasks.
SPREAD = 16


def word_bytes() -> np.ndarray:
    """Digits, letters and every byte of characters beyond ASCII."""
    table = np.zeros(256, bool)
    table[48:58] = table[97:123] = table[128:] = True
    return table


MEMBER = word_bytes()


def fingerprints(words: np.ndarray, window: int = WINDOW, gram: int = GRAM) -> np.ndarray:
    """Positions of the grams that winnowing selects in one text."""
    hashes = gram_hash(words, gram)
    width = window - gram + 1
    if len(hashes) < width:
        return np.zeros(0, np.int64)
    return np.flatnonzero(hashes == _spread(sliding_min(hashes, width), width))


def _spread(least: np.ndarray, width: int) -> np.ndarray:
    """For every position the greatest of the window minima that cover it: equal to its own value if it is selected."""
    padded = np.concatenate([np.zeros(width - 1, np.uint64), least, np.zeros(width - 1, np.uint64)])
    return ~sliding_min(~padded, width)


@dataclass
class Index:
    """Windows of the items by length: their hashes in order and the items that hold each."""

    prints: np.ndarray
    windows: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]]
    items: list[str]


def item_windows(ids: list[str], column: pa.Array, window: int = WINDOW, gram: int = GRAM) -> Index:
    data, offsets = text_buffers(column)
    prints, by_length = [], {}
    words = Words(data, offsets, MEMBER)
    for i in range(len(ids)):
        own = words.hashes[words.bounds[i] : words.bounds[i + 1]]
        n = min(len(own), window)
        if n:
            hashes, holder = by_length.setdefault(n, ([], []))
            grams = gram_hash(own, n)
            hashes.append(grams)
            holder.append(np.full(len(grams), i, np.int64))
            if n == window:
                prints.append(gram_hash(own, gram)[fingerprints(own, window, gram)])
    windows = {}
    for n, (hashes, holder) in by_length.items():
        pairs = np.unique(np.rec.fromarrays([np.concatenate(hashes), np.concatenate(holder)], names="h,i"))
        keys, first = np.unique(pairs.h, return_index=True)
        windows[n] = (keys, np.append(first, len(pairs)), pairs.i.copy())
    return Index(np.unique(np.concatenate(prints)) if prints else np.zeros(0, np.uint64), windows, ids)


def among(values: np.ndarray, ordered: np.ndarray) -> np.ndarray:
    """Index of each value in the ordered array, or -1."""
    if not len(ordered):
        return np.full(len(values), -1)
    at = np.minimum(np.searchsorted(ordered, values), len(ordered) - 1)
    return np.where(ordered[at] == values, at, -1)


def overlap(words: np.ndarray, index: Index, window: int = WINDOW, gram: int = GRAM, hits: np.ndarray | None = None) -> tuple[int, list[str]]:
    """(words hit, ids of the items that occur) for one text; hits: positions of its shared fingerprints, if known."""
    hit, found = np.zeros(len(words) + 1, np.int64), set()
    for n, (keys, first, holder) in index.windows.items():
        if n > len(words):
            continue
        if n < window:
            starts = np.arange(len(words) - n + 1)
            at = among(gram_hash(words, n), keys)
        else:
            if hits is None:
                places = fingerprints(words, window, gram)
                hits = places[among(gram_hash(words, gram)[places], index.prints) >= 0]
            if not len(hits):
                continue
            # Every window around a hit, compared whole.
            near = (hits[:, None] - np.arange(window - gram + 1)).ravel()
            starts = np.unique(near[(near >= 0) & (near <= len(words) - window)])
            spans = words[starts[:, None] + np.arange(window)].ravel()
            at = among(gram_hash(spans, window)[::window], keys)
        ok = at >= 0
        np.add.at(hit, starts[ok], 1)
        np.add.at(hit, starts[ok] + n, -1)
        for k in np.unique(at[ok]):
            found.update(holder[first[k] : first[k + 1]].tolist())
    return int((np.cumsum(hit)[:-1] > 0).sum()), sorted({index.items[i] for i in found})


SCHEMA = "n_words long, n_hit long, n_items long, items_sha256 string, contaminated boolean"


def _results(ids: list, rows: list[tuple[int, int, list[str]]], kind: pa.DataType) -> pa.RecordBatch:
    words, hit, items = zip(*rows, strict=True) if rows else ((), (), ())
    sha = [hashlib.sha256(",".join(i).encode()).hexdigest() for i in items]
    columns = [pa.array(ids, kind), pa.array(words, pa.int64()), pa.array(hit, pa.int64()), pa.array([len(i) for i in items], pa.int64()), pa.array(sha, pa.string()), pa.array([h > 0 for h in hit], pa.bool_())]
    return pa.RecordBatch.from_arrays(columns, names=["doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated"])


def _index(items: DataFrame, broadcast_windows: int) -> Broadcast | None:
    """The items' windows for every task, or None if there are too many."""
    # Words of an item are at most half its characters and one.
    bound = items.agg(F.sum(F.length("item_text") / 2 + 1)).first()[0] or 0
    if bound > broadcast_windows:
        return None
    table = items.toArrow().combine_chunks()
    return items.sparkSession.sparkContext.broadcast(item_windows(table["item_id"].to_pylist(), table["item_text"]))


def _items(benchmark: DataFrame) -> DataFrame:
    return benchmark.select(F.coalesce(F.col("item_id").cast("string"), F.lit("")).alias("item_id"), F.col("text").alias("item_text"))


def _batch_overlaps(column: pa.Array, index: Index) -> list[tuple[int, int, list[str]]]:
    data, offsets = text_buffers(column)
    rows = []
    for first, last in runs(offsets):
        part = offsets[first : last + 1]
        words = Words(data[part[0] : part[-1]], part - part[0], MEMBER)
        rows += _run_overlaps(words, index)
    return rows


def scan_windows(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", broadcast_windows: int = BROADCAST_WINDOWS) -> DataFrame:
    """One row per document: its words, the words that items' windows cover, and the items."""
    small_batches(docs.sparkSession)
    items = _items(benchmark)
    kind = docs.schema[id_col].dataType.simpleString()
    index = _index(items, broadcast_windows)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = _batch_overlaps(batch.column(1), index.value) if index else _own_overlaps(*batch.columns[1:])
            yield _results(batch.column(0).to_pylist(), rows, batch.schema.field(0).type)

    whole = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    return (whole if index else _joined(whole, items)).mapInArrow(scan, f"doc_id {kind}, {SCHEMA}")


def _run_overlaps(words: Words, index: Index) -> list[tuple[int, int, list[str]]]:
    """Results of a run of texts; fingerprints are looked up for all of them at once."""
    counts, rows = np.diff(words.bounds), []
    short = [n for n in index.windows if n < WINDOW]
    # Grams that span two texts are told apart by their text; winnowing within a text sees only its own.
    grams = gram_hash(words.hashes, GRAM)
    known = np.flatnonzero(among(grams, index.prints) >= 0)
    text_of = np.searchsorted(words.bounds, known, side="right") - 1
    touched = set(text_of[known + GRAM <= words.bounds[text_of + 1]].tolist()) if len(known) else set()
    for n in short:
        at = np.flatnonzero(among(gram_hash(words.hashes, n), index.windows[n][0]) >= 0)
        touched.update((np.searchsorted(words.bounds, at, side="right") - 1).tolist())
    for i, n in enumerate(counts.tolist()):
        rows.append((n, *(overlap(words.hashes[words.bounds[i] : words.bounds[i + 1]], index) if i in touched else (0, []))))
    return rows


def _own_overlaps(texts: pa.Array, spans: pa.Array, items: pa.Array) -> list[tuple[int, int, list[str]]]:
    """Results of texts that each come with the windows found in it and the items that hold them."""
    data, offsets = text_buffers(texts)
    words = Words(data, offsets, MEMBER)
    rows = []
    for n, found, ids in zip(np.diff(words.bounds).tolist(), spans.to_pylist(), items.to_pylist(), strict=True):
        hit = np.zeros(n + 1, np.int64)
        for span in found or []:
            starts = np.array(span["starts"], np.int64)
            np.add.at(hit, starts, 1)
            np.add.at(hit, starts + span["words"], -1)
        rows.append((n, int((np.cumsum(hit)[:-1] > 0).sum()), sorted(ids or [])))
    return rows


def _item_marks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(words, hash, whether it is a fingerprint or a window) of items; a short item's only window is its fingerprint too."""
    for batch in batches:
        data, offsets = text_buffers(batch.column(1))
        words = Words(data, offsets, MEMBER)
        for i, item in enumerate(batch.column(0).to_pylist()):
            w = words.hashes[words.bounds[i] : words.bounds[i + 1]]
            n = min(len(w), WINDOW)
            if n:
                windows = np.unique(gram_hash(w, n))
                prints = np.unique(gram_hash(w, GRAM)[fingerprints(w)]) if n == WINDOW else windows
                hashes = np.concatenate([windows, prints]).view(np.int64)
                marked = np.arange(len(hashes)) >= len(windows)
                yield pa.RecordBatch.from_arrays([pa.array([item] * len(hashes), pa.string()), pa.array(np.full(len(hashes), n, np.int32)), pa.array(hashes), pa.array(marked)], names=["item", "words", "hash", "print"])


def _doc_marks(w: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(fingerprints, start of the first window around each, hashes of the windows around all of them, how many each has)."""
    windows = gram_hash(w, n)
    if n < WINDOW:
        return windows, np.arange(len(windows)), windows, np.ones(len(windows), np.int64)
    places = fingerprints(w)
    near = places[:, None] - np.arange(WINDOW - GRAM, -1, -1)
    inside = (near >= 0) & (near < len(windows))
    return gram_hash(w, GRAM)[places], np.maximum(places - (WINDOW - GRAM), 0), windows[near[inside]], inside.sum(axis=1)


def _salted(df: DataFrame, *by: str) -> DataFrame:
    return df.withColumn("salt", F.pmod(F.xxhash64(*by), F.lit(SPREAD)).cast("int"))


def _for_each_salt(df: DataFrame) -> DataFrame:
    return df.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SPREAD - 1))))


def _joined(docs: DataFrame, items: DataFrame) -> DataFrame:
    """The documents with the windows found in each (spans) and the ids of the items that hold them, for items of any number.

    Fingerprints meet in a semi-join; the windows around those that are shared are compared in a
    second join. Rows of one hash are spread over SPREAD tasks. No item's text is moved: a
    document gathers starts of windows, of which it has fewer than ten a word, and the ids that its result is made of.
    """
    docs = docs.withColumn("key", F.sha2(F.concat(F.coalesce(F.col("id").cast("string"), F.lit("")), F.lit("\0"), F.coalesce("text", F.lit(""))), 256))
    # Copies of an item are looked for once.
    named = items.where("item_text is not null").select(F.sha2("item_text", 256).alias("item"), "item_id", "item_text")
    marks = named.select("item", "item_text").dropDuplicates(["item"]).mapInArrow(_item_marks, "item string, words int, hash long, print boolean")
    prints = marks.where("print").select("words", "hash").distinct()
    windows = marks.where("not print").select("words", F.col("hash").alias("window"), "item")
    # Lengths of windows: at most WINDOW of them.
    lengths = sorted(r[0] for r in marks.select("words").distinct().collect())

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = text_buffers(batch.column(1))
            words, keys = Words(data, offsets, MEMBER), batch.column(0).to_pylist()
            for n in lengths:
                out: list[list] = [[], [], [], [], []]
                for i, key in enumerate(keys):
                    w = words.hashes[words.bounds[i] : words.bounds[i + 1]]
                    if len(w) >= n:
                        for values, more in zip(out, (np.full(len((m := _doc_marks(w, n))[0]), i), *m), strict=True):
                            values.append(more)
                if out[0]:
                    own, hashes, first, near, many = (np.concatenate(x) for x in out)
                    around = pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(many)), pa.int32()), pa.array(near.view(np.int64)))
                    columns = [pa.array(keys, pa.string()).take(pa.array(own)), pa.array(np.full(len(own), n, np.int32)), pa.array(hashes.view(np.int64)), pa.array(first, pa.int64()), around]
                    yield pa.RecordBatch.from_arrays(columns, names=["key", "words", "hash", "first", "around"])

    by_doc = docs.select("key", "text").mapInArrow(scan, "key string, words int, hash long, first long, around array<long>")
    shared = _salted(by_doc, "key", "first").join(_for_each_salt(prints), ["words", "hash", "salt"], "left_semi")
    near = shared.select("key", "words", "first", F.posexplode("around").alias("step", "window"))
    starts = near.groupBy("key", "words", "window").agg(F.collect_set(F.col("first") + F.col("step")).alias("starts"))
    found = staged(_salted(starts, "key").join(_for_each_salt(windows), ["words", "window", "salt"]).select("key", "words", "starts", "item"))
    spans = found.groupBy("key").agg(F.collect_set(F.struct("words", "starts")).alias("spans"))
    holders = _salted(found.select("key", "item").distinct(), "key").join(_for_each_salt(named.select("item", "item_id").distinct()), ["item", "salt"])
    told = spans.join(holders.groupBy("key").agg(F.collect_set("item_id").alias("items")), "key")
    return docs.join(told, "key", "left").select(*[c for c in docs.columns if c != "key"], "spans", "items")


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, most_hit: int = 0, broadcast_windows: int = BROADCAST_WINDOWS) -> DataFrame:
    """Documents of which at most `most_hit` words lie in an item's window, with their own columns; each row goes by its own text."""
    small_batches(docs.sparkSession)
    items = _items(benchmark)
    index = _index(items, broadcast_windows)
    whole = docs.select(F.col("doc_id").alias("id"), "text", F.struct("*").alias("row"))

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = _batch_overlaps(batch.column(0), index.value) if index else _own_overlaps(batch.column(0), *batch.columns[2:])
            yield batch.select([1]).filter(pa.array([hit <= most_hit for _, hit, _ in rows], pa.bool_()))

    found = whole.select("text", "row") if index else _joined(whole, items).select("text", "row", "spans", "items")
    return found.mapInArrow(scan, whole.select("row").schema).select("row.*")
