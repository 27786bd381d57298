"""Document fingerprints from content-defined chunks.

A gear hash over the last 16 bytes cuts a text where its low bits are zero:
six bits before a chunk's normal size and four after it, so that sizes stay near
the normal one (normalised chunking), never under 16 nor over 128 bytes. A cut
depends on nearby bytes only, so an edit moves the cuts beside it and no others.
The fingerprint is the set of chunk digests with their lengths; the likeness of
one to another is the share of its chunk bytes that the other has too.

Edge cases: null counts as empty; an empty text has the empty fingerprint, which
is like an empty one (1.0) and unlike any other (0.0); equal texts have equal
fingerprints; the next of the last document is the first, and a single document
is its own next; documents of equal doc_id follow one another in order of text;
null doc_ids come last.
"""

from __future__ import annotations

import hashlib
from bisect import bisect_left, bisect_right
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from saldo.llm.arrays import U64, mix, prefix_hash, runs, small_batches, span_hash, text_buffers

REACH, SMALLEST, NORMAL, LARGEST = 16, 16, 32, 128
HARD, EASY = np.uint32(0b111111 << 20), np.uint32(0b1111 << 20)
GEAR = (mix(np.arange(1, 257, dtype=U64)) >> U64(32)).astype(np.uint32)


def gear_hash(data: np.ndarray) -> np.ndarray:
    """Hash of the last REACH bytes at every position, by doubling the reach."""
    h, have = GEAR[data], 1
    while have < REACH:
        h[have:] += h[:-have] << np.uint32(have)
        have *= 2
    return h


def cuts(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts of all chunks of a run of texts (and its end), and the number of chunks before each text."""
    h = gear_hash(data)
    easy = (np.flatnonzero((h & EASY) == 0) + 1).tolist()
    hard = (np.flatnonzero((h & HARD) == 0) + 1).tolist()
    easy.append(1 << 62)
    hard.append(1 << 62)
    starts, counts = [], [0]
    for at, end in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True):
        while at < end:
            starts.append(at)
            cut = hard[bisect_left(hard, at + SMALLEST)]
            if cut >= at + NORMAL:
                cut = easy[bisect_left(easy, at + NORMAL)]
            at = min(cut, at + LARGEST, end)
        counts.append(len(starts))
    starts.append(int(offsets[-1]))
    return np.array(starts, np.int64), np.array(counts, np.int64)


def chunk_sets(texts: pa.Array) -> list[np.ndarray]:
    """For every text its chunks in order: the digest's 32 bits, then 8 bits of length."""
    data, offsets = text_buffers(texts)
    out: list[np.ndarray] = []
    for first, last in runs(offsets):
        part = offsets[first : last + 1] - offsets[first]
        own = data[offsets[first] : offsets[last]]
        starts, counts = cuts(own, part)
        size = np.diff(starts)
        digest = span_hash(prefix_hash(own), starts[:-1], starts[1:]) >> U64(32)
        value = digest << U64(8) | size.astype(U64)
        out += [np.unique(value[a:b]) for a, b in zip(counts[:-1].tolist(), counts[1:].tolist(), strict=True)]
    return out


def written(chunks: np.ndarray) -> str:
    """Ten hexadecimal digits a chunk, in order."""
    return chunks.astype(">u8").view(np.uint8).reshape(-1, 8)[:, 3:].tobytes().hex()


def weight(chunks: np.ndarray) -> int:
    return int((chunks & U64(255)).sum())


def likeness(one: np.ndarray, other: np.ndarray) -> float:
    """The share of one's chunk bytes that the other has."""
    if not len(one):
        return float(not len(other))
    return weight(np.intersect1d(one, other, assume_unique=True)) / weight(one)


#: Text that a range of ids holds, ids sampled for each range, and most ranges, whose bounds the driver holds; all concern balance only.
RANGE_BYTES, SAMPLED, MOST_RANGES = 8 << 20, 20, 100_000


def range_bounds(ids: DataFrame, ranges: int, rows: int) -> list:
    """Ids between ranges of about equal size, of any type that has an order, from a sample by hash."""
    if ranges < 2 or not rows:
        return []
    every = max(1, rows // (SAMPLED * ranges))
    found = sorted(r[0] for r in ids.where(f"id is not null and pmod(xxhash64(id), {every}) = 0").collect())
    return sorted({found[i * len(found) // ranges] for i in range(1, ranges)}) if found else []


def with_next(docs: DataFrame, id_col: str, text_col: str, ranges: int | None) -> DataFrame:
    """Documents dealt out in ranges of ids, in descending order, each range followed by the first of the next one.

    The number of ranges grows with the table, so that a task's share does not, up to MOST_RANGES
    (0.8 TB of text; a task of 100 TB has 2 GB); some ids for each range are all that comes to the driver.
    """
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    n = rows.count()
    if ranges is None:
        # Lengths alone are dealt out for this, not texts.
        each = rows.select(F.octet_length("text").alias("size")).limit(10_000).agg(F.avg("size")).first()[0] or 0
        ranges = min(MOST_RANGES, max(32, int(n * each) // RANGE_BYTES))
    bounds = range_bounds(rows.select("id"), ranges, n)

    def place(value) -> int:
        """Range of an id; null is in the first."""
        return 0 if value is None else bisect_right(bounds, value)

    @F.arrow_udf("int")
    def bucket(ids: pa.Array) -> pa.Array:
        return pa.array(map(place, ids.to_pylist()), pa.int32())

    ends = sorted(tuple(r) for r in rows.groupBy(bucket("id").alias("bucket")).agg(F.max("id").alias("top")).collect())
    # Where the first document of each range is repeated, to follow the last of the next one; the first range may hold null ids only.
    to = {top: ends[(i + 1) % len(ends)][0] for i, (_, top) in enumerate(ends)}

    @F.arrow_udf("array<int>")
    def places(ids: pa.Array) -> pa.Array:
        return pa.array([[place(i), to[i]] if i in to else [place(i)] for i in ids.to_pylist()], pa.list_(pa.int32()))

    dealt = rows.select("id", "text", F.posexplode(places("id")).alias("extra", "bucket")).select("bucket", (F.col("extra") > 0).alias("extra"), "id", "text")
    return dealt.repartition(max(8, ranges // 2), "bucket").sortWithinPartitions("bucket", "extra", F.col("id").desc_nulls_last(), "text")


SCHEMA = "n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"


def compare_with_edits(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", ranges: int | None = None) -> DataFrame:
    """Fingerprints of every text and of its edited text, and the likeness to it and to the next document's.

    The edited text has its last third replaced by the beginning of the next document in descending order of id.
    """
    small_batches(docs.sparkSession)
    kind = docs.schema[id_col].dataType.simpleString()

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        carry: list[tuple] = []
        for batch in batches:
            rows = carry + list(zip(*(batch.column(i).to_pylist() for i in range(3)), [t or "" for t in batch.column(3).to_pylist()], strict=True))
            sets = chunk_sets(pa.array([r[3] for r in rows], pa.string()))
            pairs = [i for i in range(len(rows) - 1) if not rows[i][1] and rows[i][0] == rows[i + 1][0]]
            edited = [t[: len(t) - len(t) // 3] + rows[i + 1][3][: len(t) // 3] for i in pairs for t in [rows[i][3]]]
            edited_sets = chunk_sets(pa.array(edited, pa.string()))
            columns = [
                pa.array([rows[i][2] for i in pairs], batch.schema.field(2).type),
                pa.array([len(rows[i][3]) for i in pairs], pa.int64()),
                pa.array([hashlib.sha256(e.encode()).hexdigest() for e in edited], pa.string()),
                pa.array([written(sets[i]) for i in pairs], pa.string()),
                pa.array([written(e) for e in edited_sets], pa.string()),
                pa.array([likeness(sets[i], e) for i, e in zip(pairs, edited_sets, strict=True)], pa.float64()),
                pa.array([likeness(sets[i], sets[i + 1]) for i in pairs], pa.float64()),
            ]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"])
            carry = [r for r in rows[-1:] if not r[1]]

    return with_next(docs, id_col, text_col, ranges).mapInArrow(scan, f"doc_id {kind}, {SCHEMA}")
