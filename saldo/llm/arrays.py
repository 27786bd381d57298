"""Numpy helpers over the bytes of an Arrow string column, used inside Spark tasks."""

from __future__ import annotations

import os
from collections.abc import Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

U64 = np.uint64
ROOT = str(Path(__file__).resolve().parents[2])
#: Odd base of the polynomial hash modulo 2**64, its inverse, and the mixing constants.
BASE = 0x9E3779B97F4A7C15 | 1
INVERSE = pow(BASE, -1, 1 << 64)
MIX_A, MIX_B = 0xBF58476D1CE4E5B9, 0x94D049BB133111EB
#: Texts are handled in runs of about so many bytes, so that the arrays stay in cache.
RUN_BYTES = 1 << 20


def text_buffers(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and row offsets of a string column; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = pc.fill_null(column.cast(pa.large_string()), "")
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(column.buffers()[2] or b"", np.uint8)[offsets[0] : offsets[-1]]
    return data, offsets - offsets[0]


def runs(offsets: np.ndarray, limit: int = RUN_BYTES) -> Iterator[tuple[int, int]]:
    """Row ranges of about `limit` bytes; a longer text is a range of its own."""
    first, rows = 0, len(offsets) - 1
    while first < rows:
        last = int(np.searchsorted(offsets, offsets[first] + limit, side="right")) - 1
        last = min(max(last, first + 1), rows)
        yield first, last
        first = last


def mix(x: np.ndarray) -> np.ndarray:
    """Finaliser that spreads every input bit over all 64 bits."""
    x = (x ^ (x >> U64(30))) * U64(MIX_A)
    x = (x ^ (x >> U64(27))) * U64(MIX_B)
    return x ^ (x >> U64(31))


class Powers:
    """Powers of the hash base and of its inverse, grown on demand."""

    def __init__(self) -> None:
        self._up = self._down = np.ones(1, U64)

    def upto(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self._up) < n:
            n = max(n, 2 * RUN_BYTES)
            step = np.full(n, BASE, U64)
            step[0] = 1
            back = np.full(n, INVERSE, U64)
            back[0] = 1
            self._up, self._down = np.multiply.accumulate(step), np.multiply.accumulate(back)
        return self._up, self._down


POWERS = Powers()


def prefix_hash(data: np.ndarray) -> np.ndarray:
    """prefix_hash(d)[j] - prefix_hash(d)[i] is the hash of d[i:j], times base**i."""
    up, _ = POWERS.upto(len(data) + 1)
    out = np.zeros(len(data) + 1, U64)
    np.cumsum((data.astype(U64) + U64(1)) * up[: len(data)], out=out[1:])
    return out


def span_hash(prefix: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Mixed 64-bit hashes of the spans; equal bytes give equal hashes wherever they stand."""
    _, down = POWERS.upto(len(prefix))
    return mix((prefix[end] - prefix[start]) * down[start] + (end - start).astype(U64) * U64(MIX_A))


def window_hash(prefix: np.ndarray, n: int) -> np.ndarray:
    """span_hash of every n consecutive bytes."""
    _, down = POWERS.upto(len(prefix))
    return mix((prefix[n:] - prefix[:-n]) * down[: len(prefix) - n] + U64(n * MIX_A & (1 << 64) - 1))


def lower_table() -> np.ndarray:
    table = np.arange(256, dtype=np.uint8)
    table[65:91] += 32
    return table


LOWER = lower_table()


class Words:
    """Words of a run of texts: `hashes` of the lower-cased words and `bounds[i]:bounds[i+1]` for text i."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, member: np.ndarray) -> None:
        data = LOWER[data]
        inside = member[data]
        before = np.zeros(len(data), bool)
        before[1:] = inside[:-1]
        heads = offsets[:-1][offsets[:-1] < len(data)]
        before[heads] = False
        after = np.zeros(len(data), bool)
        after[:-1] = inside[1:]
        tails = offsets[1:][offsets[1:] > 0] - 1
        after[tails] = False
        start = np.flatnonzero(inside & ~before)
        end = np.flatnonzero(inside & ~after) + 1
        self.hashes = span_hash(prefix_hash(data), start, end)
        self.bounds = np.searchsorted(start, offsets)


def gram_hash(words: np.ndarray, n: int) -> np.ndarray:
    """Hashes of all runs of n consecutive word hashes."""
    count = len(words) - n + 1
    if count <= 0:
        return np.zeros(0, U64)
    out = np.zeros(count, U64)
    for j in range(n):
        out += mix(words[j : j + count] + U64(j)) * U64(pow(BASE, j + 1, 1 << 64))
    return mix(out + U64(n))


def sliding_min(x: np.ndarray, width: int) -> np.ndarray:
    """Minimum of every `width` consecutive values."""
    out, have = x, 1
    while have < width:
        step = min(have, width - have)
        out = np.minimum(out[: len(out) - step], out[step:])
        have += step
    return out


def small_batches(spark, mbytes: int = 4) -> None:
    """Bound what one Arrow batch to a Python worker holds, as texts may be long; let workers find this package."""
    paths = spark.sparkContext.environment.get("PYTHONPATH", "")
    if ROOT not in paths.split(os.pathsep):
        spark.sparkContext.environment["PYTHONPATH"] = os.pathsep.join(filter(None, (ROOT, paths)))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(mbytes << 20))
