"""Token counts by merging ragged arrays of symbols rank by rank.

The pieces that a batch of texts has and that are not known yet lie in one flat
array of symbols with a boundary per piece. In each round every piece merges its
pair of lowest rank wherever it occurs, all pieces at once; what is left when
no pair has a rank is the number of tokens. Where the symbol that a merge makes has
pairs of lower rank, those come before the pair's next occurrence, so such a merge
is made at one place a round. Pieces of more than LONG symbols go rank by rank through
a linked array: only the places of the lowest rank and their neighbours are touched,
so a piece of a million letters takes seconds.

Edge cases: null and empty texts have no tokens and no bytes; a special token's
string inside a text is one token; a text of any length is counted whole.
"""

from __future__ import annotations

import heapq
import json
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark import SparkFiles
from pyspark.sql import DataFrame

from saldo.llm.arrays import small_batches
from saldo.llm.bpe_words import SPACE, Kept, byte_letters, shipped

# Fixed value: the pattern that the library splits byte-level texts by.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^" + SPACE + r"\p{L}\p{N}]+|[" + SPACE + "]+(?![^" + SPACE + "])|[" + SPACE + "]+"
#: A chunk is split by PATTERN just as the text around it would be.
CHUNKS = re.compile(f" ?[^{SPACE}]+|[{SPACE}]+(?![^{SPACE}])|[{SPACE}]+")


#: Pieces of more symbols are merged in a linked array.
LONG = 200
NEVER = np.iinfo(np.int64).max


def alternate(follows: np.ndarray) -> np.ndarray:
    """Of places in order, each of which may overlap the one before it, those that are merged: every other one of a run."""
    index = np.arange(len(follows))
    return (index - np.maximum.accumulate(np.where(follows, 0, index))) % 2 == 0


class RankMerger:
    """Counts symbols that survive the merges of one vocabulary file."""

    def __init__(self, path: str) -> None:
        spec = json.load(open(path, encoding="utf-8"))
        vocab, merges = spec["model"]["vocab"], spec["model"]["merges"]
        self.breaks = re.compile("|".join(map(re.escape, (t["content"] for t in spec["added_tokens"]))) or r"(?!)")
        self.first = np.array([vocab[c] for c in byte_letters()], np.int64)
        self.size = len(vocab)
        keys, made = [], []
        for a, b in (m if isinstance(m, list) else m.split(" ") for m in merges):
            keys.append(vocab[a] * self.size + vocab[b])
            made.append(vocab[a + b])
        order = np.argsort(np.array(keys, np.int64), kind="stable")
        self.keys, self.ranks, self.made = np.array(keys, np.int64)[order], order.astype(np.int64), np.array(made, np.int64)  # made: by rank
        # Ranks whose symbol is in a pair of lower rank.
        pairs = np.array(keys, np.int64)
        least = np.full(self.size, NEVER)
        np.minimum.at(least, pairs // self.size, np.arange(len(pairs)))
        np.minimum.at(least, pairs % self.size, np.arange(len(pairs)))
        self.early = least[self.made] < np.arange(len(pairs))
        self.pattern = regex.compile(PATTERN)
        self.pieces = Kept()
        self.chunks = Kept()

    def rank(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        key = left * self.size + right
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[at] == key, self.ranks[at], np.iinfo(np.int64).max)

    def count(self, pieces: list[bytes]) -> np.ndarray:
        """Tokens of each non-empty piece."""
        out = np.zeros(len(pieces), np.int64)
        for far, merge in ((False, self.by_rounds), (True, self.by_links)):
            own = [i for i, p in enumerate(pieces) if (len(p) > LONG) == far]
            if own:
                length = [len(pieces[i]) for i in own]
                out[own] = merge(self.first[np.frombuffer(b"".join([pieces[i] for i in own]), np.uint8)], np.repeat(np.arange(len(own)), length), len(own))
        return out

    def by_rounds(self, symbols: np.ndarray, owner: np.ndarray, n: int) -> np.ndarray:
        out = np.zeros(n, np.int64)
        while len(symbols):
            pairs = np.flatnonzero(owner[1:] == owner[:-1])
            ranks = np.full(len(symbols), NEVER)
            ranks[pairs] = self.rank(symbols[pairs], symbols[pairs + 1])
            heads = np.flatnonzero(np.append(True, owner[1:] != owner[:-1]))
            least = np.minimum.reduceat(ranks, heads)
            sizes = np.diff(np.append(heads, len(symbols)))
            over = least == NEVER
            out[owner[heads[over]]] = sizes[over]
            hit = np.flatnonzero((ranks == np.repeat(least, sizes)) & ~np.repeat(over, sizes))
            if len(hit):
                leftmost = np.append(True, owner[hit][1:] != owner[hit][:-1])
                hit = hit[leftmost | ~self.early[ranks[hit]]]
                hit = hit[alternate(np.append(False, hit[1:] == hit[:-1] + 1))]
            symbols = symbols.copy()
            symbols[hit] = self.made[ranks[hit]]
            keep = ~np.repeat(over, sizes)
            keep[hit + 1] = False
            symbols, owner = symbols[keep], owner[keep]
        return out

    def by_links(self, symbols: np.ndarray, owner: np.ndarray, n: int) -> np.ndarray:
        symbols, size = symbols.copy(), len(symbols)
        # One place more than there are symbols stands for the end of every piece.
        after, before = np.arange(1, size + 1), np.arange(-1, size)
        bounds = np.flatnonzero(owner[1:] != owner[:-1])
        after[bounds], before[bounds + 1] = size, -1
        ranks, waiting, heap = np.full(size + 1, NEVER), {}, []

        def wait(at: np.ndarray, rank: np.ndarray) -> None:
            order = np.argsort(rank, kind="stable")
            at, rank = at[order], rank[order]
            edges = np.flatnonzero(np.append(True, rank[1:] != rank[:-1]))
            for r, places in zip(rank[edges].tolist(), np.split(at, edges[1:]), strict=True):
                if r not in waiting:
                    waiting[r] = []
                    heapq.heappush(heap, r)
                waiting[r].append(places)

        def ranked(at: np.ndarray) -> None:
            right = after[at]
            at, right = at[right < size], right[right < size]
            new = self.rank(symbols[at], symbols[right])
            ranks[at] = new
            if (some := new < NEVER).any():
                wait(at[some], new[some])

        ranked(np.arange(size))
        while heap:
            r = heapq.heappop(heap)
            at = np.unique(np.concatenate(waiting.pop(r)))
            at = at[ranks[at] == r]
            if not len(at):
                continue
            if self.early[r]:
                leftmost = np.append(True, owner[at][1:] != owner[at][:-1])
                if not leftmost.all():
                    wait(at[~leftmost], np.full((~leftmost).sum(), r))
                at = at[leftmost]
            at = at[alternate(np.append(False, at[1:] == after[at[:-1]]))]
            right = after[at]
            symbols[at] = self.made[r]
            ranks[right] = ranks[at] = NEVER
            beyond = after[right]
            after[at] = beyond
            before[beyond[beyond < size]] = at[beyond < size]
            symbols[right] = -1
            left = before[at]
            left = left[left >= 0]
            # What stands before a merged place may itself be merged here; its pair is ranked anew all the same.
            left = left[symbols[left] >= 0]
            ranks[left] = NEVER
            ranked(np.unique(np.concatenate([left, at])))
        return np.bincount(owner[symbols >= 0], minlength=n)

    def learn(self, chunks: list[str]) -> dict[str, int]:
        """Token counts of chunks, whose unknown pieces are merged together."""
        split = {c: self.pattern.findall(c) for c in chunks}
        pieces = {p for ps in split.values() for p in ps}
        have = {p: self.pieces[p] for p in pieces if self.pieces.known(p)}
        new = [p for p in pieces if p not in have]
        if new:
            have |= zip(new, self.count([p.encode() for p in new]).tolist(), strict=True)
            for p in new:
                self.pieces.put(p, have[p])
        return {c: sum([have[p] for p in ps]) for c, ps in split.items()}

    def totals(self, texts: list[str | None]) -> list[int]:
        """Tokens of each text."""
        parts = []
        for text in texts:
            cut = self.breaks.split(text or "")
            parts.append((len(cut) - 1, [c for p in cut for c in CHUNKS.findall(p)]))
        kept, old = self.chunks, self.chunks.old
        every = set().union(*(chunks for _, chunks in parts))
        fresh = self.learn([c for c in every if c not in kept and c not in old])
        # Looked up before any is put away: putting one away may drop the older generation.
        known = {c: fresh[c] if c in fresh else kept[c] if c in kept else old[c] for c in every}
        out = [special + sum([known[c] for c in chunks]) for special, chunks in parts]
        for c in every:
            if c not in kept:
                kept.put(c, known[c])
        return out


@lru_cache(2)
def merger(path: str) -> RankMerger:
    return RankMerger(path)


def count(docs: DataFrame, path: str, limit: int = 1024, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: bytes, tokens, and whether there are more tokens than the limit."""
    small_batches(docs.sparkSession)
    name, kind = shipped(docs.sparkSession, path), docs.schema[id_col].dataType.simpleString()

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = merger(SparkFiles.get(name))
        for batch in batches:
            texts = batch.column(1).to_pylist()
            n = np.array(counter.totals(texts), np.int64)
            size = np.array([len(t.encode()) if t else 0 for t in texts], np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(size), pa.array(n), pa.array(n > limit)], names=["doc_id", "n_bytes", "n_tokens", "over_limit"])

    return docs.select(id_col, text_col).mapInArrow(scan, f"doc_id {kind}, n_bytes long, n_tokens long, over_limit boolean")
