"""Alignment of the tokens of two tokenizers: groups between common ends, links between overlapping tokens.

Texts are tokenised in Python, a few MB at a time; a chunk of text that begins with white space
and ends before the next is tokenised once. Each token is kept by its id and the byte at which
it ends. From there on there are only higher-order functions: of each different chunk,
`array_intersect` of the two arrays of ends cuts the groups; with the number of the token of each
byte, one look tells which tokens lie around an end, so the arrays are built in time that grows
with the text. Between two neighbouring ends of either tokenizer there is exactly one pair of
tokens that overlap, and each overlapping pair has exactly one such stretch: those pairs are the
links. Documents are put together from their chunks, at whose ends both tokenizers end.

The pairs of all documents are counted by a grouped aggregate that combines before the
shuffle. A pair's count goes back to each link by a broadcast if there are at most
BROADCAST_PAIRS pairs, which is counted first, and by a shuffled join beyond.

Edge cases: null and empty texts, and texts that one of the tokenizers does not give back byte
for byte (such as those with U+2581), have no tokens: zeros and an empty string. Repeated rows
are documents of their own and count as such. Ties for an id's highest count are all best. An
empty table gives an empty result. Other columns are not read, whatever their names.
A text of any length is taken whole; one task holds its arrays.
"""

from __future__ import annotations

import json
import re
from collections.abc import Callable, Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import public_tokenizers
import pyarrow as pa
import sentencepiece
import tiktoken
from pyspark import SparkFiles
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from saldo.llm.arrays import small_batches
from saldo.llm.bpe_words import SPACE, byte_letters, shipped
from saldo.llm.shared import forget, staged

#: Counts of pairs are broadcast up to so many (about 24 bytes each); more are joined by a shuffle.
BROADCAST_PAIRS = 1_000_000
#: A pair of ids is one number: the first id times this, and the second.
WIDTH = 1 << 31
SPACES = re.compile(f"[{SPACE}]")
#: White space and what follows up to the next.
CHUNKS = re.compile(f"[{SPACE}]*[^{SPACE}]+|[{SPACE}]+")


class ByteLevel:
    """Ids of a byte-level vocabulary file, and the bytes of each id; special strings are plain text."""

    def __init__(self, path: str) -> None:
        spec = json.load(open(path, encoding="utf-8"))
        byte_of = {c: b for b, c in enumerate(byte_letters())}
        vocab = spec["model"]["vocab"]
        special = {t["content"] for t in spec["added_tokens"]}
        ranks = {bytes(map(byte_of.__getitem__, token)): i for token, i in vocab.items() if token not in special}
        merged = [vocab["".join(m if isinstance(m, list) else m.split(" "))] for m in spec["model"]["merges"]]
        self.bytes_of = [b""] * (max(vocab.values()) + 1)
        for token, i in ranks.items():
            self.bytes_of[i] = token
        if merged == sorted(merged) and len(set(ranks.values())) == len(ranks) and len(merged) + 256 == len(ranks):
            # Ids in the order of merges are ranks, so the quicker library gives the same ids.
            self.encode = tiktoken.Encoding("a", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={}).encode_ordinary
        else:
            library = Tokenizer.from_file(path)
            library.encode_special_tokens = True
            library.no_truncation()
            library.no_padding()
            self.encode = lambda text: library.encode(text, add_special_tokens=False).ids


class Pieces:
    """Ids of a sentencepiece model, and the bytes of each id."""

    def __init__(self, path: str) -> None:
        model = sentencepiece.SentencePieceProcessor(model_file=path)
        self.bytes_of = [bytes([int(p[3:5], 16)]) if model.is_byte(i) else p.replace("▁", " ").encode() for i, p in ((i, model.id_to_piece(i)) for i in range(model.get_piece_size()))]
        self.encode = lambda text: model.encode(text, num_threads=1)


def tokenizer(path: str) -> ByteLevel | Pieces:
    return Pieces(path) if path.endswith(".model") else ByteLevel(path)


class Cutter:
    """Texts as numbers of chunks, and each chunk's ids, ends and token of each byte by both tokenizers.

    Neither tokenizer has a token across the place where white space begins, so texts are cut
    there and equal chunks are tokenised once. Texts with a character that breaks this rule (a
    piece has it after one that is no white space) are one chunk each.
    """

    #: Ids that a task keeps before it starts anew, and characters that are tokenised in one go.
    KEPT, RUN = 1_000_000, 2_000

    def __init__(self, a_path: str, b_path: str) -> None:
        self.tools = [tokenizer(a_path), tokenizer(b_path)]
        self.sizes = [np.array([len(x) for x in t.bytes_of], np.int32) for t in self.tools]
        odd = {c for t in self.tools for x in t.bytes_of for c in re.findall(f"(?<=[^{SPACE}])[{SPACE}]", x.decode(errors="ignore"))}
        self.odd = re.compile(f"[{''.join(map(re.escape, odd))}]" if odd else r"(?!)")
        self.begin()

    def begin(self) -> None:
        self.known: dict[str, int] = {}
        self.ids, self.bounds = [np.zeros(0, np.int32)] * 2, [np.zeros(1, np.int64)] * 2

    def encoded(self, text: str) -> list[np.ndarray] | None:
        """Ids of a text that begins with a space, by either tokenizer; None unless both cover its bytes."""
        whole, out = text.encode(), []
        for tool, said in zip(self.tools, (text, text[1:]), strict=True):
            ids = tool.encode(said)
            if b"".join([tool.bytes_of[i] for i in ids]) != whole:
                return None
            out.append(np.array(ids, np.int32))
        return out

    def learn(self, chunks: list[str]) -> list[tuple[list[str], list[np.ndarray], list[np.ndarray]]]:
        """Chunks that begin with white space, tokenised in one text: each run's ids and the chunks' bounds in them; a chunk that is not covered has no ids."""
        ids = self.encoded(" x" + "".join(chunks))
        if ids is None and len(chunks) > 1:
            half = len(chunks) // 2
            return self.learn(chunks[:half]) + self.learn(chunks[half:])
        if ids is None:
            return [(chunks, [np.zeros(0, np.int32)] * 2, [np.zeros(1, np.int64)] * 2)]
        ends = np.cumsum([2, *[len(c.encode()) for c in chunks]])
        cuts = [np.searchsorted(np.cumsum(size[own]), ends) + 1 for size, own in zip(self.sizes, ids, strict=True)]
        return [(chunks, [own[c[0] :] for own, c in zip(ids, cuts, strict=True)], [c[1:] - c[0] for c in cuts])]

    def learn_all(self, chunks: set[str]) -> None:
        alone = [c for c in chunks if len(c) > self.RUN or SPACES.match(c[-1]) or self.odd.search(c)]
        runs, size = [[c] for c in alone] + [[]], 0
        for c in chunks.difference(alone):
            if size > self.RUN:
                runs.append([])
                size = 0
            runs[-1].append(c)
            size += len(c)
        told = [x for run in runs if run for x in self.learn(run)]
        self.known.update(zip([c for x in told for c in x[0]], range(len(self.known), len(self.known) + len(chunks)), strict=True))
        for side in (0, 1):
            parts, first = [self.bounds[side]], self.bounds[side][-1]
            for _, ids, bounds in told:
                parts.append(first + bounds[side])
                first += len(ids[side])
            self.bounds[side] = np.concatenate(parts)
            self.ids[side] = np.concatenate([self.ids[side], *[x[1][side] for x in told]])

    def cut(self, texts: list[str | None]) -> tuple[list[np.ndarray], list[tuple[np.ndarray, ...]], np.ndarray]:
        """Each text's numbers of chunks; by side the chunks' sizes in tokens, ids, ends, bytes and token of each byte; which chunks are covered."""
        if max(map(len, self.ids)) > self.KEPT:
            self.begin()
        chunks = [[] if not t else [" " + t] if self.odd.search(t) else CHUNKS.findall(" " + t) for t in texts]
        flat = list(chain.from_iterable(chunks))
        if fresh := set(flat).difference(self.known):
            self.learn_all(fresh)
        own, numbers = np.unique(np.fromiter(map(self.known.__getitem__, flat), np.int64, len(flat)), return_inverse=True)
        numbers, sides = np.split(numbers.astype(np.int32), np.cumsum([len(x) for x in chunks])[:-1]), []
        for ids, bounds, sizes in zip(self.ids, self.bounds, self.sizes, strict=True):
            start = bounds[own]
            n = bounds[own + 1] - start
            ids = ids[ragged(start, n)]
            length = sizes[ids]
            total, after = np.concatenate([[0], np.cumsum(length, dtype=np.int64)]), np.cumsum(n)
            size = total[after] - total[after - n]
            ends = total[1:] - np.repeat(total[after - n], n)
            sides.append((n, ids, ends.astype(np.int32), size, np.repeat(ragged(np.zeros(len(n), np.int64), n), length).astype(np.int32)))
        return numbers, sides, sides[0][0] > 0


def ragged(start: np.ndarray, n: np.ndarray) -> np.ndarray:
    """start, start + 1, ..., n numbers for each start."""
    return np.arange(n.sum()) + np.repeat(start - (np.cumsum(n) - n), n)


@lru_cache(2)
def cutter(a_path: str, b_path: str) -> Cutter:
    return Cutter(a_path, b_path)


def lists(values: pa.Array, sizes: np.ndarray) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)), values)


def tokens(docs: DataFrame, a_path: str, b_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A row for each few MB of texts: `docs` has each text's id, tokens and numbers of chunks, `chunks` each different chunk's tokens by both tokenizers.

    A chunk has ids (`a`), their byte ends (`a_end`) and the token of each byte (`a_at`), and so for b.
    """
    small_batches(docs.sparkSession, 3)
    a_name, b_name = shipped(docs.sparkSession, a_path), shipped(docs.sparkSession, b_path)
    kind = docs.schema[id_col].dataType.simpleString()

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        both = cutter(SparkFiles.get(a_name), SparkFiles.get(b_name))
        for batch in batches:
            numbers, sides, covered = both.cut(batch.column(1).to_pylist())
            numbers = [x if covered[x].all() else x[:0] for x in numbers]
            sums = [pa.array([int(side[0][x].sum()) for x in numbers], pa.int64()) for side in sides]
            told = pa.StructArray.from_arrays([batch.column(0), *sums, lists(pa.array(np.concatenate([np.zeros(0, np.int32), *numbers])), [len(x) for x in numbers])], names=["doc_id", "n_a", "n_b", "at"])
            fields = [lists(pa.array(values), sizes) for n, ids, ends, size, at in sides for values, sizes in ((ids, n), (ends, n), (at, size))]
            chunks = pa.StructArray.from_arrays(fields, names=["a", "a_end", "a_at", "b", "b_end", "b_at"])
            yield pa.RecordBatch.from_arrays([lists(told, [len(told)]), lists(chunks, [len(chunks)])], names=["docs", "chunks"])

    ints = ", ".join(f"{c}: array<int>" for c in ("a", "a_end", "a_at", "b", "b_end", "b_at"))
    return docs.select(id_col, text_col).mapInArrow(scan, f"docs array<struct<doc_id: {kind}, n_a: bigint, n_b: bigint, at: array<int>>>, chunks array<struct<{ints}>>")


def let(value: Column, then: Callable[[Column], Column]) -> Column:
    """`then` of a value that is computed once, however often `then` looks at it."""
    return F.transform(F.array(value), then)[0]


def sides(ids: Column, end: Column, other: Column) -> Column:
    """The ids of each group as text, and an empty one at the end; `other` has the other tokenizer's token of each byte.

    An id's last digit is followed by 1 where its group ends and by 2 elsewhere, so that numbers
    become text all at once.
    """
    inside = lambda e: F.get(other, e) == F.get(other, e - 1)
    told = F.zip_with(ids, end, lambda i, e: i * 10 + F.when(inside(e), 2).otherwise(1))
    joined = F.concat(F.array_join(told.cast("array<string>"), ","), F.lit(","))
    return F.split(F.replace(F.replace(joined, F.lit("1,"), F.lit("|")), F.lit("2,"), F.lit(",")), "[|]")


def chunk_aligned(c: Column) -> Column:
    """Of a chunk's tokens: the number of groups, the groups as text, the links, one number a pair."""
    pair = lambda e: F.get(c.a, F.get(c.a_at, e - 1)).cast("long") * WIDTH + F.get(c.b, F.get(c.b_at, e - 1))

    def described(ends: Column) -> Column:
        pairs = F.zip_with(sides(c.a, c.a_end, c.b_at), sides(c.b, c.b_end, c.a_at), lambda x, y: F.concat(x, F.lit("|"), y))
        links = F.transform(F.array_union(c.a_end, c.b_end), pair)
        return F.struct(F.size(ends).alias("n"), F.array_join(F.slice(pairs, 1, F.size(ends)), ";").alias("text"), links.alias("links"))

    def one_to_one(ends: Column) -> Column:
        text = F.array_join(F.zip_with(c.a, c.b, lambda x, y: F.concat(x.cast("string"), F.lit("|"), y.cast("string"))), ";")
        links = F.zip_with(c.a, c.b, lambda x, y: x.cast("long") * WIDTH + y)
        return F.struct(F.size(ends).alias("n"), text.alias("text"), links.alias("links"))

    all_alone = lambda ends: (F.size(ends) == F.size(c.a)) & (F.size(ends) == F.size(c.b))
    return let(F.array_intersect(c.a_end, c.b_end), lambda ends: F.when(all_alone(ends), one_to_one(ends)).otherwise(described(ends)))


def aligned(cut: DataFrame) -> DataFrame:
    """Of `tokens`: each text's id, counts, groups as a string `a1,a2|b1;a3|b2,b3`, and links."""

    def described(d: Column, known: Column) -> Column:
        n_groups = F.aggregate(d["at"], F.lit(0).cast("long"), lambda sum, i: sum + F.get(known, i).n)
        text = F.array_join(F.transform(d["at"], lambda i: F.get(known, i).text), ";")
        links = F.flatten(F.transform(d["at"], lambda i: F.get(known, i).links))
        return F.struct(d.doc_id.alias("doc_id"), d.n_a.alias("n_a"), d.n_b.alias("n_b"), n_groups.alias("n_groups"), text.alias("groups"), links.alias("links"))

    told = let(F.transform("chunks", chunk_aligned), lambda known: F.transform("docs", lambda d: described(d, known)))
    return cut.select(F.inline(told))


def pair_counts(links: DataFrame) -> DataFrame:
    """(pair, n_docs, best) of a table with an array `links` a document: documents that hold the pair, and whether none of its first id has more."""
    pairs = links.select(F.explode(F.array_distinct("links")).alias("pair")).groupBy("pair").agg(F.count("*").alias("n_docs"))
    pairs = staged(pairs)
    first = (F.col("pair") / WIDTH).cast("long")
    most = pairs.groupBy(F.floor(first).alias("_a")).agg(F.max("n_docs").alias("_most"))
    out = staged(pairs.withColumn("_a", F.floor(first)).join(most, "_a").select("pair", "n_docs", (F.col("n_docs") == F.col("_most")).alias("best")))
    forget(pairs)
    return out


def align(docs: DataFrame, a_path: str, b_path: str, id_col: str = "doc_id", text_col: str = "text", keep_groups: bool = False) -> DataFrame:
    """One row per input row: tokens, groups and links, how many links are their first id's most frequent, the sum of the links' counts."""
    told = aligned(tokens(docs, a_path, b_path, id_col, text_col))
    groups = F.when(F.col("n_a") > 0, F.sha2("groups", 256)).otherwise("").alias("groups_sha256")
    row = F.monotonically_increasing_id().alias("_row")
    kept = staged(told.select(row, "doc_id", "n_a", "n_b", "n_groups", F.size("links").cast("long").alias("n_links"), groups, "links", *["groups"] * keep_groups))
    counts = pair_counts(kept)
    if counts.count() <= BROADCAST_PAIRS:
        counts = F.broadcast(counts)
    links = kept.select("_row", F.explode("links").alias("pair")).join(counts, "pair")
    sums = links.groupBy("_row").agg(F.sum(F.col("best").cast("long")).alias("n_best"), F.sum("n_docs").alias("count_sum"))
    out = kept.drop("links").join(sums, "_row", "left")
    zero = lambda c: F.coalesce(c, F.lit(0).cast("long")).alias(c)
    return out.select("doc_id", "n_a", "n_b", "n_groups", "n_links", zero("n_best"), zero("count_sum"), "groups_sha256", *["groups"] * keep_groups)
