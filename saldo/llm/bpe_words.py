"""Exact byte-pair encoding and decoding by dynamic programming over prefixes.

For every prefix of a piece there is exactly one token that can end its
encoding: a vocabulary entry that is a suffix of the prefix, and that stays apart
when merged with the last token of what stands before it. An automaton over the
vocabulary lists the suffixes, a memoised pair test decides, and back-pointers
from the whole piece give the ids.

Edge cases: null and empty texts give no ids; strings of the added special
tokens inside a text are those tokens; equal texts give equal results; a piece
of any length is encoded whole.
"""

from __future__ import annotations

import hashlib
import json
import re
import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import ahocorasick
import pyarrow as pa
import regex
from pyspark import SparkFiles
from pyspark.sql import DataFrame

from saldo.llm.arrays import small_batches

# The white space of Unicode, and the pieces that the vocabulary's file names.
SPACE = "\t-\r \x85\xa0  -     　"
PIECES = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^" + SPACE + r"\p{L}\p{N}]+"
END = "</w>"
#: The last symbol of a piece is another letter than the same byte inside it.
LAST = 0x1000
#: Encoded chunks that a worker keeps, in each of two generations.
KEPT = 100_000


@lru_cache(1)
def byte_letters() -> list[str]:
    """The printable character that stands for each byte in byte-level vocabularies."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    spare = iter(range(256, 512))
    return [chr(b if b in set(shown) else next(spare)) for b in range(256)]


class Kept(dict):
    """Results by key in two generations, so that memory is bounded and frequent keys stay."""

    def __init__(self, make=None, size: int = KEPT) -> None:
        super().__init__()
        self.make, self.size, self.old = make, size, {}

    def __missing__(self, key):
        value = self.old.get(key)
        return self.put(key, self.make(key) if value is None else value)

    def put(self, key, value):
        if len(self) >= self.size:
            self.old = dict(self)
            self.clear()
        self[key] = value
        return value

    def known(self, key) -> bool:
        return key in self or key in self.old


class PrefixEncoder:
    """Encoder for one vocabulary file with merges and a suffix for the end of a word."""

    def __init__(self, path: str) -> None:
        spec = json.load(open(path, encoding="utf-8"))
        model = spec["model"]
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.ids = {self.letters(token): i for token, i in model["vocab"].items()}
        self.token = {i: token for token, i in model["vocab"].items()} | {i: t for t, i in self.special.items()}
        self.rank = {}
        for r, (a, b) in enumerate(m if isinstance(m, list) else m.split(" ") for m in model["merges"]):
            self.rank.setdefault((self.letters(a), self.letters(b)), r)
        self.automaton = ahocorasick.Automaton()
        for word in self.ids:
            self.automaton.add_word(word, word)
        self.automaton.make_automaton()
        self.whole = Kept(lambda w: self.merge(w) == [w])
        self.apart = Kept(lambda ab: self.merge(ab[0] + ab[1]) == [ab[0], ab[1]], 4 * KEPT)
        self.pieces = regex.compile(PIECES)
        self.breaks = re.compile("|".join(map(re.escape, sorted(self.special, key=len, reverse=True))))
        self.chunk = Kept(self.encode_chunk)

    @staticmethod
    def letters(token: str) -> str:
        """A token as letters: its last symbol has a letter of its own if it ends a word."""
        if token.endswith(END) and len(token) > len(END):
            token = token[: -len(END)]
            return token[:-1] + chr(ord(token[-1]) + LAST)
        return token

    def merge(self, word: str) -> list[str]:
        """Tokens by repeated merging of the lowest rank; only for tokens and pairs of tokens."""
        parts = list(word)
        while len(parts) > 1:
            best = min(range(len(parts) - 1), key=lambda i: self.rank.get((parts[i], parts[i + 1]), 1 << 60))
            if (parts[best], parts[best + 1]) not in self.rank:
                break
            parts[best : best + 2] = [parts[best] + parts[best + 1]]
        return parts

    def encode_piece(self, word: str) -> list[str]:
        """Tokens of a piece in letters; last[i] is the one token that ends the prefix of length i."""
        last: list[str | None] = [None] * (len(word) + 1)
        for end, token in self.automaton.iter(word):
            if last[end + 1] is None:
                start = end + 1 - len(token)
                if self.whole[token] if not start else last[start] is not None and self.apart[last[start], token]:
                    last[end + 1] = token
        out, at = [], len(word)
        while at:
            if (token := last[at]) is None:
                return [t for t in self.merge(word) if t in self.ids]  # a byte that the vocabulary lacks
            out.append(token)
            at -= len(token)
        return out[::-1]

    def encode_chunk(self, chunk: str) -> tuple[str, str, int]:
        """Of a text without white space: its ids and its tokens, each joined by spaces, and their number."""
        letters, ids = byte_letters(), []
        for piece in self.pieces.findall(chunk):
            word = "".join([letters[b] for b in piece.encode()])
            ids += [self.ids[t] for t in self.encode_piece(word[:-1] + chr(ord(word[-1]) + LAST))]
        return " ".join(map(str, ids)), " ".join([self.token[i] for i in ids]), len(ids)

    @staticmethod
    def normal(text: str) -> str:
        if not text.isascii():
            text = unicodedata.normalize("NFC", text).replace("Σ", "σ")
        return text.lower()

    def encode(self, text: str | None) -> tuple[str, str, int]:
        """Ids and tokens of a text, each joined by spaces, and their number."""
        ids, tokens, n, at = [], [], 0, 0
        text = text or ""
        for stop in [*self.breaks.finditer(text), None]:
            part = self.normal(text[at : stop.start() if stop else len(text)])
            chunks = re.split(f"[{SPACE}]+", part) if re.search("[\x1c-\x1f]", part) else part.split()
            for i, t, k in map(self.chunk.__getitem__, chunks):
                if k:
                    ids.append(i)
                    tokens.append(t)
                    n += k
            if stop:
                ids.append(str(self.special[stop[0]]))
                tokens.append(stop[0])
                n += 1
                at = stop.end()
        return " ".join(ids), " ".join(tokens), n

    def decode(self, ids: str) -> str:
        """The text of joined ids: the file names no decoder, so tokens are joined by spaces."""
        return " ".join([self.token[int(i)] for i in ids.split()])


@lru_cache(2)
def encoder(path: str) -> PrefixEncoder:
    return PrefixEncoder(path)


def shipped(spark, path: str) -> str:
    """Give a vocabulary file to every executor; the name under which tasks find it."""
    if path not in getattr(spark, "_saldo_shipped", set()):
        spark.sparkContext.addFile(path)
        spark._saldo_shipped = getattr(spark, "_saldo_shipped", set()) | {path}
    return path.rsplit("/", 1)[-1]


def encode(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", keep_ids: bool = False) -> DataFrame:
    """One row per input row: number of tokens, digests of the ids and of the decoded text, the ids if asked for."""
    small_batches(docs.sparkSession)
    name, kind = shipped(docs.sparkSession, path), docs.schema[id_col].dataType.simpleString()

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = encoder(SparkFiles.get(name))
        for batch in batches:
            counts, ids_sha, text_sha, kept = [], [], [], []
            for text in batch.column(1).to_pylist():
                ids, tokens, n = coder.encode(text)
                counts.append(n)
                ids_sha.append(hashlib.sha256(ids.encode()).hexdigest())
                text_sha.append(hashlib.sha256(tokens.encode()).hexdigest())
                if keep_ids:
                    kept.append(ids)
            columns = [batch.column(0), pa.array(counts, pa.int64()), pa.array(ids_sha, pa.string()), pa.array(text_sha, pa.string())]
            names = ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
            if keep_ids:
                columns, names = [*columns, pa.array(kept, pa.string())], [*names, "ids"]
            yield pa.RecordBatch.from_arrays(columns, names=names)

    return docs.select(id_col, text_col).mapInArrow(scan, f"doc_id {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids string" * keep_ids)
