"""Toxicity scores from subword bags.

A word's vector is the mean of the vectors of its character n-grams (with marks at
its edges) and of the word; a linear softmax on it gives the word's evidence.
Vectors and softmax are trained together in numpy, first on words that stand for
their documents' labels, then with each toxic document speaking through the words
that score highest. A document's score is a logistic function of what that softmax
says of its averaged bag and of its three strongest words, and of how many different
words it has, fitted on documents that the vectors have not seen: a few words make a
long text toxic, which its average hides, but the more words a text has, the stronger
is the strongest of them by mere chance.
A misspelling shares most n-grams with the word it hides.

The model is fitted on a bounded sample of labelled rows: the `most` documents of
each label whose ids have the least hash. Scores use the text alone.

Edge cases: null and empty texts get the score of a text without evidence; a table
without labels of both kinds gives every text a score next to 0 (under 1e-8); repeated rows get equal
scores; a label given more than once counts as toxic if any of them does.
"""

from __future__ import annotations

import heapq
import math
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from saldo.llm.arrays import BASE, U64, mix, prefix_hash, small_batches, span_hash
from saldo.llm.bpe_words import Kept

#: Words have a letter; numbers are no words.
WORD = re.compile(r"[^\W_]*[^\W\d_][^\W_]*")
BUCKETS, DIMENSIONS, SHORTEST, LONGEST = 1 << 17, 4, 3, 6
#: Documents of each label that the model is fitted on.
MOST = 2000
THRESHOLD = 0.7
#: Passes over the words in each turn of training, and turns. These and what is below were chosen on training rows alone:
#: fitted on those of remainder 0, tried on those of remainder 2.
ROUNDS, TURNS = 6, 3
#: Where the weights of the three strongest words, the averaged bag, the number of words and the constant start, and how much they are held there.
START, PULL = np.array([1.0, 0.5, 0.5, 0.5, 0.0, 0.0]), np.array([0.3, 0.3, 0.3, 0.3, 0.3, 0.01])
#: No word of a text counts as weaker than this among its strongest.
FLOOR = -3.0


def held_out(id_col: str = "doc_id") -> Column:
    return F.crc32(F.col(id_col).cast("string").cast("binary")) % 3 == 1


def grams(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of all n-grams of the words, marked at their edges, and of the words; and how many each word has."""
    letters = np.frombuffer("".join([f"<{w}>" for w in words]).encode("utf-32-le"), np.uint32).astype(U64)
    size = np.array([len(w) + 2 for w in words], np.int64)
    head = np.append(0, np.cumsum(size))
    owner = np.repeat(np.arange(len(words)), size)
    value, values, owners = np.zeros(len(letters), U64), [], []
    for n in range(1, LONGEST + 1):
        value = value[: len(letters) - n + 1] * U64(BASE) + letters[n - 1 :]
        if n >= SHORTEST:
            inside = owner[: len(value)] == owner[n - 1 :]
            values.append(mix(value[inside] + U64(n)))
            owners.append(owner[: len(value)][inside])
    values.append(span_hash(prefix_hash(letters), head[:-1], head[1:]))
    owners.append(np.arange(len(words)))
    owners_ = np.concatenate(owners)
    order = np.argsort(owners_, kind="stable")
    return (np.concatenate(values)[order] % U64(BUCKETS)).astype(np.int64), np.bincount(owners_, minlength=len(words))


@dataclass
class Model:
    """Evidence of each bucket: the difference of the softmax's two outputs, and the logistic function of a document."""

    evidence: np.ndarray
    slope: np.ndarray
    bias: float

    def words(self, words: list[str]) -> list[float]:
        """Evidence of each word."""
        if not words:
            return []
        buckets, n = grams(words)
        return (np.add.reduceat(self.evidence[buckets], np.append(0, np.cumsum(n)[:-1])) / n).tolist()

    def score(self, documents: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(documents @ self.slope + self.bias, -40, 40)))


#: What a text without words says on average.
NOTHING = -8.0


def described(values: list[float]) -> tuple[float, ...]:
    """What a document's distinct words say: the three highest evidences, the averaged bag's, which is the words' mean as the softmax is linear, and
    the logarithm of their number."""
    top = [max(v, FLOOR) for v in heapq.nlargest(3, values)]
    return (*top, *[FLOOR] * (3 - len(top)), sum(values) / len(values) if values else NOTHING, math.log1p(len(values)))


#: Words whose n-grams are made at once, which bounds memory.
BLOCK = 20_000


class Bags:
    """Distinct words of documents by number, and every word's buckets in one array."""

    def __init__(self, texts: list[str | None]) -> None:
        self.place: dict[str, int] = {}
        self.documents = [np.array(sorted({self.place.setdefault(w, len(self.place)) for w in WORD.findall((t or "").lower())}), np.int32) for t in texts]
        names, sizes, buckets = list(self.place), [], []
        for i in range(0, len(names), BLOCK):
            own, n = grams(names[i : i + BLOCK])
            buckets.append(own.astype(np.int32))
            sizes.append(n)
        self.buckets = np.concatenate([*buckets, np.zeros(0, np.int32)])
        self.size = np.concatenate([*sizes, np.zeros(0, np.int64)])
        self.heads = np.append(0, np.cumsum(self.size))

    def evidence(self, of_bucket: np.ndarray) -> np.ndarray:
        """Mean over each word's buckets."""
        out = np.zeros(len(self.size))
        for i in range(0, len(out), BLOCK):
            heads = self.heads[i : i + BLOCK + 1]
            out[i : i + BLOCK] = np.add.reduceat(of_bucket[self.buckets[heads[0] : heads[-1]]], heads[:-1] - heads[0])
        return out / np.maximum(self.size, 1)


def _softmax_fit(bags: Bags, words: np.ndarray, target: np.ndarray, weight: np.ndarray, state: dict, rounds: int, rng: np.random.Generator) -> None:
    """Adagrad over shuffled parts of the words; target is the toxic share of a word's weight."""
    vectors = state["vectors"]
    for _ in range(rounds):
        for part in np.array_split(rng.permutation(len(words)), max(1, len(words) // 10000)):
            size = bags.size[words[part]]
            first = np.append(0, np.cumsum(size)[:-1])
            own = bags.buckets[np.repeat(bags.heads[words[part]] - first, size) + np.arange(size.sum())]
            mean = np.add.reduceat(vectors[own], first) / size[:, None]
            logits = mean @ state["output"] + state["bias"]
            p = np.exp(logits - logits.max(1, keepdims=True))
            p /= p.sum(1, keepdims=True)
            error = (p - np.stack([1 - target[part], target[part]], 1)) * weight[part][:, None]
            scale = weight[part].sum() + 1e-9
            back = np.repeat((error @ state["output"].T) / size[:, None], size, axis=0)
            state["output"] = state["output"] - 0.5 * (mean.T @ error) / scale
            state["bias"] = state["bias"] - 0.5 * error.sum(0) / scale
            step = np.stack([np.bincount(own, back[:, d], BUCKETS) for d in range(DIMENSIONS)], 1)
            state["seen"] += (step**2).sum(1)
            vectors -= 0.25 * step / np.sqrt(state["seen"] + 1e-8)[:, None]


def fit(texts: list[str], labels: list[int], seed: int = 7) -> Model:
    """Vectors on three quarters of the documents, the logistic function on the rest."""
    rng = np.random.default_rng(seed)
    labels_ = np.array(labels, int)
    part = np.zeros(len(texts), int)  # 1: for the logistic function
    for y in (0, 1):
        own = np.flatnonzero(labels_ == y)
        part[own[::4]] = 1
    first, second = np.flatnonzero(part == 0), np.flatnonzero(part == 1)
    bags = Bags([texts[i] for i in first])
    state = {"vectors": rng.normal(0, 0.1, (BUCKETS, DIMENSIONS)), "output": rng.normal(0, 0.5, (DIMENSIONS, 2)), "bias": np.zeros(2), "seen": np.zeros(BUCKETS)}
    clean = np.zeros(len(bags.size))
    for index, i in zip(bags.documents, first, strict=True):
        clean[index] += labels_[i] == 0

    def evidence() -> np.ndarray:
        return state["vectors"] @ (state["output"][:, 1] - state["output"][:, 0]) + state["bias"][1] - state["bias"][0]

    for turn in range(TURNS if len(clean) else 0):
        toxic = np.zeros(len(clean))
        scores = bags.evidence(evidence()) if turn else toxic
        for index, i in zip(bags.documents, first, strict=True):
            if labels_[i] and len(index):
                if turn:  # the words that speak for the document
                    toxic[index[np.argsort(-scores[index], kind="stable")[: max(1, min(3, len(index) // 10))]]] += 1
                else:
                    toxic[index] += 1
        # A clean document's word weighs less than a chosen one of a toxic document, of which there are few.
        share = toxic.sum() / max(1, clean.sum())
        weight = toxic + clean * (max(0.2, share) if turn else share)
        chosen = np.flatnonzero(weight > 0)
        if len(chosen):
            _softmax_fit(bags, chosen, (toxic / np.maximum(weight, 1e-9))[chosen], np.minimum(weight[chosen], 50), state, ROUNDS, rng)
    model = Model(evidence().astype(np.float32), START[:-1], 0.0)
    others = Bags([texts[i] for i in second])
    known = others.evidence(model.evidence)
    features = np.array([described(known[b].tolist()) for b in others.documents]).reshape(-1, len(START) - 1)
    return _logistic(model, features, labels_[second])


def _logistic(model: Model, x: np.ndarray, y: np.ndarray) -> Model:
    """Fit the document's logistic function by Newton steps, drawn toward a start that leans on the strongest word."""
    if not len(y) or y.min() == y.max():
        return Model(model.evidence, START[:-1], -20.0)
    design = np.column_stack([x, np.ones(len(x))])
    start, pull = START, PULL

    def loss(w: np.ndarray) -> float:
        z = design @ w
        return float((np.logaddexp(0, z) - y * z).sum() + (pull * (w - start) ** 2).sum() / 2)

    w = start.copy()
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(design @ w, -30, 30)))
        gradient = design.T @ (p - y) + pull * (w - start)
        hessian = (design * (p * (1 - p))[:, None]).T @ design + np.diag(pull)
        step, part = np.linalg.solve(hessian, gradient), 1.0
        # A whole step overshoots where all documents are told apart.
        while part > 1e-6 and loss(w - part * step) > loss(w):
            part /= 2
        w = w - part * step
    return Model(model.evidence, w[:-1], float(w[-1]))


def train(docs: DataFrame, labels: DataFrame, most: int = MOST) -> Model:
    """Fit on at most `most` labelled documents of each label, none of them held out."""
    marked = labels.where(~held_out()).where("toxic is not null").groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    order = F.xxhash64("doc_id")
    # The ids of least hash are chosen before any text moves.
    chosen = [marked.where(f"toxic = {y}").orderBy(order, "doc_id").limit(most) for y in (0, 1)]
    # Only the columns that are needed, so that others of the same names do no harm; of a repeated id the least text.
    texts = docs.select("doc_id", "text").join(chosen[0].union(chosen[1]), "doc_id").groupBy("doc_id").agg(F.min("text").alias("text"), F.max("toxic").alias("toxic")).toArrow()
    rows = sorted(zip(texts["doc_id"].to_pylist(), texts["text"].to_pylist(), texts["toxic"].to_pylist(), strict=True), key=lambda r: r[0])
    return fit([r[1] or "" for r in rows], [int(r[2]) for r in rows])


def _scorer(model):
    kept = Kept()

    def score(texts: list[str | None]) -> np.ndarray:
        bags = [set(WORD.findall(t.lower())) if t else () for t in texts]
        every = set().union(*bags)
        fresh = [w for w in every if w not in kept and w not in kept.old]
        known = dict(zip(fresh, model.value.words(fresh), strict=True))
        known |= {w: kept[w] if w in kept else kept.old[w] for w in every if w not in known}
        for w in every:
            if w not in kept:
                kept.put(w, known[w])
        features = np.array([described([known[w] for w in b]) for b in bags], float).reshape(-1, len(START) - 1)
        return model.value.score(features)

    return score


def scored(docs: DataFrame, labels: DataFrame, most: int = MOST, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, held_out, score and predicted of every document."""
    spark = docs.sparkSession
    small_batches(spark)
    model = spark.sparkContext.broadcast(train(docs, labels, most))
    kind = docs.schema["doc_id"].dataType.simpleString()

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        score = _scorer(model)
        for batch in batches:
            p = score(batch.column(1).to_pylist())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(p), pa.array((p >= threshold).astype(np.int32))], names=["doc_id", "score", "predicted"])

    out = docs.select("doc_id", "text").mapInArrow(scan, f"doc_id {kind}, score double, predicted int")
    return out.select("doc_id", F.coalesce(held_out(), F.lit(False)).alias("held_out"), "score", "predicted")


def drop_toxic(docs: DataFrame, labels: DataFrame, most: int = MOST, threshold: float = THRESHOLD) -> DataFrame:
    """The documents that score less than the threshold, with their own columns."""
    spark = docs.sparkSession
    small_batches(spark)
    model = spark.sparkContext.broadcast(train(docs, labels, most))

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        score = _scorer(model)
        for batch in batches:
            p = score(batch.column(batch.schema.get_field_index("text")).to_pylist())
            yield batch.filter(pa.array(p < threshold))

    return docs.mapInArrow(scan, docs.schema)
