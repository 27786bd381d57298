"""Document quality by hierarchical empirical Bayes over sites.

A linear classifier on the shape of a text (repetition, symbols, case, word
lengths, stop words) gives each document's own evidence. Hosts and the paths under
them get Beta posteriors of their share of good documents from grouped sums over
all documents: a host is shrunk toward the global share and a path toward its
host, by as many pseudo-documents as the spread between sites calls for
(method of moments). A score adds the path's log odds against the global ones to
the document's.

In `documents` the host is `source` and the path below it `lang`. The classifier is
fitted on the features of at most `most` labelled rows that are not held out; sums
and posteriors cover every row.

Edge cases: null and empty texts have the features of an empty text; a null host or
path is a site of its own; without labels of both kinds the classifier gives every
text the same evidence; repeated rows each count toward their site.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from operator import eq

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from saldo.llm.arrays import small_batches
from saldo.llm.html_text import STOP_WORDS
from saldo.llm.shared import staged
from saldo.llm.toxicity import held_out

MOST, KEEP = 20_000, 0.5
SYMBOLS = re.compile(r"[^\w\s.,;:'’\"-]")
FEATURES = ("repeats", "distinct", "top", "symbols", "capitals", "digits", "stops", "mean_length", "long_words", "size", "one")


def features(text: str | None) -> list[float]:
    """Shape of a text as numbers of about unit size."""
    text = text or ""
    words = text.split()
    n, chars = max(1, len(words)), max(1, len(text))
    counts = Counter(words)
    lower = {w: w.lower().strip(".,;:!?\"'()*#%$&") for w in counts}
    return [
        sum(map(eq, words, words[1:])) / n,
        len(counts) / n,
        (max(counts.values()) if counts else 0) / n,
        10 * len(SYMBOLS.findall(text)) / chars,
        4 * sum(c for w, c in counts.items() if w.isupper()) / n / 4,
        10 * sum(c for w, c in counts.items() if any(map(str.isdigit, w))) / n,
        3 * sum(c for w, c in counts.items() if lower[w] in STOP_WORDS) / n,
        sum(len(w) * c for w, c in counts.items()) / n / 6,
        sum(c for w, c in counts.items() if len(w) > 14) / n * 4,
        np.log1p(len(words)) / 6,
        1.0,
    ]


def fit(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Weights of a logistic regression with squares of the features, by Newton steps with a ridge."""
    if not len(y) or y.min() == y.max():
        return np.zeros(2 * len(FEATURES))
    design = np.column_stack([x, x**2])
    w = np.zeros(design.shape[1])
    for _ in range(40):
        p = 1 / (1 + np.exp(-np.clip(design @ w, -30, 30)))
        step = np.linalg.solve((design * (p * (1 - p))[:, None]).T @ design + 0.3 * np.eye(len(w)), design.T @ (p - y) + 0.3 * w)
        w -= step
        if np.abs(step).max() < 1e-6:
            break
    return w


def evidence(docs: DataFrame, columns: list[str]) -> DataFrame:
    """The columns and the features of each text."""
    kept = docs.select(*columns, "text")
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kept.schema[:-1])

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values = pa.array([features(t) for t in batch.column(batch.num_columns - 1).to_pylist()], pa.list_(pa.float64()))
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], values], names=[*columns, "features"])

    return kept.mapInArrow(scan, f"{schema}, features array<double>")


def _log_odds(p: Column) -> Column:
    p = F.least(F.greatest(p, F.lit(1e-6)), F.lit(1 - 1e-6))
    return F.log(p / (1 - p))


def _strength(groups: DataFrame) -> float:
    """Pseudo-documents by the method of moments: small if sites differ more than chance makes them."""
    row = groups.agg(F.sum("n").alias("n"), F.sum("good").alias("good"), F.sum(F.col("n") * F.pow(F.col("good") / F.col("n"), 2)).alias("squares"), F.sum("spread").alias("spread"), F.count("*").alias("sites")).first()
    if not row["n"] or row["sites"] < 2:
        return 1000.0
    mean = row["good"] / row["n"]
    between = row["squares"] / row["n"] - mean**2 - row["spread"] / row["n"] * row["sites"] / row["n"]
    return float(min(1e6, max(1.0, mean * (1 - mean) / max(between, 1e-9) - 1)))


def scored(docs: DataFrame, labels: DataFrame, host: str = "source", path: str = "lang", most: int = MOST, keep: float = KEEP) -> DataFrame:
    """doc_id, held_out, evidence, host_rate, path_rate, score and kept of every document."""
    small_batches(docs.sparkSession)
    marked = labels.where(~held_out()).where("quality is not null").groupBy("doc_id").agg(F.min("quality").alias("quality"))
    sample = marked.orderBy(F.xxhash64("doc_id"), "doc_id").limit(most)
    # Only the columns that are needed, so that others of the same names do no harm; of a repeated id the least text.
    texts = docs.select("doc_id", "text").join(sample, "doc_id").groupBy("doc_id").agg(F.min("text").alias("text"), F.min("quality").alias("quality"))
    rows = evidence(texts, ["doc_id", "quality"]).orderBy("doc_id").collect()
    x, y = np.array([r["features"] for r in rows], float).reshape(-1, len(FEATURES)), np.array([r["quality"] for r in rows], float)
    weights = fit(x, y).tolist()
    terms = [F.col("features")[i] * weights[i] + F.col("features")[i] * F.col("features")[i] * weights[i + len(FEATURES)] for i in range(len(FEATURES))]
    own = evidence(docs.select("doc_id", "text", F.col(host).alias("host"), F.col(path).alias("path")), ["doc_id", "host", "path"])
    total = terms[0]
    for term in terms[1:]:
        total = total + term
    own = own.select("doc_id", "host", "path", total.alias("evidence")).withColumn("chance", 1 / (1 + F.exp(-F.col("evidence"))))
    own = staged(own)
    known = own.join(marked, "doc_id", "left").withColumn("soft", F.coalesce(F.col("quality").cast("double"), "chance"))
    paths = staged(known.groupBy("host", "path").agg(F.count("*").alias("n"), F.sum("soft").alias("good"), F.sum(F.col("soft") * (1 - F.col("soft")) + 0.01).alias("spread")))
    hosts = staged(paths.groupBy("host").agg(F.sum("n").alias("n"), F.sum("good").alias("good"), F.sum("spread").alias("spread")))
    whole = hosts.agg(F.sum("n").alias("n"), F.sum("good").alias("good")).first()
    prior = whole["good"] / whole["n"] if whole["n"] else 0.5
    to_global, to_host = _strength(hosts), _strength(paths)
    hosts = hosts.select(F.col("host").alias("h"), ((F.col("good") + to_global * prior) / (F.col("n") + to_global)).alias("host_rate"))
    paths = paths.join(hosts, F.col("host").eqNullSafe(F.col("h"))).select(F.col("host").alias("h"), F.col("path").alias("p"), "host_rate", ((F.col("good") + to_host * F.col("host_rate")) / (F.col("n") + to_host)).alias("path_rate"))
    out = own.join(paths, F.col("host").eqNullSafe(F.col("h")) & F.col("path").eqNullSafe(F.col("p")))
    score = 1 / (1 + F.exp(-(F.col("evidence") + _log_odds(F.col("path_rate")) - _log_odds(F.lit(prior)))))
    out = out.select("doc_id", F.coalesce(held_out(), F.lit(False)).alias("held_out"), "evidence", "host_rate", "path_rate", score.alias("score"))
    return out.withColumn("kept", F.col("score") >= keep)
