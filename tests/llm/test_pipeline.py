"""The pipeline against its stages done plainly, on documents with columns whose names clash with those used inside."""

import hashlib

import corpus_pipeline
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from saldo.llm import decontaminate, neardup, site_quality, toxicity
from saldo.llm.pii import redact
from saldo.llm.queries import QUERIES

CLASHING = ["toxic", "_id", "_gone", "_hit", "quality", "id", "a", "component", "items", "score", "own", "key", "row", "kept"]


def words(text):
    for blank in "\t\n\v\f\r":
        text = text.replace(blank, " ")
    return [w for w in "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text).split(" ") if w]


def plain_components(rows):
    """Smallest reachable id by comparing all pairs of shingle sets."""
    sets = {}
    for i, text in rows:
        w = words(text or "")
        sets[i] = {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set()
    label = {i: i for i in sets}

    def root(i):
        while label[i] != i:
            i = label[i]
        return i

    ids = sorted(sets)
    for n, x in enumerate(ids):
        for y in ids[n + 1 :]:
            if sets[x] and sets[y] and 100 * len(sets[x] & sets[y]) >= 80 * len(sets[x] | sets[y]):
                p, q = sorted((root(x), root(y)))
                label[q] = p
    return {i: root(i) for i in ids}


@pytest.fixture(scope="module")
def folder(spark, sf_dir, tmp_path_factory):
    path = tmp_path_factory.mktemp("clash")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    docs.withColumns({c: F.lit("x") for c in CLASHING}).write.parquet(f"{path}/documents.parquet")
    for name in ("labels", "benchmark", "conversations"):
        spark.read.parquet(f"{sf_dir}/{name}.parquet").withColumns({"_id": F.lit("y"), "_gone": F.lit(1)}).write.parquet(f"{path}/{name}.parquet")
    return str(path)


def test_pipeline_equals_its_stages_done_plainly(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    toxic = {r["doc_id"] for r in QUERIES["op2_toxicity"](spark, folder).where("predicted = 1").collect()}
    texts = {r["doc_id"]: r["text"] for r in docs.select("doc_id", "text").collect() if r["doc_id"] not in toxic}
    label = plain_components(texts.items())
    texts = {i: t for i, t in texts.items() if label[i] == i}
    kept = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    hit = {r["doc_id"] for r in decontaminate.scan_windows(kept, spark.read.parquet(f"{folder}/benchmark.parquet")).where("contaminated").collect()}
    library = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    want = {}
    for i, text in texts.items():
        if i not in hit:
            ids = library.encode(redact(text) or "", add_special_tokens=False).ids
            want[i] = (len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest())
    got = {r["doc_id"]: (r["n_tokens"], r["ids_sha256"]) for r in corpus_pipeline.run(spark, folder).collect()}
    assert toxic and hit and len(texts) < len(label)
    assert got == want


def test_stages_keep_the_columns_of_documents(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs.limit(20), folder).columns == docs.columns


@pytest.mark.parametrize("name", [n for n in QUERIES if n not in ("op6_html",)])
def test_extra_columns_change_nothing(spark, sf_dir, folder, name):
    """As `documents` with further columns; the rows are those of the plain table."""
    have, want = (sorted(map(str, QUERIES[name](spark, d).collect())) for d in (folder, sf_dir))
    assert have == want


def test_sites_against_a_plain_computation(spark):
    """Rates of hosts and paths from sums over all rows, shrunk by the operator's own strengths."""
    docs = [(i, "word " * (i % 7 + 1), f"h{i % 3}", f"p{i % 2}") for i in range(90)]
    labels = [(i, int(i % 4 > 0)) for i in range(0, 90, 2)]
    table = spark.createDataFrame(docs, "doc_id long, text string, source string, lang string")
    marks = spark.createDataFrame(labels, "doc_id long, quality int")
    rows = {r["doc_id"]: r for r in site_quality.scored(table, marks).collect()}
    held = {r["doc_id"]: r["held_out"] for r in table.select("doc_id", toxicity.held_out().alias("held_out")).collect()}
    soft = {i: dict(labels)[i] if i in dict(labels) and not held[i] else 1 / (1 + 2.718281828459045 ** -rows[i]["evidence"]) for i in rows}
    for host in ("h0", "h1", "h2"):
        own = [soft[i] for i, _, h, _ in docs if h == host]
        rate = {rows[i]["host_rate"] for i, _, h, _ in docs if h == host}
        mean, whole = sum(own) / len(own), sum(soft.values()) / len(soft)
        # The rate lies between the host's own share and the whole's.
        assert len(rate) == 1 and min(mean, whole) - 1e-9 <= rate.pop() <= max(mean, whole) + 1e-9


def test_near_copies_of_repeated_ids(spark):
    text = "one two three four five six seven eight nine ten"
    docs = spark.createDataFrame([(1, text), (1, text), (2, text), (3, "other words that are here alone today"), (3, "third text of an id that is not alone")], "doc_id long, text string")
    kept = neardup.keep_one(docs)
    assert sorted((r["doc_id"], r["text"][:5]) for r in kept.collect()) == [(1, "one t"), (3, "other"), (3, "third")]
