"""Alignment of two tokenizers' tokens against a plain walk over bytes."""

import hashlib
from collections import Counter

import public_tokenizers
import sentencepiece
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from saldo.llm import alignment, queries
from saldo.llm.bpe_words import byte_letters

A, B = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
HOSTILE = [
    None, "", " ", "  ", "\n", "a", "a ", "a\n", " a", "\ta  b\n\n c ", "x\r\ny;\r\n z)\r", "he said <|endoftext|> and <s> </s> <unk>", "▁a b", "a▁ b c",
    "日本語のテキスト。 全角　空白  nbsp", "naïve café ﬁ é é", "\x00\x01 \x7f", "🎉🎉 👩‍👩‍👧 flags 🇩🇪", "don't we'll they've", "1234567890 12 3.14", "x" * 5000, "ab " * 3000,
    "Ünïcödé ;\r\n }\r", "<0x0A> <0xFF>", "tab\tsep\x0bvt\x0cff\x1cfs", "の" * 700, "a  \n  b", " line para", "é combining",
]


def plain(rows):
    """Every row's result by walking over the byte ranges of both."""
    a_tool, b_tool = Tokenizer.from_file(A), sentencepiece.SentencePieceProcessor(model_file=B)
    a_tool.encode_special_tokens = True
    letters = {c: b for b, c in enumerate(byte_letters())}
    name = {i: t for t, i in a_tool.get_vocab().items()}
    cut, pairs = [], []
    for text in rows:
        whole = (" " + (text or "")).encode()
        a = [(i, bytes(letters[c] for c in name[i])) for i in a_tool.encode(" " + text, add_special_tokens=False).ids] if text else []
        b = [(i, bytes([int(b_tool.id_to_piece(i)[3:5], 16)]) if b_tool.is_byte(i) else b_tool.id_to_piece(i).replace("▁", " ").encode()) for i in b_tool.encode(text)] if text else []
        if b"".join(x for _, x in a) != whole or b"".join(x for _, x in b) != whole:
            a = b = []
        spans = []
        for side in (a, b):
            at, own = 0, []
            for i, x in side:
                own.append((at, at + len(x), i))
                at += len(x)
            spans.append(own)
        links = [(x[2], y[2]) for x in spans[0] for y in spans[1] if x[0] < y[1] and y[0] < x[1]] if len(text or "") < 2000 else None
        if links is None:  # a sweep, for long texts
            links, i, j = [], 0, 0
            while i < len(spans[0]) and j < len(spans[1]):
                links.append((spans[0][i][2], spans[1][j][2]))
                x, y = spans[0][i][1], spans[1][j][1]
                i, j = i + (x <= y), j + (y <= x)
        ends = sorted({x[1] for x in spans[0]} & {y[1] for y in spans[1]})
        groups, low = [], 0
        for e in ends:
            groups.append("|".join(",".join(str(i) for s, t, i in side if low <= s and t <= e) for side in spans) if len(ends) < 500 else None)
            low = e
        cut.append((len(a), len(b), ends, groups, links))
        pairs.append(set(links))
    count = Counter(p for x in pairs for p in x)
    best = {}
    for (x, _), n in count.items():
        best[x] = max(best.get(x, 0), n)
    out = []
    for n_a, n_b, ends, groups, links in cut:
        sha = "" if not n_a else hashlib.sha256(";".join(groups).encode()).hexdigest() if None not in groups else None
        out.append((n_a, n_b, len(ends), len(links), sum(count[p] == best[p[0]] for p in links), sum(count[p] for p in links), sha))
    return out


def check(frame, texts):
    got = {r.doc_id: r for r in frame.collect()}
    assert len(got) == len(texts)
    for i, want in enumerate(plain(texts)):
        r = got[i]
        assert (r.n_a, r.n_b, r.n_groups, r.n_links, r.n_best, r.count_sum) == want[:6], (i, texts[i])
        assert want[6] is None or r.groups_sha256 == want[6], (i, texts[i])


def test_hostile_texts_with_clashing_columns(spark):
    texts = HOSTILE + [t and t + " " + t for t in HOSTILE] + ["ab " * 3000]
    rows = [(i, t, 1, "x") for i, t in enumerate(texts)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n_a int, a_end string").repartition(3)
    check(alignment.align(docs, A, B), texts)


def test_counts_by_a_shuffled_join(spark, monkeypatch):
    monkeypatch.setattr(alignment, "BROADCAST_PAIRS", 0)
    texts = ["the cat sat", "the cat ran", None, "the dog", "the dog"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    check(alignment.align(docs, A, B), texts)


def test_whole_documents(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").orderBy("doc_id").collect()
    got = {r.doc_id: r for r in queries.op13_alignment(spark, sf_dir).collect()}
    assert len(got) == len(docs)
    for d, want in zip(docs, plain([d.text for d in docs]), strict=True):
        r = got[d.doc_id]
        assert (r.n_a, r.n_b, r.n_groups, r.n_links, r.n_best, r.count_sum) == want[:6]
        assert want[6] is None or r.groups_sha256 == want[6]


def test_groups_are_kept_and_an_empty_table(spark):
    docs = spark.createDataFrame([(1, "hello world")], "doc_id long, text string")
    (row,) = alignment.align(docs, A, B, keep_groups=True).collect()
    assert hashlib.sha256(row.groups.encode()).hexdigest() == row.groups_sha256 and "|" in row.groups
    assert alignment.align(docs.where("doc_id > 5"), A, B).count() == 0


def test_ids_by_a_text_column_of_another_name(spark):
    docs = spark.createDataFrame([("k", "hello")], "name string, body string")
    out = alignment.align(docs, A, B, "name", "body")
    assert out.where(F.col("doc_id") == "k").count() == 1
