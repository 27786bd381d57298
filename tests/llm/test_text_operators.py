"""Operators that read each text by itself, against the libraries or plain patterns."""

import hashlib
import re

import public_tokenizers
import pytest
from tokenizers import Tokenizer

from saldo.llm import bpe_words, decontaminate, html_text, pii, token_counts
from saldo.llm.queries import QUERIES

ODD = [
    None, "", " ", "\n\t ", "a", "ÀÉ İstanbul ΣΑΣ", "x" * 5000, "ab " * 4000, "<|endoftext|> mid <|startoftext|>tail<|endoftext|>", "don't we'll I'm 'S 12 345  x\u0085y", "é ﬁ Ⅷ ½", "😀 👍🏽 text", "a\x1cb\x1dc", "a  b   c\n\n d \n", "　全角 文字　",
    "4111 1111 1111 1111 and +1 (555) 010-9999 or a.b@c.example.org, 10.0.0.256, 10.20.30.40.50.60.70", "1.2.3.4.5 ..@a.b x@y.z@w.v", "000000000000000000000000000 4111-1111-1111-1111-5", "+12 3 +1234567890123456 ++49 30 1234567",
]


def edge_docs(spark):
    rows = [(i, t, "x") for i, t in enumerate(ODD)] + [(3, ODD[3], "again"), (None, "no id", "y")]
    return spark.createDataFrame(rows, "doc_id long, text string, spans string")


def by_id(df):
    rows = {}
    for r in df.collect():
        rows.setdefault(r["doc_id"], []).append(r)
    return rows


def documents(spark, sf):
    return {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()}


def base_spans(text):
    found = []
    for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text):
        found.append((m.start(), 0, "email", m.end()))
    for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text):
        if all(int(x) <= 255 for x in m[0].split(".")):
            found.append((m.start(), 1, "ip", m.end()))
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text):
        digits = [int(c) for c in m[0] if c.isdigit()]
        twice = [d if i % 2 == 0 else sum(divmod(2 * d, 10)) for i, d in enumerate(reversed(digits))]
        if 12 <= len(digits) <= 19 and sum(twice) % 10 == 0:
            found.append((m.start(), 2, "card", m.end()))
    for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text):
        if 9 <= sum(c.isdigit() for c in m[0]) <= 15:
            found.append((m.start(), 3, "phone", m.end()))
    return [(k, s, e) for s, _, k, e in sorted(found)]


def check_pii(row, text):
    want = base_spans(text or "")
    assert [row[f"n_{k}"] for k in ("email", "ip", "card", "phone")] == [sum(w[0] == k for w in want) for k in ("email", "ip", "card", "phone")]
    assert row["base_sha256"] == hashlib.sha256(",".join(f"{k}:{s}:{e}" for k, s, e in want).encode()).hexdigest()
    assert {f"{k}:{s}:{e}" for k, s, e in want} <= set(row["spans"].split(",")) | {""}


def test_pii_base_spans_equal_plain_patterns(spark, sf01_dir):
    texts, rows = documents(spark, sf01_dir), by_id(QUERIES["op1_pii"](spark, sf01_dir))
    assert rows.keys() == texts.keys()
    for i, text in texts.items():
        check_pii(rows[i][0], text)


def test_pii_edges(spark):
    rows = by_id(pii.detect(edge_docs(spark)))
    for i, text in enumerate(ODD):
        for row in rows[i]:
            check_pii(row, text)
    assert len(rows[3]) == 2 and len(rows[None]) == 1
    assert pii.detect(edge_docs(spark).limit(0)).collect() == []


@pytest.mark.parametrize(
    ("text", "span"),
    [("see ftp://bob:pa55@host.example/x", "login"), ("api_key = 'abc123def456ghi7'", "secret"), ("IBAN: DE89 3704 0044 0532 0130 00.", "iban"), ("at 12 North Hill Street today", "street"), ("rue de la Paix 15", "street")],
)
def test_pii_added_kinds(text, span):
    assert span in [k for k, _, _ in pii.find(text)]


def test_pii_clean_keeps_columns(spark):
    docs = spark.createDataFrame([(1, "mail a@b.cd now", "q"), (2, None, None)], "doc_id long, text string, extra string")
    rows = {r["doc_id"]: r for r in pii.clean(docs).collect()}
    assert rows[1]["text"] == "mail <EMAIL> now" and rows[1]["extra"] == "q" and rows[2]["text"] is None


def library(name):
    t = Tokenizer.from_file(public_tokenizers.path(name))
    t.no_padding()
    t.no_truncation()
    return t


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def check_bpe(row, text, t):
    ids = t.encode(text or "", add_special_tokens=False).ids
    assert row["n_tokens"] == len(ids), text
    assert row["ids_sha256"] == sha(" ".join(map(str, ids)))
    assert row["decoded_sha256"] == sha(t.decode(ids, skip_special_tokens=False))


def test_bpe_equals_library(spark, sf01_dir):
    t, texts, rows = library("word_bpe_49k.json"), documents(spark, sf01_dir), by_id(QUERIES["op5_bpe"](spark, sf01_dir))
    assert rows.keys() == texts.keys()
    for i, text in texts.items():
        check_bpe(rows[i][0], text, t)


def test_bpe_edges(spark):
    t, rows = library("word_bpe_49k.json"), by_id(bpe_words.encode(edge_docs(spark), public_tokenizers.path("word_bpe_49k.json")))
    for i, text in enumerate(ODD):
        for row in rows[i]:
            check_bpe(row, text, t)


def test_token_counts_equal_library(spark, sf01_dir):
    t, texts, rows = library("byte_bpe_50k.json"), documents(spark, sf01_dir), by_id(QUERIES["op8_token_counts"](spark, sf01_dir))
    assert rows.keys() == texts.keys()
    for i, text in texts.items():
        n = len(t.encode(text or "", add_special_tokens=False).ids)
        assert (rows[i][0]["n_tokens"], rows[i][0]["over_limit"], rows[i][0]["n_bytes"]) == (n, n > 1024, len((text or "").encode()))


def test_token_counts_edges(spark):
    t, rows = library("byte_bpe_50k.json"), by_id(token_counts.count(edge_docs(spark), public_tokenizers.path("byte_bpe_50k.json")))
    for i, text in enumerate(ODD):
        for row in rows[i]:
            assert row["n_tokens"] == len(t.encode(text or "", add_special_tokens=False).ids), text


def test_token_counts_with_full_caches():
    t, counter = library("byte_bpe_50k.json"), token_counts.RankMerger(public_tokenizers.path("byte_bpe_50k.json"))
    counter.chunks.size, counter.pieces.size = 5, 3
    texts = [f"some words {i} and {i % 3} others, some words again" for i in range(40)]
    for k in range(0, 40, 8):
        assert counter.totals(texts[k : k + 8]) == [len(t.encode(x, add_special_tokens=False).ids) for x in texts[k : k + 8]]


PAGE = """<!doctype html><html><head><title>T</title><style>p{}</style></head><body><header class="site-header"><a href="/">Home</a></header>
<nav><ul><li><a href=a>One</a><li><a href=b>Two</a></ul></nav><main><article><h1>Head &amp; shoulders</h1>
<p>This is the first paragraph of the article, and it has all of the   words that
one would expect in it, so it is good.</p><p>Short one.</p><script>var x = "<p>no</p>";</script>
<p>The second paragraph is also as long as it has to be, with <b>bold</b> text and a <a href=x>link</a> in it for good measure.</p></article></main>
<section class="comments"><h2>Comments</h2><p>I think that this is the best article that I have read in all of the years that I have been here.</p></section>
<aside class="sidebar"><p>Buy this now</p></aside><footer><p>Copyright &copy; 2024 and all of the rights that are reserved by the owner of this site</p></footer></body></html>"""


def test_html_extracts_article(spark):
    pages = spark.createDataFrame([(1, "u", PAGE), (2, None, None), (3, "v", ""), (4, "w", "<p>" * 2000 + "a")], "page_id long, url string, html string")
    rows = {r["page_id"]: r for r in html_text.main_text(pages).collect()}
    parts = rows[1]["text"].split("\n\n")
    assert parts[0] == "Head & shoulders" and parts[1].startswith("This is the first") and parts[2] == "Short one." and "bold text and a link" in parts[3] and len(parts) == 4
    assert rows[1]["n_chars"] == len(rows[1]["text"]) and rows[2]["text"] == rows[3]["text"] == ""


def windows_of(words, n=10):
    return [tuple(words[i : i + min(n, len(words))]) for i in range(max(1, len(words) - n + 1))] if words else []


def low(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def overlaps(texts, items):
    index = {}
    for item, text in items:
        for w in windows_of(low(text)):
            index.setdefault(w, set()).add(str(item))
    lengths = {len(w) for w in index}
    for i, text in texts:
        words, hit, found = low(text), set(), set()
        for n in lengths:
            for at in range(len(words) - n + 1):
                if got := index.get(tuple(words[at : at + n])):
                    hit.update(range(at, at + n))
                    found |= got
        yield i, (len(words), len(hit), len(found), sha(",".join(sorted(found))), bool(hit))


@pytest.mark.parametrize("broadcast", [decontaminate.BROADCAST_WINDOWS, 0])
def test_decontamination_equals_brute_force(spark, sf_dir, broadcast):
    docs, bench = spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    rows = by_id(decontaminate.scan_windows(docs, bench, broadcast_windows=broadcast))
    items = [(r["item_id"], r["text"]) for r in bench.collect()]
    want = dict(overlaps(documents(spark, sf_dir).items(), items))
    got = {i: tuple(r[0])[1:] for i, r in rows.items()}
    assert got == want and sum(w[4] for w in want.values()) > 0


@pytest.mark.parametrize("broadcast", [decontaminate.BROADCAST_WINDOWS, 0])
def test_decontamination_edges(spark, broadcast):
    passage = "the quick brown fox jumps over the lazy dog again and again today"
    texts = [(1, passage), (2, f"x {passage.upper()} y"), (3, None), (4, ""), (5, "short item"), (6, "a short item b"), (7, "ü " * 30), (8, " ".join(passage.split()[:9])), (9, passage + " " + passage)]
    items = [("a", passage), ("b", "Short  item"), ("c", None), ("d", "!!!"), ("e", passage), ("f", "ü " * 12)]
    docs = spark.createDataFrame([(i, t, "clash") for i, t in texts], "doc_id long, text string, item_id string")
    bench = spark.createDataFrame(items, "item_id string, text string")
    got = {r["doc_id"]: tuple(r)[1:] for r in decontaminate.scan_windows(docs, bench, broadcast_windows=broadcast).collect()}
    assert got == dict(overlaps(texts, items))
    assert {r["doc_id"] for r in decontaminate.drop_contaminated(docs, bench).collect()} == {3, 4, 8}
    assert decontaminate.scan_windows(docs.limit(0), bench.limit(0)).collect() == []
