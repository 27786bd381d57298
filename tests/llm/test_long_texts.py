"""Texts that are long, unbroken or malformed are handled whole and in time that grows with their length."""

import random
import time

import public_tokenizers
import pytest
from tokenizers import Tokenizer

from saldo.llm.html_text import extract
from saldo.llm.pii import find
from saldo.llm.token_counts import RankMerger

GOOD = "It is the most common of all the words in a text that has been written for the people who read it, and there is no other that they would like more."


@pytest.fixture(scope="module")
def merger():
    return RankMerger(public_tokenizers.path("byte_bpe_50k.json"))


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))


@pytest.mark.parametrize("letters", ["ab", "aA", "etaoinshrdlu", "aaaaaaab", "=-_#", "αβγдеж"])
def test_unbroken_pieces_equal_the_library(merger, library, letters):
    rng = random.Random(letters)
    pieces = ["".join(rng.choice(letters) for _ in range(n)) for n in (1, 2, 7, 60, 199, 201, 1500)]
    assert merger.count([p.encode() for p in pieces]).tolist() == [len(library.encode(p, add_special_tokens=False).ids) for p in pieces]


def test_a_piece_of_a_hundred_thousand_letters(merger, library):
    rng = random.Random(3)
    text = "".join(rng.choice("etaoin") for _ in range(100_000))
    began = time.process_time()
    assert merger.count([text.encode()])[0] == len(library.encode(text, add_special_tokens=False).ids)
    assert time.process_time() - began < 20


@pytest.mark.parametrize("part", ["<a ", '<a "', "<div>", "<div class=ad>some words ", "<div><p>x</span>", "<button>x", "<!--", "<div></p>", "<script>"])
def test_pages_take_time_in_proportion(part):
    def took(n: int) -> float:
        began = time.process_time()
        extract(part * n)
        return time.process_time() - began

    took(1000)
    # Of quadratic time this would be sixteen times as much.
    assert took(32_000) < 10 * took(8_000) + 0.3


def test_numbers_of_any_length():
    assert find("9" * 5000 + ".1.1.1") == []
    text = "0" * 5000 + "12.1.1.255 and 256.1.1.1"
    assert find(text) == [("ip", 0, 5010)]


def test_a_comment_mark_in_a_script_hides_nothing():
    page = f'<html><body><script>var a = "<!--";</script><article><p>{GOOD}</p></article></body></html>'
    assert extract(page) == GOOD


@pytest.mark.parametrize("name", ["social", "share", "side", "related"])
def test_a_paragraph_of_an_article_with_such_a_class(name):
    page = f'<html><body><nav><a href="/">Home</a></nav><article><p>{GOOD}</p><p class="{name}">{GOOD} Indeed.</p></article><footer>All rights reserved</footer></body></html>'
    assert extract(page) == f"{GOOD}\n\n{GOOD} Indeed."


@pytest.mark.parametrize(
    "text",
    [
        "Η Αθήνα είναι η πρωτεύουσα της Ελλάδας και η μεγαλύτερη πόλη της χώρας, με μακρά ιστορία που αρχίζει πριν από τρεις χιλιάδες χρόνια και συνεχίζεται ως σήμερα, όπως λένε οι ιστορικοί και οι αρχαιολόγοι που τη μελετούν.",
        "東京は日本の首都であり、世界でも有数の大都市です。江戸時代から政治と文化の中心として発展し、現在では多くの人々がこの街で暮らしています。毎年多くの観光客が訪れ、歴史的な寺院や近代的な建物を楽しんでいます。",
    ],
)
def test_languages_without_a_list_of_stop_words(text):
    page = f'<html><body><div><a href="/">α</a> <a href="/b">β</a></div><div>{text}</div><div>{text}</div><footer>© 2024</footer></body></html>'
    assert extract(page) == f"{text}\n\n{text}"
