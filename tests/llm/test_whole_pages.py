"""Pages whose article must not be lost to a wrapper's class, an unclosed element or a stray link."""

import pytest

from saldo.llm.html_text import extract, main_text

P = "This is a paragraph of the article, and it has all of the words that one would expect to be in it, so it is good."
Q = "And that is the second of the paragraphs that are in the article, which has as many words as the first one had."


@pytest.mark.parametrize("wrapper", ["<div class='content has-sidebar'>", "<div id='page' class='no-sidebar'>", "<section class='left-side'>", "<div class='menu-open with-nav'>", "<div class='sidebar'><main>"])
def test_class_of_a_wrapper(wrapper):
    assert extract(f"<body>{wrapper}<p>{P}</p><p>{Q}</p></div></body>") == f"{P}\n\n{Q}"


def test_title_in_entry_header():
    page = f"<article><div class='entry-header'><h1>The title</h1></div><p>{P}</p><p>{Q}</p></article>"
    assert extract(page) == f"The title\n\n{P}\n\n{Q}"


@pytest.mark.parametrize("name", ["sidebar", "site-footer", "comment-list", "cookie-notice", "ad-1", "main-nav"])
def test_named_elements_stay_out(name):
    assert extract(f"<div><p>{P}</p></div><div class='x {name}'><p>{Q}</p></div>") == P


def test_comments_longer_than_the_article_stay_out():
    remarks = f"<article><p>{Q}</p></article>" * 9
    assert extract(f"<article><p>{P}</p></article><section class='comments'>{remarks}</section>") == P


@pytest.mark.parametrize("tag", "button svg object select noscript template canvas math".split())
def test_unclosed_silent_elements(tag):
    assert extract(f"<body><div><{tag}>x</div><p>{P}</p><p><{tag}>y</{tag}>{Q}</p></body>") == f"{P}\n\n{Q}"
    assert extract(f"<body><{tag}>x<p>{P}</p><p>{Q}</p></body>") == f"{P}\n\n{Q}"
    assert extract(f"<div><p>{P}</p><{tag}><div><p>{Q}</p></div></{tag}><p>{Q}</p></div>") == f"{P}\n\n{Q}"


def test_links():
    assert extract(f"<body><a name=top><p>{P}</p><p>{Q}</p></body>") == f"{P}\n\n{Q}"
    assert extract(f"<body><div><a href=x>Home</div><p>{P}</p><p>{Q}</p></body>") == f"{P}\n\n{Q}"
    assert extract(f"<body><a href=x><div><p>{P}</p></div></a></body>") == ""


def test_extra_columns_of_clashing_names_change_nothing(spark, sf_dir):
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    wide = pages.selectExpr("'x' AS text", "*", "1 AS n_chars", "2 AS id", "null AS doc_id")
    have, want = (sorted(map(tuple, main_text(p).collect())) for p in (wide, pages))
    assert have == want and want


LONG_TEXT = "The story of the day is that it was in the news and that the people of the town had been there with all of their friends for the first time. It was good."


def test_linked_entries_of_an_article_stay():
    page = f"<nav><a href=x>Home</a></nav><article><p>{LONG_TEXT}</p><ul><li><a href=a>First source of the story</a></li><li>Second</li></ul><p>{LONG_TEXT}</p></article><footer><a href=i>Imprint</a></footer>"
    assert extract(page) == "\n\n".join([LONG_TEXT, "First source of the story", "Second", LONG_TEXT])


def test_headings_and_short_ends_outside_an_article_element_stay():
    menu, foot = "<ul class=menu><li><a href=x>Home</a></li></ul>", "<div class=footer>All rights</div>"
    body = f"<h1>A heading</h1><p>{LONG_TEXT}</p><h2>Second</h2><p>Short end.</p>"
    want = "\n\n".join(["A heading", LONG_TEXT, "Second", "Short end."])
    assert extract(body) == want
    assert extract(f"{menu}<h1>A heading</h1><p>{LONG_TEXT}</p><p>Short end.</p>{foot}") == "\n\n".join(["A heading", LONG_TEXT, "Short end."])


def test_a_page_of_short_paragraphs_alone():
    assert extract("<nav><a href=x>Home</a></nav><p>One short paragraph.</p><footer>Imprint</footer>") == "One short paragraph."
    assert extract("<p>One.</p><p>Two.</p>") == "One.\n\nTwo."
    assert extract("<nav>Home</nav>") == extract("") == extract(None) == ""
