"""Main text of web pages by two passes over blocks.

Pass one cuts the page into blocks at block-level tags and judges each by its
length, its density of stop words and its share of link characters: good, bad,
or undecided (short, near good, or full of links inside an article). Pass two gives
an undecided block the label of the nearest decided neighbour; of two as near, a
heading takes that of the block behind it and any other block that of the one before.
A page without a good block keeps its undecided ones. The edges of an article or main
element count as good neighbours of the blocks inside it; menus, headers, footers, side bars,
notices, adverts, forms and reader comments are bad by their tag or class; a class
is no reason if the element holds the page's article.

Edge cases: a null or empty page has the text ""; unclosed and stray tags are
tolerated (text without an end tag that HTML reads raw, as a script, goes to the end
of the page); a page of any length is read whole; repeated pages give equal rows.
"""

from __future__ import annotations

import html
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame

from saldo.llm.arrays import small_batches

# Tags that hold no text, that bound a block, and that mark what surrounds an article.
SILENT = ("script", "style", "noscript", "template", "svg", "iframe", "object", "textarea", "select", "head", "title", "math", "canvas", "button")
BLOCK = frozenset(
    "address article aside blockquote body caption center col colgroup dd details dialog dir div dl dt fieldset figcaption figure footer form "
    "h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol optgroup option p pre section summary table tbody td tfoot th thead tr ul".split()
)
OPTIONAL_END = frozenset("p hr li td th tr dd dt option".split())
AROUND = frozenset("nav footer aside form menu dialog".split())
INSIDE = frozenset("article main".split())
VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
AROUND_NAMES = frozenset(
    "ad ads advert adverts advertisement advertising banner sponsor sponsored promo promotion nav navbar navigation menu breadcrumb breadcrumbs sidebar "
    "side footer header masthead topbar comment comments respond reply replies disqus notice notices cookie cookies consent gdpr popup modal newsletter "
    "subscribe subscription signup share sharing social related recommended widget widgets pagination pager toolbar login disclaimer copyright".split()
)
# Readers' comments may be as long as an article and in article elements, so they are never taken for one.
REMARKS = frozenset("comment comments respond reply replies disqus".split())
# Words that may stand beside a name; a header or a side of anything but the site may be the article's own.
BESIDE = frozenset("site global main page primary secondary top bottom left right list box wrapper wrap container area section block slot unit item items inner group bar links link form text".split())
OWN = {"header": frozenset(("site", "global")), "side": frozenset()}
AROUND_ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert".split())
# Frequent words of four languages.
STOP_WORDS = frozenset(
    "the of and to in a is that for it as was with be by on not he his but at are this have from or had an they which one you were all her she there would their "
    "we him been has when who will no more if out so up said what its about than into them can only other time new some could these two may first then do any like my now over such our "
    "le la les un une des du de et en que qui dans pour pas sur est au aux ce cette il elle ne se son sa ses par plus avec ou mais comme nous vous leur été sont "
    "der die das den dem des ein eine einer eines einem einen und zu mit sich auf für von im nicht auch als wie bei nach aus wird sind war hat durch oder über sein ist es "
    "el los las una unos del y que se por con para al como más pero sus lo su este esta entre cuando muy sin sobre también me hasta hay donde quien desde todo nos".split()
)

# Silent elements whose text HTML reads raw, and those that cannot hold their like.
RAW = frozenset("script style iframe textarea".split())
UNNESTED = frozenset("button select title head".split())

#: Blocks of fewer characters are undecided, of more and dense enough in stop words good.
SHORT, LONG, LINKED, STOP_LOW, STOP_HIGH, STOP_NONE = 70, 200, 0.34, 0.12, 0.18, 0.04

# Each branch ends in one pass: a tag's quotes are read as such where that leads to its end, and not otherwise.
TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*>?|<(/?)([A-Za-z][A-Za-z0-9:-]*+)((?>(?:[^>\"']|\"[^\"]*\"|'[^']*'|[\"'])*+(?=>))|[^>]*)>",
    re.S,
)
ENDS = {tag: re.compile(rf"</{tag}(?![A-Za-z0-9:-])[^>]*>", re.I) for tag in SILENT}
NEXT_BLOCK = re.compile(rf"</?(?:{'|'.join(sorted(BLOCK))})(?![A-Za-z0-9:-])", re.I)
ANCHOR = re.compile(r"<(/?)a(?![A-Za-z0-9:-])", re.I)
LINK = re.compile(r"\bhref\s*=", re.I)
NAMED = re.compile(r"""\b(class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>"']+))""", re.I)
PART = re.compile(r"[A-Za-z]+")
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
#: Paragraphs and headings: inside an article a class alone does not make a long text of theirs a menu or an advert.
PHRASES = frozenset("p blockquote h1 h2 h3 h4 h5 h6".split())
BEYOND_LATIN = re.compile(r"[\u0370-\u1fff\u2c80-\ua7ff\uac00-\ud7ff\U00020000-\U0003ffff]")


def _names_around(token: str) -> bool:
    """Whether a class or id says what an element is: a name, or names with words that say where it stands."""
    words = PART.findall(token)
    names = [w for w in words if w in AROUND_NAMES]
    if not names or len(words) == 1:
        return bool(names)
    return all(w in AROUND_NAMES or w in BESIDE for w in words) and not any(o in OWN and not OWN[o].issuperset(w for w in words if w != o) for o in names)


def _surrounds(tag: str, attributes: str, in_article: bool) -> int:
    """2 for a menu, a header, an advert or the like by tag or role, and for comments; 1 if a class or id alone says so."""
    if tag in AROUND or tag == "header" and not in_article:
        return 2
    level = 0
    if attributes and tag in BLOCK and tag not in ("body", "html", *INSIDE):
        for name, *values in NAMED.findall(attributes):
            value = "".join(values).lower()
            if name.lower() == "role":
                if value in AROUND_ROLES:
                    return 2
                continue
            for token in value.split():
                if _names_around(token):
                    if not REMARKS.isdisjoint(PART.findall(token)):
                        return 2
                    level = 1
    return level


class Tokens:
    """Tags and comments of a page in order; what `at` is set beyond is not looked at."""

    def __init__(self, page: str) -> None:
        # Behind the last bracket there is no tag; without this bound, each open one would be looked for up to the page's end.
        self.page, self.at, self.last = page, 0, page.rfind(">") + 1

    def __iter__(self) -> Iterator[re.Match]:
        while m := TOKEN.search(self.page, self.at, self.last):
            # An unclosed comment goes to the end of the page.
            unclosed = m.end() == self.last and (m[0].startswith("<!--") and not m[0].endswith("-->") or m[0].startswith("<![CDATA[") and not m[0].endswith("]]>"))
            self.at = len(self.page) if unclosed else m.end()
            yield m


def _closed(page: str) -> dict[int, int]:
    """Where silent elements that are closed inside their enclosing block end, by the end of their start tag."""
    ends: dict[int, int] = {}
    stack: list[tuple[str, int]] = []
    held: Counter[str] = Counter()
    for m in (tokens := Tokens(page)):
        tag = (m[2] or "").lower()
        if not tag or tag not in BLOCK and tag not in ENDS or tag in VOID:
            continue
        if m[1] == "/":
            while held[tag]:
                t, at = stack.pop()
                held[t] -= 1
                if t == tag:
                    if tag in ENDS:
                        ends[at] = m.end()
                    break
        elif m[3].endswith("/") and tag in ENDS:
            continue
        elif tag in RAW:
            end = ENDS[tag].search(page, m.end())
            tokens.at = end.end() if end else len(page)
        else:
            if tag in UNNESTED and held[tag]:
                while True:
                    t, _ = stack.pop()
                    held[t] -= 1
                    if t == tag:
                        break
            elif tag in OPTIONAL_END and stack and stack[-1][0] == tag:
                held[stack.pop()[0]] -= 1
            stack.append((tag, m.end()))
            held[tag] += 1
    return ends


@dataclass
class Named:
    """An element that surrounds by its class alone: the one around it (-1: none), articles around it, whether a paragraph or heading of one."""

    parent: int
    inside: int
    phrase: bool


Block = tuple[str, int, int, bool, int, bool]


def blocks(page: str, named: list[Named]) -> Iterator[Block]:
    """(text, characters in links, articles around, in what surrounds one, number of the innermost element around it that
    surrounds by its class alone, or -1, whether a heading) of every block in page order; such elements are put into `named`."""
    text: list[str] = []
    linked, anchors, at = 0, 0, 0
    loose, anchor_depth = False, 0
    open_tags: list[tuple[str, int]] = []  # elements that can hold blocks, and whether they surround
    held: Counter[str] = Counter()
    around = inside = 0
    innermost = -1
    heading = False
    ends: dict[int, int] | None = None

    def block() -> Iterator[Block]:
        # References are decoded once a block is whole; white space inside it is one space.
        if text:
            joined = " ".join(html.unescape("".join(text)).split())
            text.clear()
            if joined:
                yield joined, linked, inside, around > 0, innermost, heading

    def opened(tag: str, level: int) -> None:
        nonlocal around, innermost
        open_tags.append((tag, level))
        held[tag] += 1
        around += level == 2
        if level == 1:
            named.append(Named(innermost, inside, inside > 0 and tag in PHRASES))
            innermost = len(named) - 1

    def left() -> str:
        nonlocal around, innermost
        tag, level = open_tags.pop()
        held[tag] -= 1
        around -= level == 2
        if level == 1:
            innermost = named[innermost].parent
        return tag

    for m in (tokens := Tokens(page)):
        if m.start() > at:
            text.append(piece := page[at : m.start()])
            if anchors:
                linked += len(piece)
        at = tokens.at
        tag = (m[2] or "").lower()
        if not tag:
            if m[0].startswith("<![CDATA["):
                text.append(html.escape(m[0][9:].removesuffix("]]>")))
            continue
        closing = m[1] == "/"
        if tag in SILENT:
            if not closing and not m[3].endswith("/"):
                if tag in RAW:
                    end = ENDS[tag].search(page, at)
                    at = tokens.at = end.end() if end else len(page)
                else:
                    # Without an end in its block, it is over at the next block; a head has blocks of the body behind it.
                    ends = _closed(page) if ends is None else ends
                    end = None if at in ends or tag == "head" else NEXT_BLOCK.search(page, at)
                    at = tokens.at = ends.get(at, at if tag == "head" else end.start() if end else len(page))
            if tag in ("head", "title"):
                yield from block()
                linked = 0
            continue
        if tag == "a":
            anchors = int(not closing and LINK.search(m[3]) is not None)
            if anchors:
                after = ANCHOR.search(page, at)
                loose, anchor_depth = after is None or not after[1], len(open_tags)
        elif tag == "br":
            text.append(" ")
        elif tag in BLOCK:
            yield from block()
            linked, heading = 0, not closing and tag in HEADINGS
            if loose:
                anchors = 0
            if tag in OPTIONAL_END:
                # Their ends may be left out; only those that surround an article are remembered, until the next of the kind.
                if open_tags and open_tags[-1][0] == tag:
                    left()
                if not closing and (level := _surrounds(tag, m[3], inside > 0)):
                    opened(tag, level)
                continue
            if not closing and tag not in VOID:
                opened(tag, _surrounds(tag, m[3], inside > 0))
                inside += tag in INSIDE
            elif closing and held[tag]:
                while open_tags:
                    t = left()
                    inside -= t in INSIDE
                    if t == tag:
                        break
                if len(open_tags) < anchor_depth:
                    anchors = 0
    if at < len(page):
        text.append(page[at:])
        linked += len(page) - at if anchors else 0
    yield from block()


def _rescued(found: list[Block], labels: list[int], named: list[Named]) -> list[bool]:
    """Whether each element that surrounds by class holds good blocks of an article, or more good text than is outside of all
    such, or is a paragraph of good text itself, and so do all around it."""
    outside = 0
    own, deepest = [0] * len(named), [0] * len(named)
    for (joined, _, inside, hard, k, _), label in zip(found, labels, strict=True):
        if label > 0 and not hard:
            if k < 0:
                outside += len(joined)
            else:
                own[k] += len(joined)
                deepest[k] = max(deepest[k], inside)
    kept = [False] * len(named)
    for k in range(len(named) - 1, -1, -1):  # inner ones first
        e = named[k]
        kept[k] = own[k] > 0 and (deepest[k] > e.inside or e.phrase and own[k] >= SHORT or own[k] > max(outside, LONG))
        if kept[k] and e.parent >= 0:
            own[e.parent] += own[k]
            deepest[e.parent] = max(deepest[e.parent], deepest[k])
    for k, e in enumerate(named):
        kept[k] = kept[k] and (e.parent < 0 or kept[e.parent])
    return kept


def _density(joined: str) -> float:
    """Share of stop words."""
    words = joined.lower().split()
    return sum(w.strip(".,;:!?\"'()*#%$&") in STOP_WORDS for w in words) / len(words)


def _foreign(joined: str) -> bool:
    """Whether most letters are beyond Latin ones, so that stop words say nothing."""
    letters = sum(map(str.isalpha, joined))
    return 2 * len(BEYOND_LATIN.findall(joined)) > letters > 0


def extract(page: str | None) -> str:
    """Good blocks of a page, joined by an empty line."""
    named: list[Named] = []
    found = list(blocks(page, named)) if page else []
    judged = [None if hard or linked > LINKED * len(joined) and len(joined) < 4 * LONG or len(joined) < SHORT else _density(joined) for joined, linked, _, hard, *_ in found]
    # In a language without a list, length and links decide alone.
    read = [(len(b[0]), d) for b, d in zip(found, judged, strict=True) if d is not None]
    unlisted = sum(n * d for n, d in read) < STOP_NONE * sum(n for n, _ in read) and sum(n for n, _ in read) > 3 * LONG
    labels: list[int] = []  # 1 good, -1 bad, 0 undecided
    for (joined, linked, inside, hard, *_), density in zip(found, judged, strict=True):
        n = len(joined)
        if hard or linked > LINKED * n and n < 4 * LONG:
            labels.append(0 if inside and not hard else -1)
        elif density is None:
            labels.append(1 if n >= SHORT // 2 and linked == 0 and _foreign(joined) else 0)
        elif density < STOP_LOW and (unlisted or _foreign(joined)):
            labels.append(1 if n > LONG or _foreign(joined) else 0)
        else:
            labels.append(1 if density >= STOP_HIGH or n > LONG and density >= STOP_LOW else 0 if inside or density >= STOP_LOW else -1)
    if named:
        kept_around = _rescued(found, labels, named)
        labels = [label if k < 0 or kept_around[k] else -1 for label, (*_, k, _) in zip(labels, found, strict=True)]
    if 1 not in labels:
        return "\n\n".join([b[0] for b, label in zip(found, labels, strict=True) if not label])
    # The nearest decided label on either side and how far it is; an article's edge is a good neighbour.
    kept, after = [], [(0, 0)] * len(found)
    label, at, was = 0, len(found), False
    for i in range(len(found) - 1, -1, -1):
        if found[i][2] and not was:
            label, at = 1, i + 1
        was = found[i][2] > 0
        if labels[i]:
            label, at = labels[i], i
        after[i] = label, at - i
    label, at, was = 0, -1, False
    for i, (joined, _, inside, _, _, heading) in enumerate(found):
        if inside and not was:
            label, at = 1, i - 1
        was = inside > 0
        if labels[i]:
            label, at = labels[i], i
            if label > 0:
                kept.append(joined)
            continue
        (behind, far), near = after[i], i - at
        if inside:
            good = label + behind >= 0 and (label > 0 or behind > 0)
        elif not label or not behind:
            good = label + behind > 0
        else:
            good = (behind if far < near or far == near and heading else label) > 0
        if good:
            kept.append(joined)
    return "\n\n".join(kept)


def main_text(pages: DataFrame, id_col: str = "page_id", html_col: str = "html", keep: tuple[str, ...] = ("url",)) -> DataFrame:
    """One row per page: its id, the kept columns, its main text and that text's length."""
    small_batches(pages.sparkSession)
    wanted = pages.select(id_col, *keep, html_col)
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in wanted.schema[:-1])

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [extract(page) for page in batch.column(batch.num_columns - 1).to_pylist()]
            columns = [*batch.columns[:-1], pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, names=[id_col, *keep, "text", "n_chars"])

    return wanted.mapInArrow(scan, f"{schema}, text string, n_chars long")
