"""Personal data by anchor expansion.

An Aho-Corasick automaton finds at-signs, plus signs, digits, schemes and
identifier cues; from each anchor a local parser grows a span and validates it.
Base kinds (email, ip, card, phone) follow fixed patterns; added kinds (login,
secret, iban, street) need a cue beside them, so ordinary prose has none.

Edge cases: a null text counts as empty and has no spans; spans of one kind
never overlap; the same text always gives the same spans; an empty table gives
an empty result; other columns of the input are left alone.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame

from saldo.llm.arrays import small_batches

BASE_KINDS = ("email", "ip", "card", "phone")
ADDED_KINDS = ("login", "secret", "iban", "street")
RANK = {kind: i for i, kind in enumerate(BASE_KINDS + ADDED_KINDS)}

# Cues beside which the added kinds are looked for.
SECRET_CUES = ("token", "secret", "password", "passwd", "api_key", "apikey", "access_key", "private_key")
STREET_CUES = ("street", "avenue", "road", "boulevard", "straße", "strasse", "rue", "calle", "avenida")

LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
DIGITS = frozenset("0123456789")
DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
DOTTED = re.compile(r"[0-9]+(?:\.[0-9]+){3}")
GROUPED = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
DIALLED = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
USERINFO = re.compile(r"[A-Za-z0-9._%+-]+:[^\s@/]+@[A-Za-z0-9.-]+")
ASSIGNED = re.compile(r"""["']?\s{0,3}[:=]\s{0,3}(["']?)([A-Za-z0-9+/_.-]{12,})\1""")
IBAN = re.compile(r"[:\s]{0,3}([A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?)(?![A-Za-z0-9])")
HOUSE_BEFORE = re.compile(r"(?<![A-Za-z0-9])[0-9]{1,5}[A-Za-z]?,? (?:[A-Z][\w'-]{0,30} ){1,3}\Z")
HOUSE_AFTER = re.compile(r"(?: [\w'-]{1,30}){0,4},? [0-9]{1,5}[a-zA-Z]?(?![0-9])")


def _anchors() -> ahocorasick.Automaton:
    found = ahocorasick.Automaton()
    for kind, words in (("@", ["@"]), ("+", ["+"]), ("0", sorted(DIGITS)), ("://", ["://"])):
        for word in words:
            found.add_word(word, (kind, len(word)))
    for kind, cues in (("secret", SECRET_CUES), ("iban", ("iban",)), ("street", STREET_CUES)):
        for cue in cues:
            for form in {cue, cue.capitalize(), cue.upper()}:
                found.add_word(form, (kind, len(form)))
    found.make_automaton()
    return found


_AUTOMATON: list[ahocorasick.Automaton] = []


def octet(part: str) -> bool:
    """Whether digits, of which there may be any number, make 255 at most."""
    part = part.lstrip("0")
    return len(part) < 3 or len(part) == 3 and part <= "255"


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(map(int, reversed(digits))):
        total += d if i % 2 == 0 else d * 2 - 9 * (d > 4)
    return total % 10 == 0


def mod97(code: str) -> bool:
    moved = code[4:] + code[:4]
    return int("".join(str(int(c, 36)) for c in moved)) % 97 == 1


def _email(text: str, at: int, floor: int) -> tuple[int, int] | None:
    start = at
    while start > floor and text[start - 1] in LOCAL:
        start -= 1
    tail = DOMAIN.match(text, at + 1) if start < at else None
    return (start, tail.end()) if tail else None


def _added(kind: str, text: str, start: int, end: int) -> tuple[str, int, int] | None:
    if kind == "://":
        m = USERINFO.match(text, end)
        return ("login", m.start(), m.end()) if m else None
    if kind == "secret":
        m = ASSIGNED.match(text, end)
        ok = m and sum(c in DIGITS for c in m[2]) >= 3
        return ("secret", m.start(2), m.end(2)) if ok else None
    if start and (text[start - 1].isalnum()):
        return None
    if kind == "iban":
        m = IBAN.match(text, end)
        code = m[1].replace(" ", "") if m else ""
        return ("iban", m.start(1), m.end(1)) if 15 <= len(code) <= 34 and mod97(code) else None
    low = max(0, start - 110)
    m = HOUSE_BEFORE.search(text[low:start]) if end == len(text) or not text[end].isalnum() else None
    if m:
        return "street", low + m.start(), end
    m = HOUSE_AFTER.match(text, end) if text[end : end + 1] == " " else None
    return ("street", start, m.end()) if m else None


def find(text: str | None) -> list[tuple[str, int, int]]:
    """(kind, start, end) of every span, by start and then in the order of the kinds."""
    if not text:
        return []
    if not _AUTOMATON:
        _AUTOMATON.append(_anchors())
    spans: list[tuple[str, int, int]] = []
    done = dict.fromkeys(("email", "ip", "card", "phone", *ADDED_KINDS), 0)
    for last, (kind, length) in _AUTOMATON[0].iter(text):
        start = last + 1 - length
        if kind == "0":
            if start >= done["card"] and (m := GROUPED.match(text, start)):
                done["card"] = m.end()
                digits = "".join(c for c in m[0] if c in DIGITS)
                if 12 <= len(digits) <= 19 and luhn(digits):
                    spans.append(("card", *m.span()))
            # A run of digits starts here, or an earlier address used up what stands before.
            if start >= done["ip"] and (not start or start == done["ip"] or text[start - 1] not in DIGITS) and (m := DOTTED.match(text, start)):
                done["ip"] = m.end()
                if all(map(octet, m[0].split("."))):
                    spans.append(("ip", *m.span()))
        elif kind == "@":
            if found := _email(text, start, done["email"]):
                done["email"] = found[1]
                spans.append(("email", *found))
        elif kind == "+":
            if start >= done["phone"] and (m := DIALLED.match(text, start)):
                done["phone"] = m.end()
                if 9 <= sum(c in DIGITS for c in m[0]) <= 15:
                    spans.append(("phone", *m.span()))
        elif (added := _added(kind, text, start, last + 1)) and added[1] >= done[added[0]]:
            done[added[0]] = added[2]
            spans.append(added)
    return sorted(spans, key=lambda s: (s[1], RANK[s[0]]))


def written(spans: list[tuple[str, int, int]]) -> str:
    return ",".join(f"{kind}:{start}:{end}" for kind, start, end in spans)


def redact(text: str | None, spans: list[tuple[str, int, int]] | None = None) -> str | None:
    """The text with every maximal run of overlapping spans replaced by the kind that starts it."""
    if text is None:
        return None
    parts, at, spans = [], 0, find(text) if spans is None else spans
    for kind, start, end in spans:
        if start >= at:
            parts += [text[at:start], f"<{kind.upper()}>"]
        at = max(at, end)
    return "".join([*parts, text[at:]])


SCHEMA = "n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string"


def detect(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: counts of the base kinds, digest of the base spans, all spans."""
    small_batches(docs.sparkSession)
    kind = docs.schema[id_col].dataType.simpleString()

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows: list[list] = [[] for _ in range(6)]
            for text in batch.column(1).to_pylist():
                spans = find(text)
                base = [s for s in spans if RANK[s[0]] < len(BASE_KINDS)]
                for out, name in zip(rows, BASE_KINDS, strict=False):
                    out.append(sum(s[0] == name for s in base))
                rows[4].append(hashlib.sha256(written(base).encode()).hexdigest())
                rows[5].append(written(spans))
            columns = [batch.column(0), *(pa.array(r, pa.int64()) for r in rows[:4]), *(pa.array(r, pa.string()) for r in rows[4:])]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans"])

    return docs.select(id_col, text_col).mapInArrow(scan, f"doc_id {kind}, {SCHEMA}")


def clean(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """The same rows and columns with personal data in the texts replaced by its kind in angle brackets."""
    small_batches(docs.sparkSession)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = batch.schema.get_field_index(text_col)
            texts = pa.array([redact(t) for t in batch.column(at).to_pylist()], pa.string())
            yield pa.RecordBatch.from_arrays([texts if i == at else c for i, c in enumerate(batch.columns)], schema=batch.schema.set(at, pa.field(text_col, pa.string())))

    return docs.mapInArrow(scan, docs.schema)
