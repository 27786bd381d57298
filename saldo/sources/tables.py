"""Exports as DataFrames with a file and row lineage, and content-addressed results.

CSV goes through Spark's own readers by one rule (RFC 4180) in every encoding. A first pass in
tasks learns each file's encoding, preamble, delimiter and header, and whether a quoted cell holds a
line break; files without such a cell are split among tasks, the others are read a file to a task.
`read_sheets` reads each workbook or archive whole inside a task, from any file system that Spark
reads; larger files than `most_mbytes` and files of an unknown kind raise an error. `saldo.sources.books`
reads them sheet by sheet in bounded memory.
"""

from __future__ import annotations

import csv
import functools
import io
import posixpath
import re
import zipfile
from collections import defaultdict
from collections.abc import Callable, Iterator, Sequence
from typing import IO, NamedTuple
from urllib.parse import unquote
from xml.etree import ElementTree

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from saldo.functions.text import clean_cell

# Marks of encodings, encodings in the order in which equal ones are taken, and delimiters of a header line.
MARKS = {b"\xef\xbb\xbf": "utf-8-sig", b"\xff\xfe": "utf-16", b"\xfe\xff": "utf-16"}
ENCODINGS = ("utf-8-sig", "gb18030", "big5", "utf-16")
DELIMITERS = ",\t;|"
#: Spark's names of encodings, and what a file's first bytes are at most.
CHARSETS = {"utf-8-sig": "UTF-8", "utf-8": "UTF-8", "gb18030": "GB18030", "big5": "Big5", "utf-16": "UTF-16"}
HEAD = 65536
CELLS = "file string, sheet string, row_no long, cells array<string>"
RELATIONS = "xl/_rels/workbook.xml.rels"
MAIN = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"


def _usual(char: str) -> bool:
    """Whether a character beyond ASCII is one that people write: the first level of a Chinese set, its marks and forms, kana, a Latin letter."""
    if "\u4e00" <= char <= "\u9fff":
        # The first level of either set holds its frequent characters: rows B0 to D7 of the one, A4 to C6 of the other.
        simple, full = char.encode("gb2312", "ignore"), char.encode("big5", "ignore")
        return bool(simple) and simple[0] <= 0xD7 or bool(full) and full[0] <= 0xC6
    return "\u3000" <= char <= "\u30ff" or "\uff00" <= char <= "\uffef" or "\u2010" <= char <= "\u203b" or "\xa0" <= char <= "\u024f" or char == "\u20ac"


def quality(text: str) -> float:
    """Share of characters beyond ASCII that are usual ones; control characters count as unusual."""
    odd = [c for c in text if c > "\x7e" or c < " " and c not in "\t\r\n"]
    return sum(map(_usual, odd)) / len(odd) if odd else 1.0


def _decoded(head: bytes, encoding: str) -> str | None:
    try:
        return head.decode(encoding)
    except UnicodeDecodeError as e:
        return head[: e.start].decode(encoding) if 0 < e.start and e.start >= len(head) - 4 else None  # a character cut off at the end


def sniffed(head: bytes) -> tuple[str, str, int]:
    """(encoding, delimiter, lines before the header) from a file's first bytes: by its mark, or else the decoding of the best quality."""
    marked = [e for mark, e in MARKS.items() if head.startswith(mark)]
    told = {e: text for e in marked or ENCODINGS if (text := _decoded(head, e)) is not None}
    encoding = max(told, key=lambda e: quality(told[e]), default="utf-8")
    lines = told.get(encoding, head.decode("utf-8", "replace")).splitlines()
    skip = next((i for i, line in enumerate(lines[:30]) if line.strip() and not line.startswith("#")), 0)
    header = lines[skip] if lines else ""
    return encoding, max(DELIMITERS, key=header.count), skip


class SourceError(ValueError):
    """A file that cannot be read whole."""


def _names(head: bytes, encoding: str, delimiter: str, skip: int) -> tuple[str, ...]:
    lines = head.decode(encoding, "ignore").splitlines(keepends=True)[skip:]
    return tuple(n.lstrip("\ufeff").strip() for n in next(csv.reader(lines, delimiter=delimiter), []))


def _literal(path: str) -> str:
    """A path whose name holds no patterns."""
    return re.sub(r"([\[\]{}*?\\])", r"\\\1", path)


def csv_layouts(spark: SparkSession, path: str) -> DataFrame:
    """(uri, encoding, delimiter, names, broken) of every CSV file that is not empty, found in tasks; broken: some quoted cell may hold a line break."""
    lines = spark.read.option("lineSep", "\n").text(path).select(F.col("value").cast("binary"), "_metadata.file_path", "_metadata.file_block_start")

    def looked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """One row for each run of lines of a file: its head if it is the file's start, and whether a line has an odd number of quotes."""
        now, head = None, None
        for batch in batches:
            value, uri, start = batch.columns
            odd = pc.fill_null(pc.equal(pc.bit_wise_and(pc.count_substring(value, '"'), 1), 1), False)
            cuts = [0, *(i + 1 for i in np.flatnonzero(pc.or_(pc.not_equal(uri[1:], uri[:-1]), pc.not_equal(start[1:], start[:-1])).to_numpy(zero_copy_only=False))), len(batch)]
            out = []
            for a, b in zip(cuts, cuts[1:], strict=False):
                if a == b:
                    continue
                if (at := (uri[a].as_py(), start[a].as_py())) != now:
                    now, head = at, bytearray() if at[1] == 0 else None
                if head is not None:
                    for i in range(a, b):
                        if len(head) >= HEAD:
                            break
                        head += value[i].as_py()[:HEAD] + b"\n"
                    out.append((at[0], bytes(head[:HEAD]), pc.any(odd[a:b]).as_py()))
                    if len(head) >= HEAD:
                        head = None
                else:
                    out.append((at[0], None, pc.any(odd[a:b]).as_py()))
            yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in out], t) for i, t in enumerate((pa.string(), pa.binary(), pa.bool_()))], names=["uri", "head", "odd"])

    def told(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for uri, head, odd in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                encoding, delimiter, skip = sniffed(head)
                rows.append((uri, encoding, delimiter, list(_names(head, encoding, delimiter, skip)), odd or encoding == "utf-16"))
            types = (pa.string(), pa.string(), pa.string(), pa.list_(pa.string()), pa.bool_())
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate(types)], names=["uri", "encoding", "delimiter", "names", "broken"])

    # A head that goes on in a later batch is the longer one.
    longest = F.max_by("head", F.length("head"))
    files = lines.mapInArrow(looked, "uri string, head binary, odd boolean").groupBy("uri").agg(longest.alias("head"), F.bool_or("odd").alias("odd"))
    return files.mapInArrow(told, "uri string, encoding string, delimiter string, names array<string>, broken boolean")


def read_csv(spark: SparkSession, path: str) -> DataFrame:
    """A CSV export with all columns as cleaned text; comment lines and blank rows are left out.

    Files of one layout are read together (a line of each comes to the driver); a column that
    a file has not is null there. Quotes, doubled quotes, line breaks and backslashes inside quotes are
    read alike in every encoding. Spark splits the files among tasks, but for those in UTF-16
    and those with quoted line breaks, which are read a file to a task.
    """
    layouts: dict[tuple, list[str]] = defaultdict(list)
    for r in csv_layouts(spark, path).collect():
        layouts[r["encoding"], r["delimiter"], tuple(r["names"]), r["broken"]].append(unquote(r["uri"]))
    if not layouts:
        raise SourceError(f"no files in {path}")
    out = None
    for (encoding, delimiter, _, broken), files in sorted(layouts.items()):
        part = _spark_csv(spark, path if len(layouts) == 1 else [_literal(place) for place in sorted(files)], encoding, delimiter, broken)
        out = part if out is None else out.unionByName(part, allowMissingColumns=True)
    return out.select(*[c for c in out.columns if c != "file"], "file")


def charset_of(spark: SparkSession, encoding: str) -> str:
    """Spark's name of an encoding. Those beyond Unicode need a setting of the session, which has to last until the rows are read."""
    if not encoding.startswith("utf"):
        spark.conf.set("spark.sql.legacy.javaCharsets", "true")
    return CHARSETS[encoding]


def _spark_csv(spark: SparkSession, path: str | list[str], encoding: str, delimiter: str, broken: bool) -> DataFrame:
    raw = spark.read.csv(path, header=True, sep=delimiter, encoding=charset_of(spark, encoding), comment="#", quote='"', escape='"', multiLine=broken, inferSchema=False, ignoreLeadingWhiteSpace=True, ignoreTrailingWhiteSpace=True)
    cells = raw.select(*[clean_cell(F.col(f"`{c}`")).alias(c.lstrip("\ufeff").strip()) for c in raw.columns], F.col("_metadata.file_name").alias("file"))
    return cells.where(F.coalesce(*[F.col(f"`{c}`") for c in cells.columns if c != "file"]).isNotNull())


def write_csv(df: DataFrame, path: str, encoding: str = "utf-8-sig") -> None:
    """A table as CSV files with a header in one of the encodings that `read_csv` tells; cells with quotes or line breaks are quoted."""
    df.write.csv(path, header=True, encoding=charset_of(df.sparkSession, encoding), quote='"', escape='"', quoteAll=False)


def _column(reference: str) -> int:
    return _number_of(reference.rstrip("0123456789"))


@functools.lru_cache(1 << 14)
def _number_of(letters: str) -> int:
    n = 0
    for letter in letters:
        n = 26 * n + ord(letter) - 64
    return n - 1


def _mentions(book: zipfile.ZipFile, part: str, word: bytes) -> bool:
    """Whether a word stands anywhere in a part's bytes: tells parts that need no parsing for it."""
    with book.open(part) as stream:
        end = b""
        while chunk := stream.read(1 << 20):
            if word in end + chunk:
                return True
            end = chunk[1 - len(word) :]
    return False


def _elements(book: zipfile.ZipFile, part: str, tag: str) -> Iterator[ElementTree.Element]:
    """Elements of a part as they are read; none is kept."""
    with book.open(part) as stream:
        wanted, inside = MAIN + tag, 0
        open_elements: list[ElementTree.Element] = []
        for event, element in ElementTree.iterparse(stream, ("start", "end")):
            if event == "start":
                open_elements.append(element)
                inside += element.tag == wanted
                continue
            open_elements.pop()
            if element.tag == wanted:
                inside -= 1
                yield element
            if open_elements and not inside:
                open_elements[-1].remove(element)


def _rows(book: zipfile.ZipFile, part: str, shared: Sequence[str]) -> Iterator[tuple[int, dict[int, str | None]]]:
    """(row number, cells by column) of a sheet; merged cells, which stand behind all rows, are read first, and a row is held at a time."""
    merged: list[tuple[int, int, int, int]] = []
    # A sheet that is not plainly in an encoding of single bytes is parsed in any case.
    with book.open(part) as stream:
        mark = stream.read(2)
        plain = mark[:1] == b"<" and mark[1:] != b"\0"
    for m in _elements(book, part, "mergeCell") if not plain or _mentions(book, part, b"mergeCell") else ():
        first, _, last = m.get("ref").partition(":")
        top, bottom = (int(re.search("[0-9]+", x)[0]) for x in (first, last or first))
        merged.append((top, bottom, _column(first), _column(last or first)))
    merged.sort()
    begun, filled, at_row = 0, [], 0  # filled: (last row, first column, last column, value) of merged cells that reach further down

    def whole(r: int, at: dict[int, str | None]) -> tuple[int, dict[int, str | None]]:
        nonlocal begun, filled
        while begun < len(merged) and merged[begun][0] <= r:
            top, bottom, left, right = merged[begun]
            filled.append((bottom, left, right, at.get(left) if top == r else None))
            begun += 1
        for _, left, right, value in filled:
            at.update(dict.fromkeys(range(left, right + 1), value))
        filled = [f for f in filled if f[0] > r]
        return r, at

    def between(last: int) -> Iterator[tuple[int, dict[int, str | None]]]:
        """Rows that only merged cells reach."""
        r = at_row + 1
        while r < last:
            if filled or begun < len(merged) and merged[begun][0] == r:
                yield whole(r, {})
                r += 1
            elif begun < len(merged):
                r = merged[begun][0]
            else:
                return

    for row in _elements(book, part, "row"):
        r, at = int(row.get("r")), {}
        for cell in row.iter(f"{MAIN}c"):
            value = cell.findtext(f"{MAIN}v")
            if cell.get("t") == "s" and value is not None:
                value = shared[int(value)]
            elif cell.get("t") == "inlineStr":
                value = "".join(t.text or "" for t in cell.iter(f"{MAIN}t"))
            at[_column(cell.get("r"))] = value
        yield from between(r)
        yield whole(r, at)
        at_row = r
    yield from between(max((m[1] for m in merged), default=0) + 1)


class Sheet(NamedTuple):
    """A sheet of a workbook: the part that holds it, whether it is hidden, and whether the workbook counts days from 1904."""

    name: str
    part: str
    hidden: bool
    from_1904: bool


def sheets(book: zipfile.ZipFile) -> list[Sheet]:
    """The sheets of a workbook that have cells, in its order."""
    names, parts, out = set(book.namelist()), {}, []
    if RELATIONS in names:
        parts = {r.get("Id"): r for r in ElementTree.fromstring(book.read(RELATIONS))}
    root = ElementTree.fromstring(book.read("xl/workbook.xml"))
    settings = root.find(f"{MAIN}workbookPr")
    from_1904 = settings is not None and settings.get("date1904", "").lower() in ("1", "true")
    for i, entry in enumerate(root.iter(f"{MAIN}sheet"), 1):
        name, part = entry.get("name"), f"xl/worksheets/sheet{i}.xml"
        if relation := next((v for k, v in entry.items() if k.endswith("}id")), None) if parts else None:
            if relation in parts and not parts[relation].get("Type", "/worksheet").endswith("/worksheet"):
                continue  # a sheet of charts or dialogs has no cells
            part = posixpath.normpath(posixpath.join("/xl", parts[relation].get("Target"))).lstrip("/") if relation in parts else relation
        if part not in names:
            raise SourceError(f"sheet {name} has no part {part}")
        out.append(Sheet(name, part, entry.get("state", "visible") != "visible", from_1904))
    return out


def shared_strings(book: zipfile.ZipFile) -> Iterator[str]:
    if "xl/sharedStrings.xml" in book.namelist():
        for item in _elements(book, "xl/sharedStrings.xml", "si"):
            yield "".join(t.text or "" for t in item.iter(f"{MAIN}t"))


def sheet_rows(book: zipfile.ZipFile, part: str, shared: Sequence[str]) -> Iterator[tuple[int, list[str | None]]]:
    """(row number, cells) of a sheet's part as it is read; merged cells all hold the first one's value."""
    for r, at in _rows(book, part, shared):
        yield r, [at.get(c) for c in range(max(at, default=-1) + 1)]


def workbook(content: bytes) -> Iterator[tuple[str, int, list[str | None]]]:
    """(sheet, row number, cells) of a workbook."""
    book = zipfile.ZipFile(io.BytesIO(content))
    shared = list(shared_strings(book))
    for sheet in sheets(book):
        yield from ((sheet.name, r, cells) for r, cells in sheet_rows(book, sheet.part, shared))


class ArchiveError(ValueError):
    """An archive that the policy refuses."""


def checked_entries(archive: zipfile.ZipFile, most_files: int, most_bytes: int, most_ratio: int) -> list[tuple[str, zipfile.ZipInfo]]:
    """(name, entry) of an archive's files; unsafe names, sizes and ratios are refused."""
    entries = [e for e in archive.infolist() if not e.is_dir()]
    if len(entries) > most_files or sum(e.file_size for e in entries) > most_bytes:
        raise ArchiveError("too many or too large members")
    out = []
    for e in entries:
        name = e.filename if e.flag_bits & 0x800 else e.filename.encode("cp437", "replace").decode("gbk", "replace")
        if name.startswith("/") or ".." in posixpath.normpath(name).split("/") or e.file_size > most_ratio * max(1, e.compress_size):
            raise ArchiveError(f"unsafe member {name}")
        out.append((name, e))
    return out


def members(content: bytes, depth: int = 2, most_files: int = 1000, most_bytes: int = 1 << 30, most_ratio: int = 200) -> Iterator[tuple[str, bytes]]:
    """(name, content) of an archive's files, archives inside it too; what the policy refuses is an error."""
    archive = zipfile.ZipFile(io.BytesIO(content))
    for name, e in checked_entries(archive, most_files, most_bytes, most_ratio):
        data = archive.read(e)
        if name.lower().endswith(".zip"):
            if depth <= 1:
                raise ArchiveError("archives are nested too deep")
            yield from ((f"{name}!{inner}", x) for inner, x in members(data, depth - 1, most_files, most_bytes, most_ratio))
        else:
            yield name, data


def _cells(name: str, content: bytes) -> Iterator[tuple[str, str, int, list[str | None]]]:
    low = name.lower()
    if low.endswith(".zip"):
        for inner, data in members(content):
            yield from ((f"{name}!{f}", s, r, c) for f, s, r, c in _cells(inner, data))
    elif low.endswith(".xlsx"):
        yield from ((name, s, r, c) for s, r, c in workbook(content))
    elif low.endswith((".csv", ".txt")):
        yield from _delimited(name, content)
    else:
        raise SourceError(f"{name} is of an unknown kind")


def _delimited(name: str, content: bytes) -> Iterator[tuple[str, str, int, list[str | None]]]:
    yield from ((name, "", r, row) for r, row in delimited_rows(lambda: io.BytesIO(content)))


def delimited_rows(opened: Callable[[], IO[bytes]]) -> Iterator[tuple[int, list[str | None]]]:
    """(record number, cells) of delimited text as it is read, in its own encoding, without comments; the file is opened twice."""
    with opened() as stream:
        encoding, delimiter, _ = sniffed(stream.read(HEAD))
    with opened() as stream, io.TextIOWrapper(stream, encoding, "replace", newline="") as text:
        for r, row in enumerate(csv.reader(text, delimiter=delimiter), 1):
            if row and not row[0].startswith("#"):
                yield r, row


def _cleaned(rows: DataFrame) -> DataFrame:
    cleaned = rows.withColumn("cells", F.transform("cells", lambda c: clean_cell(c)))
    return cleaned.where(F.exists("cells", lambda c: c.isNotNull()))


def _whole_files(found: DataFrame, most_mbytes: int, cells: Callable[[str, bytes], Iterator[tuple]]) -> DataFrame:
    """Rows of binary files, a file to a task; a file above the limit raises an error before any is read."""
    large = found.where(F.col("length") > most_mbytes << 20).select("path", "length").limit(1).collect()
    if large:
        raise SourceError(f"{large[0]['path']} has {large[0]['length']} bytes, more than {most_mbytes} MB")

    def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for name, content in zip(batch["path"], batch["content"], strict=True):
                rows = []
                for row in cells(posixpath.basename(name), bytes(content)):
                    rows.append(row)
                    if len(rows) == 10_000:
                        yield pd.DataFrame(rows, columns=["file", "sheet", "row_no", "cells"])
                        rows = []
                if rows:
                    yield pd.DataFrame(rows, columns=["file", "sheet", "row_no", "cells"])

    return _cleaned(found.select("path", "content").mapInPandas(scan, CELLS))


def read_sheets(spark: SparkSession, path: str, most_mbytes: int = 256) -> DataFrame:
    """(file, sheet, row_no, cells) of workbooks, CSV files and archives of them."""
    return _whole_files(spark.read.format("binaryFile").load(path), most_mbytes, _cells)


def bound(cells: DataFrame, columns: dict[str, int]) -> DataFrame:
    """Cells by position under the roles that a template gives them, with their lineage."""
    return cells.select("file", "sheet", "row_no", *[F.get("cells", F.lit(i)).alias(role) for role, i in columns.items()])
