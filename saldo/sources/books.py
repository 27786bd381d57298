"""Workbooks, delimited files and archives of them as a Spark data source: a task for every sheet or file, read by seeking.

A partition is a sheet or a delimited file, wherever it lies in archives inside archives; only directories
of archives and workbooks are read to find them. A task holds a row, the sheet's merged ranges and the
workbook's shared strings in compressed blocks, so its memory does not grow with the sheet. Files are opened
through Arrow's file systems (local, HDFS, S3, GCS, Azure), which can seek where Spark's binary reader cannot.
"""

from __future__ import annotations

import contextlib
import datetime
import fnmatch
import functools
import io
import itertools
import json
import posixpath
import re
import zipfile
import zlib
from collections.abc import Iterable, Iterator, Mapping, Sequence
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass
from typing import IO
from xml.sax.saxutils import escape

import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.types import StructType

from saldo.functions.text import clean_cell, fold_header, parse_date, parse_number
from saldo.sources.tables import MAIN, RELATIONS, ArchiveError, SourceError, checked_entries, delimited_rows, shared_strings, sheet_rows, sheets

FORMAT = "saldo_books"
SCHEMA = "file string, sheet string, row_no long, cells array<string>, hidden boolean, epoch date"
ARROW = pa.schema([("file", pa.string()), ("sheet", pa.string()), ("row_no", pa.int64()), ("cells", pa.list_(pa.string())), ("hidden", pa.bool_()), ("epoch", pa.date32())])
#: Names of the format, the rows of a sheet, what XML holds, and the days that workbooks count from.
OFFICE = "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
PACKAGE = "http://schemas.openxmlformats.org/package/2006/relationships"
SPREADSHEET = "application/vnd.openxmlformats-officedocument.spreadsheetml"
MOST_ROWS = 1 << 20
UNFIT = re.compile("[^\t\n\r\x20-\ud7ff\ue000-\ufffd\U00010000-\U0010ffff]")
EPOCH, EPOCH_1904 = datetime.date(1899, 12, 30), datetime.date(1904, 1, 1)
#: What a record batch and a block of shared strings hold, how many blocks are kept open, how many files are looked into at a time.
ROWS, BYTES, BLOCK, OPEN, LOOKED = 10_000, 8 << 20, 256, 32, 16


class Strings:
    """Shared strings by number, in compressed blocks of which the last used are open: a random one costs a block, one nearby nothing."""

    def __init__(self, texts: Iterable[str]) -> None:
        self.blocks, block = [], []
        for t in texts:
            block.append(t)
            if len(block) == BLOCK:
                self.blocks.append(self._packed(block))
                block = []
        self.blocks.append(self._packed(block))
        self._open = functools.lru_cache(OPEN)(lambda i: json.loads(zlib.decompress(self.blocks[i])))

    @staticmethod
    def _packed(block: list[str]) -> bytes:
        return zlib.compress(json.dumps(block).encode(), 1)

    def __getitem__(self, i: int) -> str:
        return self._open(i // BLOCK)[i % BLOCK]


@dataclass
class Part(InputPartition):
    """A sheet or a delimited file: the file's address, the numbers of the entries that lead to it, and what it is called."""

    uri: str
    chain: tuple[int, ...]
    file: str
    sheet: str = ""
    part: str | None = None
    hidden: bool = False
    from_1904: bool = False


@dataclass
class Policy:
    """What archives may hold: files, bytes unpacked, how much they may shrink, and how deep they may be nested."""

    most_files: int = 1000
    most_bytes: int = 1 << 40
    most_ratio: int = 200
    depth: int = 2


def located(address: str) -> tuple[fs.FileSystem, str]:
    """The file system and path of an address or of a local path."""
    if "://" not in address and not address.startswith("file:"):
        return fs.LocalFileSystem(), posixpath.abspath(address)
    scheme, _, rest = address.partition(":")
    if scheme == "file":
        return fs.LocalFileSystem(), "/" + rest.lstrip("/")
    return fs.FileSystem.from_uri(f"{'s3' if scheme in ('s3a', 's3n') else scheme}:{rest}")


def found(path: str) -> list[tuple[str, str]]:
    """(address, name) of a file, of a folder's files, or of the files that a pattern in the last step of a path matches; hidden ones are left out."""
    system, place = located(path)
    prefix = path[: len(path) - len(place)] if path.endswith(place) else ""
    info = system.get_file_info(place)
    if info.type == fs.FileType.File:
        return [(path, posixpath.basename(place))]
    folder, pattern = (place, "*") if info.type == fs.FileType.Directory else posixpath.split(place)
    names = [(f.path, f.base_name) for f in system.get_file_info(fs.FileSelector(folder, allow_not_found=True)) if f.type == fs.FileType.File and f.base_name[0] not in "._" and fnmatch.fnmatchcase(f.base_name, pattern)]
    if not names:
        raise SourceError(f"no files in {path}")
    return sorted((prefix + p, n) for p, n in names)


@contextlib.contextmanager
def opened(uri: str, chain: Iterable[int] = ()) -> Iterator[IO[bytes]]:
    """A file, or an entry inside archives, as a stream that can seek."""
    with contextlib.ExitStack() as stack:
        system, place = located(uri)
        stream = stack.enter_context(io.BufferedReader(system.open_input_file(place), 1 << 20))
        for i in chain:
            archive = stack.enter_context(zipfile.ZipFile(stream))
            stream = stack.enter_context(archive.open(archive.infolist()[i]))
        yield stream


def parts(stream: IO[bytes], uri: str, name: str, policy: Policy, chain: tuple[int, ...] = (), file: str | None = None) -> Iterator[Part]:
    """The sheets and delimited files of a file, by the directories of its archives and workbooks."""
    low, file = name.lower(), file or name
    if low.endswith(".zip"):
        if len(chain) >= policy.depth:
            raise ArchiveError("archives are nested too deep")
        with zipfile.ZipFile(stream) as archive:
            numbers = {id(e): i for i, e in enumerate(archive.infolist())}
            for inner, entry in checked_entries(archive, policy.most_files, policy.most_bytes, policy.most_ratio):
                with archive.open(entry) as content:
                    yield from parts(content, uri, inner, policy, (*chain, numbers[id(entry)]), f"{file}!{inner}")
    elif low.endswith(".xlsx"):
        with zipfile.ZipFile(stream) as book:
            yield from (Part(uri, chain, file, s.name, s.part, s.hidden, s.from_1904) for s in sheets(book))
    elif low.endswith((".csv", ".txt")):
        yield Part(uri, chain, file)
    else:
        raise SourceError(f"{file} is of an unknown kind")


def rows(part: Part) -> Iterator[tuple[int, list[str | None]]]:
    """(row number, cells) of a partition, as they are read."""
    if part.part is None:
        yield from delimited_rows(lambda: opened(part.uri, part.chain))
        return
    with opened(part.uri, part.chain) as stream, zipfile.ZipFile(stream) as book:
        yield from sheet_rows(book, part.part, Strings(shared_strings(book)))


class BookReader(DataSourceReader):
    def __init__(self, options: Mapping[str, str]) -> None:
        self.path = options["path"]
        self.policy = Policy(*(int(options.get(name, default)) for name, default in (("maxFiles", Policy.most_files), ("maxBytes", Policy.most_bytes), ("maxRatio", Policy.most_ratio), ("depth", Policy.depth))))

    def partitions(self) -> list[Part]:
        def looked(file: tuple[str, str]) -> list[Part]:
            with opened(file[0]) as stream:
                return list(parts(stream, *file, self.policy))

        with ThreadPoolExecutor(LOOKED) as pool:
            return [p for some in pool.map(looked, found(self.path)) for p in some]

    def read(self, part: Part) -> Iterator[pa.RecordBatch]:
        numbers, cells, size = [], [], 0
        for r, row in rows(part):
            numbers.append(r)
            cells.append(row)
            size += sum(len(c) for c in row if c) + 8 * len(row)
            if len(numbers) == ROWS or size > BYTES:
                yield self._batch(part, numbers, cells)
                numbers, cells, size = [], [], 0
        if numbers:
            yield self._batch(part, numbers, cells)

    @staticmethod
    def _batch(part: Part, numbers: list[int], cells: list[list[str | None]]) -> pa.RecordBatch:
        same = [part.file, part.sheet], [part.hidden, EPOCH_1904 if part.from_1904 else EPOCH]
        columns = [[same[0][0]] * len(numbers), [same[0][1]] * len(numbers), numbers, cells, [same[1][0]] * len(numbers), [same[1][1]] * len(numbers)]
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, ARROW, strict=True)], schema=ARROW)


class Books(DataSource):
    """spark.read.format("saldo_books"), with the options maxFiles, maxBytes, maxRatio and depth for archives."""

    @classmethod
    def name(cls) -> str:
        return FORMAT

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema: StructType) -> BookReader:
        return BookReader(self.options)


def read_books(spark: SparkSession, path: str, **options: int) -> DataFrame:
    """(file, sheet, row_no, cells, hidden, epoch) of workbooks, delimited files and archives of them: cleaned cells, rows without any left out.

    What the options refuse, files of an unknown kind, broken archives and a path without files are errors; a
    workbook without sheets or a sheet without rows gives none.
    """
    spark.dataSource.register(Books)
    told = spark.read.format(FORMAT).options(**options).load(path)
    return told.withColumn("cells", F.transform("cells", lambda c: clean_cell(c))).where(F.exists("cells", lambda c: c.isNotNull()))


def _letters(column: int) -> str:
    return (_letters(column // 26 - 1) if column >= 26 else "") + chr(65 + column % 26)


def _sheet(stream: IO[bytes], names: Sequence[str], told: Iterator[Sequence[str | None]]) -> int:
    """Write a header and up to a sheet's number of rows as they come; how many came."""
    count = 0
    stream.write(f'<worksheet xmlns="{MAIN[1:-1]}"><sheetData>'.encode())
    for r, row in enumerate(itertools.chain([names], itertools.islice(told, MOST_ROWS - 1)), 1):
        cells = "".join(f'<c r="{_letters(i)}{r}" t="inlineStr"><is><t xml:space="preserve">{escape(UNFIT.sub("", v))}</t></is></c>' for i, v in enumerate(row) if v is not None)
        stream.write(f'<row r="{r}">{cells}</row>'.encode())
        count = r - 1
    stream.write(b"</sheetData></worksheet>")
    return count


def _book(out: IO[bytes], names: Sequence[str], told: Iterator[Sequence[str | None]]) -> int:
    """Write rows as a workbook of as many sheets as they need, a row held at a time; how many there were."""
    total, n = 0, 0
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED, allowZip64=True) as book:
        more = next(told, None)
        while more is not None or n == 0:
            n += 1
            with book.open(f"xl/worksheets/sheet{n}.xml", "w", force_zip64=True) as stream:
                total += _sheet(stream, names, itertools.chain([more], told) if more is not None else told)
            more = next(told, None)
        entries = "".join(f'<sheet name="Sheet{i}" sheetId="{i}" r:id="rId{i}"/>' for i in range(1, n + 1))
        book.writestr("xl/workbook.xml", f'<workbook xmlns="{MAIN[1:-1]}" xmlns:r="{OFFICE}"><sheets>{entries}</sheets></workbook>')
        links = "".join(f'<Relationship Id="rId{i}" Type="{OFFICE}/worksheet" Target="worksheets/sheet{i}.xml"/>' for i in range(1, n + 1))
        book.writestr(RELATIONS, f'<Relationships xmlns="{PACKAGE}">{links}</Relationships>')
        book.writestr("_rels/.rels", f'<Relationships xmlns="{PACKAGE}"><Relationship Id="rId1" Type="{OFFICE}/officeDocument" Target="xl/workbook.xml"/></Relationships>')
        kinds = "".join(f'<Override PartName="/xl/worksheets/sheet{i}.xml" ContentType="{SPREADSHEET}.worksheet+xml"/>' for i in range(1, n + 1))
        book.writestr("[Content_Types].xml", f'<Types xmlns="{PACKAGE.replace("relationships", "content-types")}"><Default Extension="rels" ContentType="application/vnd.openxmlformats-package.relationships+xml"/><Override PartName="/xl/workbook.xml" ContentType="{SPREADSHEET}.sheet.main+xml"/>{kinds}</Types>')
    return total


def write_books(df: DataFrame, path: str) -> DataFrame:
    """Write each partition of a table as a workbook of texts into a folder, a header on every sheet; (file, rows) of each, once written.

    A task writes under a name of its own and renames at its end, so that a task that is run again leaves one file.
    Nulls are left out; characters that XML has no place for are removed.
    """
    names = df.columns

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task = TaskContext.get()
        system, folder = located(path)
        system.create_dir(folder, recursive=True)
        file, own = f"part-{task.partitionId():05d}.xlsx", f"{folder}/_{task.taskAttemptId()}"
        told = (row for b in batches for row in zip(*(c.to_pylist() for c in b.columns), strict=True))
        with system.open_output_stream(own) as out:
            count = _book(out, names, told)
        system.move(own, f"{folder}/{file}")
        yield pa.RecordBatch.from_arrays([pa.array([file]), pa.array([count], pa.int64())], names=["file", "rows"])

    texts = df.select(*[F.col(f"`{c}`").cast("string").alias(c) for c in names])
    written = texts.mapInArrow(write, "file string, rows long").collect()  # a row for each file
    return df.sparkSession.createDataFrame(written, "file string, rows long")


def dated(cell: Column, epoch: Column) -> Column:
    """The date of a cell: a number of up to five digits counts days from its workbook's epoch, text is read as dates are."""
    text = cell.cast("string")
    days = F.when(text.rlike(r"^\d{1,5}(\.\d+)?$"), F.floor(text.try_cast("double")).cast("int"))
    return F.when(days.isNotNull(), F.date_add(epoch, days)).otherwise(parse_date(text))


def sheet_profiles(cells: DataFrame, most: int = 30) -> DataFrame:
    """(file, sheet, hidden, first_row, last_row, filled_rows, width, filled_cells, numbers, header_row, headers) of each sheet, in one aggregate.

    The header is, of the first `most` row numbers, the row with the most different texts that are no numbers, the
    first of equal ones; a sheet where no row has two of them has none.
    """
    texts = F.array_distinct(F.filter("cells", lambda c: c.isNotNull() & parse_number(c).isNull()))
    numbers = F.aggregate("cells", F.lit(0), lambda n, c: n + F.when(parse_number(c).isNotNull(), 1).otherwise(0))
    rank = F.when((F.col("row_no") <= most) & (F.size("_texts") > 1), F.struct(F.size("_texts").alias("n"), (-F.col("row_no")).alias("r")))
    headers = F.transform("cells", lambda c: fold_header(F.coalesce(c, F.lit(""))))
    told = cells.withColumns({"_texts": texts, "_numbers": numbers}).withColumn("_rank", rank).withColumn("_headers", F.when(F.col("_rank").isNotNull(), headers))
    return (
        told.groupBy("file", "sheet", "hidden")
        .agg(
            F.min("row_no").alias("first_row"),
            F.max("row_no").alias("last_row"),
            F.count("*").alias("filled_rows"),
            F.max(F.size("cells")).alias("width"),
            F.sum(F.size(F.array_compact("cells"))).alias("filled_cells"),
            F.sum("_numbers").alias("numbers"),
            (-F.max("_rank")["r"]).alias("header_row"),
            F.max_by("_headers", "_rank").alias("headers"),
        )
    )
