"""Repeated byte strings across a corpus, by a parse at rolling-hash triggers.

A rolling hash of 32 bytes triggers at its minimum in every 100-byte window, so
each window has one trigger and equal windows have it at the same place. The
windows of one trigger make a phrase: the bytes from the first window's start to
the last one's end. Consecutive phrases overlap by less than a window, so the
phrases of the corpus hold all its windows, as in a prefix-free parse.

The parse lists the phrases of each document with their places; the dictionary keeps
each phrase where the corpus has it first, and windows of later copies are repeats
as a whole, which shrinks repetitive text at once. Phrases that share a trigger with
another of the dictionary are compared. A window belongs to one of four bands by the
bytes it has before the trigger, and all windows of a band hold the same 83 bytes or
more around it, its core: only bands whose core stands in several phrases go on, a
group for each core. The suffixes of a group's phrases are sorted into a suffix array,
as far as a window reaches; suffixes that agree so far lie side by side, and the
parse's places put them in corpus order: all but the first are repeats. Equal windows
have equal cores, so no class is torn apart by the groups.

A core that stands in more than CROWD phrases, as of a passage in a third of the
documents, is not sorted in one task: its group is split into single windows, which
partial aggregates bring together by digest to find the first place of each. The same
aggregate compares the bytes of a digest's windows; digests of several strings, if
there ever are any, are gone through again by their bytes. What joins hot triggers or
windows to their first places is spread over SALTS tasks.

Equal texts are parsed once. A document is told apart by its id; documents come
in ascending order of id, rows of equal id and text count as one document.

Edge cases: rows without an id, and those of an id that has a lesser text too, are
documents of their own that come after all others, in order of id and text; null
counts as empty; texts under 100 bytes have no window, so
nothing is removed; a run that overlaps itself (a repeated character) is removed
after its first window's start; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from saldo.llm.arrays import U64, prefix_hash, runs, sliding_min, small_batches, span_hash, text_buffers, window_hash
from saldo.llm.shared import forget, staged

WINDOW, TRIGGER, BANDS = 100, 32, 4
#: Phrases of a group that are sorted together, and windows that are sorted at once, which bounds memory.
CROWD, SORTED = 1000, 200_000
#: Tasks over which the copies of a hot phrase or window are spread.
SALTS = 32


def phrases(data: np.ndarray, offsets: np.ndarray, prefix: np.ndarray, window: int, trigger: int) -> tuple[np.ndarray, ...]:
    """(text, trigger's hash, phrase's hash, first window, last window, bytes before the trigger, cores) of all phrases of a run; places are in the run."""
    size = len(data)
    if size < window:
        none = np.zeros(0, np.int64)
        return none, none.view(U64), none.view(U64), none, none, none, none
    grams = window_hash(prefix, trigger)
    # The leftmost of equal hashes triggers: the place fills the low bits.
    bits = U64(int(size).bit_length())
    placed = grams >> bits << bits | np.arange(len(grams), dtype=U64)
    at = (sliding_min(placed, window - trigger + 1) & ((U64(1) << bits) - U64(1))).astype(np.int64)
    start = np.arange(len(at))
    text = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))[: len(at)]
    inside = start + window <= offsets[text + 1]
    start, at, text = start[inside], at[inside], text[inside]
    head = np.flatnonzero(np.append(True, (at[1:] != at[:-1]) | (text[1:] != text[:-1]))) if len(at) else start
    first, last = start[head], start[np.append(head[1:], len(start)) - 1] if len(head) else start
    # The phrase's digest covers the place of its trigger, so equal digests line up.
    lead = at[head] - first
    whole = span_hash(prefix, first, last + window) + lead.astype(U64)
    return text[head], grams[at[head]], whole, first, last, lead, cores(prefix, at[head], lead, last - first, window, trigger)


def bands(window: int, trigger: int) -> list[tuple[int, int]]:
    """Least and most bytes before the trigger of the windows of each band."""
    room = window - trigger
    width = -(-(room + 1) // BANDS)
    return [(k * width, min(room, (k + 1) * width - 1)) for k in range(BANDS) if k * width <= room]


def cores(prefix: np.ndarray, at: np.ndarray, lead: np.ndarray, more: np.ndarray, window: int, trigger: int) -> np.ndarray:
    """16 bits for each band: a hash of the bytes that all windows of the band hold, 0 where the phrase has no such window."""
    out = np.zeros(len(at), U64)
    for k, (low, high) in enumerate(bands(window, trigger)):
        has = np.flatnonzero((lead >= low) & (lead - more <= high))
        value = span_hash(prefix, at[has] - low, at[has] + window - high) >> U64(48)
        out[has] |= np.maximum(value, U64(1)) << U64(16 * k)
    return out.view(np.int64)


def suffix_order(data: np.ndarray, starts: np.ndarray, groups: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray]:
    """The suffix array of the starts, by group and then by the first `window` bytes, equal ones in the order given; and whether
    each entry agrees with the one before it."""
    suffixes = np.ascontiguousarray(np.lib.stride_tricks.sliding_window_view(data, window)[starts]).view(f"S{window}").ravel()
    order = np.lexsort((suffixes, groups))
    ranked, of = suffixes[order], groups[order]
    return order, np.append(False, (ranked[1:] == ranked[:-1]) & (of[1:] == of[:-1]))


def window_digests(text: np.ndarray, start: np.ndarray, window: int) -> np.ndarray:
    return span_hash(prefix_hash(text), start, start + window).view(np.int64)


def repeated_suffixes(batch: pa.RecordBatch, window: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(row, bytes from the phrase's start) of the windows that stand earlier in their group, for whole groups of (key, id, at, more,
    bytes) in corpus order."""
    keys, more = (batch.column(i).to_numpy(zero_copy_only=False).astype(np.int64) for i in (0, 3))
    phrases_ = batch.column(4).cast(pa.large_binary())
    offsets = np.frombuffer(phrases_.buffers()[1], np.int64)[phrases_.offset : phrases_.offset + len(phrases_) + 1]
    data = np.frombuffer(phrases_.buffers()[2] or b"", np.uint8)
    heads = np.append(np.flatnonzero(np.append(True, keys[1:] != keys[:-1])), len(keys))
    ends = np.append(0, np.cumsum(more + 1))
    low = 0
    while low < len(heads) - 1:
        high = max(low + 1, int(np.searchsorted(ends[heads], ends[heads[low]] + SORTED, side="right")) - 1)
        a, b = heads[low], heads[high]
        row = np.repeat(np.arange(a, b), more[a:b] + 1)
        shift = np.arange(len(row)) + ends[a] - ends[row]
        order, again = suffix_order(data, offsets[row] + shift, keys[row], window)
        yield row[order[again]], shift[order[again]]
        low = high


def told_apart(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(id, text, own) with an id for every document, `own` being the one that it came with; and (id, size, sum) of each."""
    told = lambda df: staged(df.select("id", F.octet_length("text").alias("size"), F.unhex(F.sha2("text", 256)).alias("sum")).distinct())
    sums = told(rows)
    several = staged(sums.groupBy("id").agg(F.min("sum").alias("keep"), F.count("*").alias("n")).where("n > 1 or id is null").select("id", "keep"))
    if not several.limit(1).count():
        return rows.withColumn("own", F.col("id")), sums
    kind = rows.schema["id"].dataType
    most = rows.agg(F.max("id")).first()[0]
    known = rows.join(several.withColumnRenamed("id", "other"), F.col("id").eqNullSafe(F.col("other")), "left")
    spare = F.col("id").isNull() | F.coalesce(F.unhex(F.sha2("text", 256)) != F.col("keep"), F.lit(False))
    known = known.select(F.col("id").alias("own"), "text", spare.alias("spare"))
    number = F.monotonically_increasing_id()
    later = F.concat(F.lit(most or ""), F.lit("~"), F.lpad(number.cast("string"), 20, "0")) if isinstance(kind, T.StringType) else (F.lit(-1 if most is None else most) + 1 + number).cast(kind)
    others = staged(known.where("spare").orderBy("own", "text").select(later.alias("id"), "text", "own"))
    rows = known.where("not spare").select(F.col("own").alias("id"), "text", "own").unionByName(others)
    return rows, told(rows)


def removed(docs: DataFrame, window: int = WINDOW, id_col: str = "doc_id", text_col: str = "text", trigger: int = TRIGGER) -> DataFrame:
    """One row per document: its bytes, the bytes and runs removed, the digest of the bytes kept."""
    spark = docs.sparkSession
    small_batches(spark)
    kind = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    # Copies of a text are removed whole; the first of each is parsed.
    rows, sums = told_apart(rows)
    copied = sums.groupBy("sum").agg(F.min("id").alias("first"), F.count("*").alias("n")).where("n > 1")
    copies = staged(sums.join(copied, "sum").where("id > first").select("id").distinct())
    parsed = rows.select("id", "text").join(copies, "id", "left_anti")

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = text_buffers(batch.column(1))
            ids = batch.column(0)
            for low, high in runs(offsets):
                part = offsets[low : high + 1] - offsets[low]
                own = data[offsets[low] : offsets[high]]
                text, gram, whole, first, last, lead, core = phrases(own, part, prefix_hash(own), window, trigger)
                base = part[text]
                yield pa.RecordBatch.from_arrays(
                    [ids.take(pa.array(text + low)), pa.array(gram.view(np.int64)), pa.array(whole.view(np.int64)), pa.array((first - base).astype(np.int32)), pa.array((last - first).astype(np.int32)), pa.array(lead.astype(np.int32)), pa.array(core)],
                    names=["id", "gram", "whole", "at", "more", "lead", "core"],
                )

    found = parsed.mapInArrow(parse, f"id {kind}, gram long, whole long, at int, more int, lead int, core long")
    # Triggers that occur again, and how many phrases they have.
    again = found.groupBy("gram").agg(F.count("*").alias("n"), F.min("whole").alias("low"), F.max("whole").alias("high")).where("n > 1")
    # Kept apart, so that the join has a plain shuffle on either side, and a hot trigger's partition can be split.
    again = staged(again.select("gram", (F.col("low") < F.col("high")).alias("differ"), (F.col("n") > CROWD).alias("hot")))
    repeated = staged(found.join(again, "gram"))
    # The dictionary: each phrase of a repeated trigger where it stands first; later copies are repeats.
    dictionary = repeated.groupBy("gram", "whole").agg(F.min(F.struct("id", "at")).alias("first"), F.first("more").alias("more"), F.first("lead").alias("lead"), F.first("core").alias("core"), F.first("differ").alias("differ"), F.first("hot").alias("hot"), F.count("*").alias("n"))
    dictionary = staged(dictionary.select("gram", "whole", "first.id", "first.at", "more", "lead", "core", "differ", "hot", "n"))
    salt = F.pmod(F.xxhash64("id", "at"), F.lit(SALTS)).cast("int")
    salts = F.sequence(F.lit(0), F.lit(SALTS - 1))
    known = dictionary.where("n > 1").select("gram", "whole", F.col("id").alias("first_id"), F.col("at").alias("first_at"), F.explode(F.when(F.col("hot"), salts).otherwise(F.array(F.lit(0)))).alias("salt"))
    spread = repeated.withColumn("salt", F.when(F.col("hot"), salt).otherwise(0))
    later = spread.join(known, ["gram", "whole", "salt"]).where("id <> first_id or at <> first_at").select("id", "at", "more")

    def phrase_bytes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Phrases of groups that are sorted with their bytes; of crowded ones each window (more: -1) with its digest and bytes."""
        for batch in batches:
            data, offsets = text_buffers(batch.column(1))
            kind_ = batch.schema.field(0).type
            out: list[list] = [[], [], [], [], []]
            for own, first, last, spans in zip(batch.column(0).to_pylist(), offsets[:-1].tolist(), offsets[1:].tolist(), batch.column(2).to_pylist(), strict=True):
                text = data[first:last]
                for s in spans:
                    if not s["crowded"]:
                        for column, value in zip(out, (s["key"], own, s["at"], s["more"], text[s["at"] : s["at"] + s["more"] + window].tobytes()), strict=True):
                            column.append(value)
                crowded = [np.arange(s["at"], s["at"] + s["more"] + 1) for s in spans if s["crowded"]]
                if crowded:
                    start = np.unique(np.concatenate(crowded))
                    value, rows_ = window_digests(text, start, window), np.lib.stride_tricks.sliding_window_view(text, window)
                    for i in range(0, len(start), 1 << 16):
                        n = len(start[i : i + (1 << 16)])
                        yield pa.RecordBatch.from_arrays([pa.array(value[i : i + n]), pa.array([own] * n, kind_), pa.array(start[i : i + n].astype(np.int32)), pa.array(np.full(n, -1, np.int32)), pa.array([x.tobytes() for x in rows_[start[i : i + n]]], pa.binary())], names=["key", "id", "at", "more", "bytes"])
            types = (pa.int64(), kind_, pa.int32(), pa.int32(), pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, types, strict=True)], names=["key", "id", "at", "more", "bytes"])

    def sort_groups(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for batch in chain(batches, [None]):
            # The last group of a batch may go on in the next.
            held += [batch] if batch is not None and batch.num_rows else []
            rows = pa.Table.from_batches(held).combine_chunks() if held else None
            if rows is None or not rows.num_rows:
                continue
            keys = rows.column(0).to_numpy()
            whole = len(keys) if batch is None else int(np.searchsorted(keys, keys[-1]))
            held = rows.slice(whole).to_batches()
            for part in rows.slice(0, whole).to_batches():
                for row, shift in repeated_suffixes(part, window):
                    at = part.column(2).to_numpy()[row] + shift
                    yield pa.RecordBatch.from_arrays([part.column(1).take(pa.array(row)), pa.array(at.astype(np.int32))], names=["id", "at"])

    # Bands of the dictionary whose core stands in several phrases of a trigger, and the windows that they have.
    edges = F.array(*[F.struct(F.lit(k).alias("band"), F.lit(low).alias("low"), F.lit(high).alias("high"), F.shiftrightunsigned("core", 16 * k).bitwiseAND(0xFFFF).alias("part")) for k, (low, high) in enumerate(bands(window, trigger))])
    banded = dictionary.where("differ").select("gram", "id", "at", "more", "lead", F.explode(edges).alias("e")).select("gram", "id", "at", "more", "lead", "e.*").where("part > 0")
    shared = banded.groupBy("gram", "band", "part").agg(F.count("*").alias("phrases")).where("phrases > 1")
    start, end = F.greatest(F.col("lead") - F.col("high"), F.lit(0)), F.least(F.col("lead") - F.col("low"), F.col("more"))
    banded = banded.join(shared, ["gram", "band", "part"]).select("id", F.xxhash64("gram", "band", "part").alias("key"), (F.col("at") + start).alias("at"), (end - start).alias("more"), (F.col("phrases") > CROWD).alias("crowded"))
    unsure = banded.groupBy("id").agg(F.collect_list(F.struct("key", "at", "more", "crowded")).alias("spans"))
    each = staged(parsed.join(unsure, "id").select("id", "text", "spans").mapInArrow(phrase_bytes, f"key long, id {kind}, at int, more int, bytes binary"))
    dealt = each.where("more >= 0").repartition("key").sortWithinPartitions("key", "id", "at")
    sorted_ = dealt.mapInArrow(sort_groups, f"id {kind}, at int").select("id", "at", F.lit(0).alias("more"))
    crowded = each.where("more < 0").select("key", "id", "at", "bytes")

    def placed(rows: DataFrame, *by: str) -> DataFrame:
        return rows.groupBy(*by).agg(F.min(F.struct("id", "at")).alias("first"), F.count("*").alias("n"), F.min("bytes").alias("low"), F.max("bytes").alias("high")).where("n > 1")

    def behind(rows: DataFrame, first: DataFrame, *by: str) -> DataFrame:
        known = first.select(*by, F.col("first.id").alias("first_id"), F.col("first.at").alias("first_at"), F.explode(salts).alias("salt"))
        met = rows.select(*by, "id", "at", salt.alias("salt")).join(known, [*by, "salt"])
        return met.where("id <> first_id or at <> first_at").select("id", "at", F.lit(0).alias("more"))

    digests = staged(placed(crowded, "key"))
    single = sorted_.union(behind(crowded, digests.where("low = high"), "key"))
    mixed = digests.where("low <> high").select("key")
    if mixed.limit(1).count():
        again_ = crowded.join(mixed, "key").withColumn("window", F.col("bytes"))
        single = single.union(behind(again_, placed(again_, "key", "window"), "key", "window"))
    marks = later.union(single).groupBy("id").agg(F.collect_list(F.struct("at", "more")).alias("spans"), F.lit(False).alias("copy"))
    marks = staged(marks.unionByName(copies.select("id", F.lit(None).cast("array<struct<at:int,more:int>>").alias("spans"), F.lit(True).alias("copy"))))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = text_buffers(batch.column(1))
            out: list[list] = [[], [], [], []]
            for row, (spans, copy) in enumerate(zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True)):
                own = data[offsets[row] : offsets[row + 1]]
                edge = np.zeros(len(own) + 1, np.int64)
                if copy and len(own) >= window:
                    edge[0], edge[-1] = 1, -1
                elif spans and not copy:
                    at = np.array([s["at"] for s in spans])
                    np.add.at(edge, at, 1)
                    np.add.at(edge, at + np.array([s["more"] for s in spans]) + window, -1)
                gone = np.cumsum(edge)[:-1] > 0
                out[0].append(len(own))
                out[1].append(int(gone.sum()))
                out[2].append(int((gone & ~np.append(False, gone[:-1])).sum()) if len(gone) else 0)
                out[3].append(hashlib.sha256(own[~gone].tobytes()).hexdigest())
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(o, pa.int64()) for o in out[:3]), pa.array(out[3], pa.string())], names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"])

    forget(each, again, repeated, dictionary, digests)
    return rows.join(marks, "id", "left").select("own", "text", "spans", "copy").mapInArrow(cut, f"doc_id {kind}, n_bytes long, n_removed long, n_spans long, kept_sha256 string")
