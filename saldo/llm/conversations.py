"""Faults of conversations and their cheapest repair, by dynamic programming over ranks.

A conversation must go `(s?(ua)+)?` by the initials of its roles, so there are four states: nothing
yet, after the system's turn, after a user's, after an assistant's. Each row is met by one macro
edit: a run of up to two inserted turns and then Delete, Keep or Rerole. The nine macros' codes
(D, ID, IID, ...) are free of prefixes, so two audits of equally many macros compare as their
first different macros do. A state therefore needs no audit string: its cost and its rank among
the audits of its layer are enough, and the next layer's ranks follow from (parent's rank, place of
the code). Parent pointers give the macros back from the end.

A conversation may hold most rows, so rows are dealt in ranges of the total order and cut into
segments of at most 2**BITS rows. Of each segment the costs and ranks between every pair of states
are found (16 of each), these are folded in order for each conversation, and each segment is gone
through once more from the one state to the other that the fold has found. What one task gathers for
a conversation is one short entry a segment; texts are only passed through, in order, to be digested.

Edge cases: null roles and texts count as one space; null turns come first, ties of turns go by
role, by the text's first 100 characters and by its digest; a null id is a conversation of its own;
equal rows are duplicates after the first. Conversations of which nothing is left have zeros, an empty audit and
the digest of an empty text. An empty table gives an empty result. Other columns are not read,
whatever their names. Texts of any length are taken whole.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from saldo.llm.arrays import small_batches
from saldo.llm.shared import staged

#: A segment holds at most 2**BITS rows.
BITS = 12
BLANKS = " \t\n\x0b\x0c\r"
#: Macro edits in the order of their codes.
MACROS = sorted(run + edit for run in ("", "I", "II") for edit in "DKR")
NOTHING, SYSTEM, USER, ASSISTANT = range(4)
#: The state that an inserted or reroled turn leads to, its role, and what completes a conversation that ends in a state.
NEXT = (USER, USER, ASSISTANT, USER)
ROLE = {USER: "user", ASSISTANT: "assistant"}
TAIL = (0, 2, 1, 0)
NEVER = 1 << 40
#: Initials s, u, a and others by number, and what a turn that is kept with one leads to from a state.
KEPT = {(NOTHING, 0): SYSTEM, (NOTHING, 1): USER, (SYSTEM, 1): USER, (ASSISTANT, 1): USER, (USER, 2): ASSISTANT}
LEGAL = {(0, 1), (1, 2), (2, 1)}
FINE, TRUNCATED, DUPLICATE, BLANK = range(4)


def macro_tables() -> tuple[np.ndarray, np.ndarray]:
    """[4 * initial + condition, from, to]: cost and number of the best macro, NEVER where there is none."""
    cost, code = np.full((16, 4, 4), NEVER, np.int64), np.zeros((16, 4, 4), np.int64)
    for initial in range(4):
        for condition in range(4):
            for start in range(4):
                for number, macro in enumerate(MACROS):
                    state, price = start, 2 * (len(macro) - 1)
                    for _ in macro[:-1]:
                        state = NEXT[state]
                    edit = macro[-1]
                    if edit == "D":
                        to, price = state, price + 3
                    elif condition >= DUPLICATE:
                        continue
                    elif edit == "R":
                        to, price = NEXT[state], price + 2 + condition
                    else:
                        to, price = KEPT.get((state, initial)), price + condition
                    at = 4 * initial + condition
                    if to is not None and (price, number) < (cost[at, start, to], code[at, start, to]):
                        cost[at, start, to], code[at, start, to] = price, number
    return cost, code


COST, CODE = macro_tables()


def ranked(sizes: np.ndarray, starts: np.ndarray, step: Callable[[int, int], tuple[np.ndarray, np.ndarray]], keep: bool):
    """Costs and ranks of the four states after all layers, for many sequences at once, longest first.

    `starts` has the first states of each sequence [n, k]; step(i, m) gives costs and places of codes [m, 4, 4]
    of layer i for the first m sequences. With `keep` also the pointers of each layer: 16 * parent + place.
    """
    cost = np.full((*starts.shape, 4), NEVER, np.int64)
    np.put_along_axis(cost, starts[..., None], 0, axis=2)
    rank, kept = np.zeros_like(cost), []
    for i in range(int(sizes[0]) if len(sizes) else 0):
        m = int(np.searchsorted(-sizes, -i, side="left"))
        price, place = step(i, m)
        key = ((cost[:m, :, :, None] + price[:, None]) << 6) | (rank[:m, :, :, None] << 4) | place[:, None]
        parent = key.argmin(axis=2)
        best = np.take_along_axis(key, parent[:, :, None], axis=2)[:, :, 0]
        text = best & 63
        cost[:m] = np.minimum(best >> 6, NEVER)
        rank[:m] = (text[..., None] > text[..., None, :]).sum(axis=3)
        if keep:
            kept.append((parent * 16 + (best & 15)).astype(np.uint8))
    return cost, rank, kept


def backwards(sizes: np.ndarray, ends: np.ndarray, kept: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """The state before each layer and the place of its code [n, layers], following the pointers from the last states."""
    states, places = (np.zeros((len(sizes), len(kept)), np.uint8) for _ in range(2))
    now = ends.copy()
    for i in range(len(kept) - 1, -1, -1):
        m = len(kept[i])
        pointer = kept[i][np.arange(m), 0, now[:m]]
        now[:m], places[:m, i] = pointer >> 4, pointer & 15
        states[:m, i] = now[:m]
    return states, places


def longest_first(sizes: list[int]) -> np.ndarray:
    return np.argsort(-np.array(sizes, np.int64), kind="stable")


def padded(rows: list[np.ndarray]) -> np.ndarray:
    out = np.zeros((len(rows), max(map(len, rows), default=0)), np.uint8)
    for r, row in zip(out, rows, strict=True):
        r[: len(row)] = row
    return out


def summarised(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of segments (conv_id, segment, marks): conditions, counts of faults, and costs and ranks between states."""
    for batch in batches:
        kinds, counts = [], []
        for marks in batch.column(2):
            marks = np.sort(marks.values.to_numpy())
            at, mark = marks >> 5, marks & 31
            row = mark >= 16
            first = np.isin(at[row], at[~row])
            initial, condition = (mark[row] & 15) >> 2, mark[row] & 3
            condition = np.where(~first & (condition != BLANK), DUPLICATE, condition)
            legal = sum([((initial[:-1] == x) & (initial[1:] == y)).sum() for x, y in LEGAL])
            kinds.append(initial * 4 + condition)
            counts.append([*[int((condition == c).sum()) for c in (BLANK, DUPLICATE, TRUNCATED)], int(len(initial) - 1 - legal), int(initial[0]), int(initial[-1])])
        order = longest_first([len(k) for k in kinds])
        sizes, laid = np.array([len(kinds[i]) for i in order], np.int64), padded([kinds[i] for i in order])
        cost, rank, _ = ranked(sizes, np.tile(np.arange(4), (len(order), 1)), lambda i, m, laid=laid: (COST[laid[:m, i]], CODE[laid[:m, i]]), keep=False)
        numbers = np.concatenate([cost.reshape(-1, 16), rank.reshape(-1, 16)], axis=1)[np.argsort(order)] if len(order) else np.zeros((0, 32), np.int64)
        told = [[*c, *map(int, x)] for c, x in zip(counts, numbers, strict=True)]
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array([k.astype(np.uint8).tobytes() for k in kinds], pa.binary()), pa.array(told, pa.list_(pa.int64()))], names=["conv_id", "segment", "kinds", "told"])


def folded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of conversations (conv_id, segments with what was told of them): faults, cost, turns to append, and the states around each segment."""
    for batch in batches:
        every = [sorted(zip(x["segment"], x["told"], strict=True)) for x in batch.column(1).to_pylist()]
        order = longest_first([len(x) for x in every])
        every = [every[i] for i in order]
        sizes = np.array([len(x) for x in every], np.int64)
        tables = np.zeros((len(every), int(sizes[0]) if len(sizes) else 0, 32), np.int64)
        for table, x in zip(tables, every, strict=True):
            table[: len(x)] = [told[6:] for _, told in x]
        step = lambda i, m, t=tables: (t[:m, i, :16].reshape(-1, 4, 4), t[:m, i, 16:].reshape(-1, 4, 4))
        cost, rank, kept = ranked(sizes, np.zeros((len(every), 1), np.int64), step, keep=True)
        whole = cost[:, 0] + 2 * np.array(TAIL)
        end = ((whole << 2) | rank[:, 0]).argmin(axis=1) if len(every) else np.zeros(0, np.int64)
        states, _ = backwards(sizes, end, kept)
        summary, around = [], []
        for i, x in enumerate(every):
            told = [t for _, t in x]
            between = sum((a[5], b[4]) not in LEGAL for a, b in zip(told, told[1:], strict=False))
            summary.append([*[sum(t[k] for t in told) for k in range(3)], sum(t[3] for t in told) + between, int(whole[i, end[i]]), TAIL[end[i]]])
            after = [*states[i, 1 : len(x)].tolist(), int(end[i])]
            around.append([{"segment": s, "before": int(b), "after": int(a)} for (s, _), b, a in zip(x, states[i, : len(x)], after, strict=True)])
        back = np.argsort(order)
        kind = pa.list_(pa.struct([("segment", pa.int64()), ("before", pa.int32()), ("after", pa.int32())]))
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([summary[i] for i in back], pa.list_(pa.int64())), pa.array([around[i] for i in back], kind)], names=["conv_id", "summary", "around"])


def retraced(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of segments (conv_id, segment, kinds, before, after): the number of each row's macro."""
    for batch in batches:
        kinds = [np.frombuffer(k.as_py(), np.uint8) for k in batch.column(2)]
        order = longest_first([len(k) for k in kinds])
        before, after = (batch.column(c).to_numpy()[order].astype(np.int64) for c in (3, 4))
        sizes, laid = np.array([len(kinds[i]) for i in order], np.int64), padded([kinds[i] for i in order])
        _, _, kept = ranked(sizes, before[:, None], lambda i, m, laid=laid: (COST[laid[:m, i]], CODE[laid[:m, i]]), keep=True)
        _, places = backwards(sizes, after, kept)
        back = np.argsort(order)
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), batch.column(3), pa.array([places[back[i], : len(k)].tobytes() for i, k in enumerate(kinds)], pa.binary())], names=["conv_id", "segment", "before", "macros"])


#: What the rows of the last pass are, in the order in which they come.
GAPS, SUMMARY, MACRO, TURN = range(4)


class Digested:
    """One conversation's audit and digest, as its rows go by."""

    def __init__(self) -> None:
        self.sum, self.audit, self.some = hashlib.sha256(), [], False
        self.gaps, self.summary, self.state, self.macros, self.at = 0, [0] * 6, NOTHING, b"", 0

    def line(self, role: str, text: str) -> None:
        self.sum.update(("\n" * self.some + role + ":" + text).encode())
        self.some = True

    def insert(self, n: int) -> None:
        for _ in range(n):
            self.state = NEXT[self.state]
            self.line(ROLE[self.state], "")

    def turn(self, role: str, text: str) -> None:
        macro = MACROS[self.macros[self.at]]
        self.at += 1
        self.insert(len(macro) - 1)
        if macro[-1] == "R":
            self.state = NEXT[self.state]
            self.line(ROLE[self.state], text)
        elif macro[-1] == "K":
            self.state = KEPT[self.state, "sua".index(role[0])]
            self.line(role, text)

    def segment(self, before: int, macros: bytes) -> None:
        self.state, self.macros, self.at = before, macros, 0
        self.audit.append("".join([MACROS[m] for m in macros]))

    def row(self) -> list:
        self.insert(self.summary[5])
        return [self.gaps, *self.summary[:5], "".join(self.audit) + "I" * self.summary[5], self.sum.hexdigest()]


def digested(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (conv_id, kind, numbers, macros, role, text), sorted, to one row a conversation; only the current one is held."""
    conv, now, out, kinds = None, None, [], None

    def told() -> pa.RecordBatch:
        columns = list(zip(*out, strict=True)) if out else [()] * 9
        types = [kinds, *[pa.int64()] * 6, pa.string(), pa.string()]
        names = ["conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names=names)

    for batch in batches:
        kinds = batch.column(0).type
        for conv_id, kind, numbers, macros, role, text in zip(*[c.to_pylist() for c in batch.columns], strict=True):
            if now is None or conv_id != conv:
                if now is not None:
                    out.append([conv, *now.row()])
                conv, now = conv_id, Digested()
            if kind == GAPS:
                now.gaps = numbers[0]
            elif kind == SUMMARY:
                now.summary = numbers
            elif kind == MACRO:
                now.segment(numbers[0], macros)
            else:
                now.turn(role, text)
        if out:
            yield told()
            out = []
    if now is not None:
        out.append([conv, *now.row()])
        yield told()


def typed(name: str, kind: str, rest: str) -> str:
    return f"{name} {kind}, {rest}"


def repair(turns: DataFrame, every: DataFrame | None = None) -> DataFrame:
    """One row a conversation of (conv_id, turn, role, text): faults, cost and audit of the cheapest repair, digest of the repaired lines.

    `every` may have the ids of conversations (conv_id) that have to be told of, even if no turn of theirs is left.
    """
    small_batches(turns.sparkSession)
    kind = turns.schema["conv_id"].dataType.simpleString()
    role, text = F.coalesce("role", F.lit(" ")), F.coalesce("text", F.lit(" "))
    rows = turns.select("conv_id", "turn", role.alias("role"), text.alias("text"), F.monotonically_increasing_id().alias("_salt"))
    order = ["conv_id", "turn", "role", F.substring("text", 1, 100), F.xxhash64("text"), "_salt"]
    dealt = rows.repartitionByRange(*order).sortWithinPartitions(*order).drop("_salt")
    rows = staged(dealt.withColumn("at", F.monotonically_increasing_id()))
    stripped = F.rtrim("text", F.lit(BLANKS))
    condition = F.when(stripped == "", BLANK).when(F.substring(stripped, -1, 1).isin(".", "!", "?"), FINE).otherwise(TRUNCATED)
    letter = F.substring("role", 1, 1)
    initial = F.when(letter == "s", 0).when(letter == "u", 1).when(letter == "a", 2).otherwise(3)
    place = lambda at: [F.shiftright(at, BITS).alias("segment"), (F.col(at).bitwiseAND((1 << BITS) - 1) * 32)]
    segment, mark = place("at")
    met = rows.select("conv_id", segment, (mark + 16 + initial * 4 + condition).alias("mark"))
    same = F.unhex(F.sha2(F.concat(F.length("role").cast("string"), F.lit(":"), "role", "text"), 256))
    first = rows.groupBy("conv_id", same.alias("_same")).agg(F.min("at").alias("at"))
    segment, mark = place("at")
    marks = met.union(first.select("conv_id", segment, mark)).groupBy("conv_id", "segment").agg(F.collect_list("mark").alias("marks"))
    parts = staged(marks.mapInArrow(summarised, typed("conv_id", kind, "segment bigint, kinds binary, told array<bigint>")))
    gathered = parts.groupBy("conv_id").agg(F.collect_list(F.struct("segment", "told")).alias("parts"))
    gathered = gathered.select("conv_id", F.struct(F.col("parts.segment").alias("segment"), F.col("parts.told").alias("told")).alias("parts"))
    fold = staged(gathered.mapInArrow(folded, typed("conv_id", kind, "summary array<bigint>, around array<struct<segment: bigint, before: int, after: int>>")))
    around = fold.select(F.col("conv_id").alias("_conv"), F.inline("around").alias("_segment", "before", "after"))
    path = parts.join(around, (F.col("segment") == F.col("_segment")) & F.col("conv_id").eqNullSafe(F.col("_conv"))).select("conv_id", "segment", "kinds", "before", "after")
    macros = path.mapInArrow(retraced, typed("conv_id", kind, "segment bigint, before int, macros binary"))
    by_turn = rows.groupBy("conv_id", "turn").agg(F.lit(1).alias("_one")).groupBy("conv_id").agg(F.min("turn").alias("low"), F.max("turn").alias("high"), F.count("turn").alias("n"))
    gaps = F.coalesce(F.col("high") - F.col("low") + 1 - F.col("n"), F.lit(0)).cast("bigint")
    ids = by_turn.select("conv_id", F.array(gaps).alias("numbers"))
    if every is not None:
        ids = ids.union(every.select("conv_id", F.array(F.lit(0).cast("bigint")))).groupBy("conv_id").agg(F.max("numbers").alias("numbers"))

    def step(table: DataFrame, kind: int, at: Column, **have: Column) -> DataFrame:
        types = {"numbers": "array<bigint>", "macros": "binary", "role": "string", "text": "string"}
        return table.select("conv_id", F.lit(kind).alias("kind"), at.cast("bigint").alias("at"), *[have.get(c, F.lit(None)).cast(t).alias(c) for c, t in types.items()])

    steps = step(ids, GAPS, F.lit(-2), numbers=F.col("numbers"))
    steps = steps.union(step(fold, SUMMARY, F.lit(-1), numbers=F.col("summary")))
    steps = steps.union(step(macros, MACRO, F.shiftleft("segment", BITS), numbers=F.array("before"), macros=F.col("macros")))
    steps = steps.union(step(rows, TURN, F.col("at"), role=F.col("role"), text=F.col("text")))
    ready = steps.repartition("conv_id").sortWithinPartitions("conv_id", "at", "kind").drop("at")
    return ready.mapInArrow(digested, typed("conv_id", kind, "gaps bigint, blank bigint, duplicate bigint, truncated bigint, illegal bigint, cost bigint, audit string, repaired_sha256 string"))


def damage(conversations: DataFrame) -> DataFrame:
    """Rows with faults put in, by a checksum of conversation and turn: dropped, emptied, cut of its marks, repeated, given to the user."""
    shown = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    rows = conversations.select("conv_id", "turn", shown("role").alias("role"), shown("text").alias("text"), (F.crc32(F.concat(shown("conv_id"), F.lit(":"), shown("turn"))) % 20).alias("_how"))
    how = F.col("_how")
    text = F.when(how == 1, "").when(how == 2, F.translate("text", ".!?", "")).otherwise(F.col("text"))
    role = F.when(how == 4, "user").otherwise(F.col("role"))
    times = F.explode(F.sequence(F.lit(1), F.when(how == 3, 2).otherwise(1)))
    return rows.where(how != 0).select("conv_id", "turn", role.alias("role"), text.alias("text"), times.alias("_time")).drop("_time")
