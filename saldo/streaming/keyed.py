"""Streams with state of their own for each key: the sources that own rows' contents, and the logs of periods.

State lives in the RocksDB store, on the executors' disks and in the checkpoint, so it may be larger than
memory and a restarted stream goes on where it was. State that is to be forgotten after some days
goes by the clock, and such a stream runs until it is stopped: it never ends by itself, whatever its trigger.
"""

from __future__ import annotations

import contextlib
import json
from collections.abc import Iterable, Iterator, Mapping, Sequence

from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from saldo.operators.dedupe import fingerprint

STORE = "spark.sql.streaming.stateStore.providerClass"
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
DAY_MS = 86_400_000
#: Keys of state over which contents or periods are dealt: each costs a batch that touches it some calls between Python and Spark.
BUCKETS = 8_192
#: Batches whose entries a bucket of periods keeps apart.
ELEMENTS = 16


@contextlib.contextmanager
def rocksdb(spark: SparkSession) -> Iterator[None]:
    """Streams that are started meanwhile keep their state in RocksDB, which state by key needs."""
    before = spark.conf.get(STORE, None)
    spark.conf.set(STORE, ROCKSDB)
    try:
        yield
    finally:
        spark.conf.unset(STORE) if before is None else spark.conf.set(STORE, before)


class FirstSource(StatefulProcessor):
    """Rows of the source that brought their content first; the owner is forgotten some time after it was last written.

    A key is a bucket of contents: a batch costs it one read and one write, however many contents it brings. What a
    batch brings is one element of the bucket's list, so that nothing is written twice and an element's age is its contents'.
    """

    def __init__(self, source: str, order: Sequence[str], names: Sequence[str], kind: T.DataType, keep_ms: int | None) -> None:
        self.source, self.order, self.names, self.kind, self.keep_ms = source, list(order), list(names), kind, keep_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        fields = [T.StructField("prints", T.ArrayType(T.StringType())), T.StructField("sources", T.ArrayType(self.kind))]
        self.owners = handle.getListState("owners", T.StructType(fields), self.keep_ms)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:  # noqa: N802, N803  the base class's names
        known = {p: owner for prints, sources in self.owners.get() for p, owner in zip(prints, sources, strict=True)}
        # Only here are the rows of a content held: those of the batch in which it is seen first.
        fresh: dict[str, list[Row]] = {}
        for r in rows:
            if r["_print"] not in known:
                fresh.setdefault(r["_print"], []).append(r)
            elif r[self.source] == known[r["_print"]]:
                yield self.out(r)
        if not fresh:
            return
        owners = {p: min(held, key=lambda r: tuple((r[c] is not None, r[c]) for c in self.order))[self.source] for p, held in fresh.items()}
        self.owners.appendList([(list(owners), list(owners.values()))])
        for p, held in fresh.items():
            yield from (self.out(r) for r in held if r[self.source] == owners[p])

    def out(self, r: Row) -> Row:
        return Row(**{c: r[c] for c in self.names})

    def close(self) -> None:
        pass


def bucket(c: Column, buckets: int) -> Column:
    return F.pmod(F.xxhash64(c), F.lit(buckets)).cast("int")


def first_source(stream: DataFrame, columns: Sequence[str], source: str, order: Sequence[str], keep_days: int | None = None, buckets: int = BUCKETS) -> DataFrame:
    """Rows from the source that delivered their content first, whatever comes later from others; repeats inside the owner stay.

    A batch may hold any run of the stream: inside it the first row by `order` decides, after it the state. With
    `keep_days` an owner is forgotten that long after its content was first seen, by the clock. Contents are dealt over
    `buckets`, a number that is fixed for a checkpoint: a batch reads the buckets that it touches whole.
    """
    kept = stream.withColumn("_print", fingerprint(columns)).withColumn("_bucket", bucket(F.col("_print"), buckets))
    processor = FirstSource(source, order, stream.columns, stream.schema[source].dataType, keep_days and keep_days * DAY_MS)
    return kept.groupBy("_bucket").transformWithState(processor, stream.schema, "Append", "ProcessingTime" if keep_days else "None")


def told(log: Mapping[tuple[str, int, str | None], int]) -> tuple[str, int, int, int, int]:
    """(state, version, revisions, restatements, refused) that a period's log, (action, at, id) by count, comes to, in any order."""
    closed = min((at for action, at, _ in log if action == "preclose"), default=None)
    final = min((at for action, at, _ in log if action == "finalize" and closed is not None and at > closed), default=None)
    revisions, restatements, refused = set(), set(), 0
    for (action, at, entry), n in log.items():
        if action == "revise" and (final is None or at < final):
            revisions.add(entry)
        elif action == "adjust" and final is not None and at > final:
            restatements.add(entry)
        elif not (action == "preclose" and at == closed or action == "finalize" and at == final):
            refused += n
    # Content without an id is refused by no rule, but counts as none.
    revisions.discard(None)
    restatements.discard(None)
    state = "restated" if restatements else "finalized" if final is not None else "pre_closed" if closed is not None else "open"
    return state, 1 + len(revisions) + len(restatements) + (closed is not None) + (final is not None), len(revisions), len(restatements), refused


class PeriodLog(StatefulProcessor):
    """The logs of periods, equal entries with their number, and what each comes to after a batch; a timer forgets a finished period.

    A key is a bucket of periods, or one period if it is to be forgotten. What a batch brings is one element of the key's
    list, so that a batch costs a key one read and one write; after some batches the elements become one again.
    """

    def __init__(self, keys: Sequence[str], keep_days: int | None) -> None:
        self.keys, self.keep_days = list(keys), keep_days

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.log = handle.getListState("log", T.StructType([T.StructField("entries", T.StringType())]))

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:  # noqa: N802, N803
        new: dict[str, dict] = {}
        named = {}
        for r in rows:
            if r["_period"] not in named:
                named[r["_period"]] = {k: r[k] for k in self.keys}
                new[r["_period"]] = {}
            count(new[r["_period"]], [(r["action"], r["at"], r["id"], 1)])
        kept = [json.loads(entries) for (entries,) in self.log.get()]
        if len(kept) < ELEMENTS:
            self.log.appendList([(json.dumps(listed(new), separators=(",", ":")),)])
        else:
            whole: dict[str, dict] = {}
            for logs in (*kept, listed(new)):
                for period, entries in logs.items():
                    count(whole.setdefault(period, {}), entries)
            kept = []
            new = {period: whole[period] for period in new}
            self.log.put([(json.dumps(listed(whole), separators=(",", ":")),)])
        for period, log in new.items():
            for logs in kept:
                count(log, logs.get(period, ()))
            state, version, revisions, restatements, refused = told(log)
            if self.keep_days and state in ("finalized", "restated"):
                for timer in list(self.handle.listTimers()):
                    self.handle.deleteTimer(timer)
                self.handle.registerTimer(timerValues.getCurrentProcessingTimeInMs() + self.keep_days * DAY_MS)
            yield Row(**named[period], state=state, version=version, revisions=revisions, restatements=restatements, refused=refused)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:  # noqa: N802, N803
        self.log.clear()
        return iter(())

    def close(self) -> None:
        pass


def count(log: dict, entries: Iterable) -> None:
    """Add entries (action, at, id, number) to a log."""
    for action, at, entry, n in entries:
        log[action, at, entry] = log.get((action, at, entry), 0) + n


def listed(logs: Mapping[str, Mapping]) -> dict[str, list]:
    return {period: [[*entry, n] for entry, n in log.items()] for period, log in logs.items()}


def period_log(stream: DataFrame, keys: Sequence[str], keep_days: int | None = None, buckets: int = BUCKETS) -> DataFrame:
    """State and counters of each period that a batch touches, from its whole log of (at, action, id) so far.

    The rules are those of `periods.period_states`: revisions count until the first finalize after the first
    preclose and are refused from then on, adjustments count after it and restate. As the log is kept, late and
    disordered rows give what they would have given in order. With `keep_days` a finished period that
    rests for so long is forgotten; timers go by key, so each period is then a key of its own. Without it periods are dealt
    over `buckets`, a number that is fixed for a checkpoint.
    """
    micros = [F.unix_micros(F.col(k)) if isinstance(stream.schema[k].dataType, T.TimestampType) else F.col(k) for k in keys]
    period = F.to_json(F.struct(*[c.cast("string").alias(f"c{i}") for i, c in enumerate(micros)]), {"ignoreNullFields": "false"})
    rows = stream.select(*keys, F.unix_micros(F.col("at").cast("timestamp")).alias("at"), "action", F.col("id").cast("string").alias("id"), period.alias("_period"))
    dealt = rows.groupBy(*keys) if keep_days else rows.withColumn("_bucket", bucket(F.col("_period"), buckets)).groupBy("_bucket")
    out = T.StructType([*[stream.schema[k] for k in keys], T.StructField("state", T.StringType()), *[T.StructField(c, T.LongType()) for c in ("version", "revisions", "restatements", "refused")]])
    return dealt.transformWithState(PeriodLog(keys, keep_days), out, "Update", "ProcessingTime" if keep_days else "None")
