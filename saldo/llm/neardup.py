"""Near-duplicate documents by a multi-index Hamming join of b-bit MinHash signatures.

A signature has 36 symbols of 16 bits, in nine chunks of four. Two documents
whose signatures differ in at most 17 symbols have, by the pigeonhole
principle, a chunk with at most one differing symbol; every chunk is therefore
entered under the four keys that leave one symbol out, and all pairs within that
distance share a key. At similarity 0.8 a pair shares no key with probability
1e-7 or so (each of nine chunks would need two errors of probability 0.2).

Texts of equal shingle sets are one class and are joined once. In a bucket of a
key nothing is paired with everything: members are first held against one member
(confirmed on full sets, then merged into components), then against members
drawn at random, and at last every pair of different components that is left is
confirmed, so no link is lost and no group is expanded. Crowded buckets, as a passage
in many documents makes them, are split first: their members are paired only where
they share one of their rarest shingles and have enough shingles from there on; all
other pairs fall short of the similarity.

Edge cases: null and empty texts and texts without words have no shingles and
are alone, as are rows without an id; texts of fewer words than a shingle have one; repeated rows fall into
one class; rows of one id and different texts are one document, whose links are confirmed by the least of its
texts (exact copies of each text count too), and of which none stays if one of them has a smaller copy; an
empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from saldo.llm.arrays import U64, Words, gram_hash, mix, runs, small_batches, text_buffers
from saldo.llm.shared import components, forget, staged

CHUNKS, WIDTH = 9, 4
SYMBOLS = CHUNKS * WIDTH
#: Distance up to which a shared key is certain, and above which a pair of similarity 0.8 is out of the question (1e-7).
CERTAIN, HOPELESS = 2 * CHUNKS - 1, 23
#: Buckets of more members are split by their rarest shingles before they are paired.
CROWD = 16
_SEEDS = mix(np.arange(1, 3 * SYMBOLS + 1, dtype=U64) * U64(0x9E3779B97F4A7C15)).astype(np.uint32) | np.uint32(1)


def word_bytes() -> np.ndarray:
    """Every byte but white space."""
    table = np.ones(256, bool)
    table[9:14] = table[32] = False
    return table


MEMBER = word_bytes()


def shingle_sets(data: np.ndarray, offsets: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes of a run of texts, ordered within each, and where each text's begin."""
    words = Words(data, offsets, MEMBER)
    grams = gram_hash(words.hashes, size)
    parts = []
    for a, b in zip(words.bounds[:-1].tolist(), words.bounds[1:].tolist(), strict=True):
        parts.append(np.unique(grams[a : b - size + 1]) if b - a >= size else gram_hash(words.hashes[a:b], b - a) if b > a else grams[:0])
    return np.concatenate([*parts, grams[:0]]), np.cumsum([0, *map(len, parts)])


def signatures(shingles: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """For every non-empty set its symbols: low bits of the least value of each hash function."""
    low, high = shingles.astype(np.uint32), (shingles >> U64(32)).astype(np.uint32)
    heads = bounds[:-1][np.diff(bounds) > 0]
    out = np.empty((len(heads), SYMBOLS), "<u2")
    for k in range(SYMBOLS):
        h = low * _SEEDS[3 * k] + high * _SEEDS[3 * k + 1]
        h ^= h >> np.uint32(15)
        h *= _SEEDS[3 * k + 2]
        out[:, k] = np.minimum.reduceat(h, heads) ^ (np.minimum.reduceat(h, heads) >> np.uint32(16)) if len(heads) else 0
    return out


def described(docs: DataFrame, size: int, id_col: str, text_col: str) -> DataFrame:
    """id, n_shingles, two digests of the shingle set, signature."""
    kind = docs.schema[id_col].dataType.simpleString()

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = text_buffers(batch.column(1))
            count, one, two, signature = [], [], [], []
            for first, last in runs(offsets):
                part = offsets[first : last + 1]
                shingles, bounds = shingle_sets(data[part[0] : part[-1]], part - part[0], size)
                n = np.diff(bounds)
                for seed, out in ((1, one), (2, two)):
                    total = np.append(U64(0), np.cumsum(mix(shingles + U64(seed))))
                    out.append((total[bounds[1:]] - total[bounds[:-1]]).view(np.int64))
                symbols = iter(signatures(shingles, bounds))
                signature += [next(symbols).tobytes() if k else None for k in n.tolist()]
                count.append(n)
            flat = [np.concatenate(x) if x else np.zeros(0, np.int64) for x in (count, one, two)]
            yield pa.RecordBatch.from_arrays([batch.column(0), *map(pa.array, flat), pa.array(signature, pa.binary())], names=["id", "n_shingles", "one", "two", "signature"])

    return docs.select(id_col, text_col).mapInArrow(scan, f"id {kind}, n_shingles long, one long, two long, signature binary")


def keys() -> Column:
    """The keys of a signature: of each chunk, the three symbols without one."""
    out = []
    for chunk in range(CHUNKS):
        for without in range(WIDTH):
            kept = [F.substring("signature", 2 * (chunk * WIDTH + i) + 1, 2) for i in range(WIDTH) if i != without]
            out.append(F.xxhash64(F.lit(chunk * WIDTH + without), *kept))
    return F.array(*out)


def within(pairs: DataFrame, reps: DataFrame) -> DataFrame:
    """Pairs (a, b) whose signatures do not rule out a link."""
    sign = reps.select("id", "signature")
    both = pairs.join(sign.toDF("a", "sa"), "a").join(sign.toDF("b", "sb"), "b").select("a", "b", "sa", "sb")

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            one, two = (np.frombuffer(b"".join(batch.column(i).to_pylist()), "<u2").reshape(-1, SYMBOLS) for i in (2, 3))
            yield batch.filter(pa.array((one != two).sum(axis=1) < HOPELESS)).select(["a", "b"])

    return both.mapInArrow(scan, pairs.select("a", "b").schema)


def rarest(members: DataFrame, texts: DataFrame, size: int, percent: int) -> DataFrame:
    """The columns of members (id, n_shingles, ...) with each shingle of their prefixes that others have, and how many shingles are left from it on.

    Of n shingles a linked text shares ceil(n * percent / 100) at least, so in any one
    order the first n - that + 1 of both have one in common. Rarest first, shingles
    that no other member has fill most prefixes and pair with nothing.
    """
    kind = members.schema["id"].dataType.simpleString()

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = text_buffers(batch.column(1))
            for first, last in runs(offsets):
                part = offsets[first : last + 1]
                shingles, bounds = shingle_sets(data[part[0] : part[-1]], part - part[0], size)
                owner = np.repeat(np.arange(first, last), np.diff(bounds))
                for i in range(0, len(owner), 1 << 16):
                    cut = slice(i, i + (1 << 16))
                    yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(owner[cut])), pa.array(shingles[cut].view(np.int64))], names=["id", "shingle"])

    every = staged(texts.join(members.select("id"), "id", "left_semi").select("id", "text").mapInArrow(scan, f"id {kind}, shingle long"))
    spread = every.groupBy("shingle").agg(F.count("*").alias("documents")).where("documents > 1")
    others = every.join(spread, "shingle").groupBy("id").agg(F.sort_array(F.collect_list(F.struct("documents", "shingle"))).alias("others"))
    take = F.size("others") - F.floor((F.col("n_shingles") * percent + 99) / 100).cast("int") + 1
    prefix = members.join(others, "id").withColumn("take", take).where("take > 0")
    each = prefix.select(*members.columns, F.size("others").alias("all"), F.posexplode(F.slice("others", F.lit(1), F.col("take"))["shingle"]).alias("place", "shingle"))
    return each.select(*members.columns, "shingle", (F.col("all") - F.col("place")).alias("left"))


def crossed(members: DataFrame, key: str, percent: int) -> DataFrame:
    """Pairs (a, b) of members (key, id, n_shingles, component, left) of one key and different components that can share enough of what is left."""
    other = members.select(key, *[F.col(c).alias(f"{c}_2") for c in ("id", "n_shingles", "component", "left")])
    allowed = F.least("left", "left_2") * (100 + percent) >= (F.col("n_shingles") + F.col("n_shingles_2")) * percent
    return members.join(other, key).where((F.col("id") > F.col("id_2")) & (F.col("component") != F.col("component_2")) & allowed).select(F.col("id").alias("a"), F.col("id_2").alias("b"))


def confirmed(pairs: DataFrame, texts: DataFrame, size: int, percent: int) -> DataFrame:
    """Pairs (a, b) whose shingle sets have the similarity, read from the full texts.

    Each b is sent once to each share of up to some hundreds of its a's, each a once.
    """
    kind = pairs.schema["a"].dataType.simpleString()
    many = pairs.groupBy("b").agg(F.ceil(F.count("*") / 256).alias("shares"))
    pairs = pairs.join(many, "b").select("a", "b", F.pmod(F.xxhash64("a"), "shares").alias("share"))
    some = pairs.join(texts.withColumnRenamed("id", "a"), "a").select("b", "share", F.lit(1).alias("order"), "a", "text")
    hubs = pairs.select("b", "share").distinct().join(texts.withColumnRenamed("id", "b"), "b").select("b", "share", F.lit(0).alias("order"), F.col("b").alias("a"), "text")
    dealt = hubs.union(some).repartition("b", "share").sortWithinPartitions("b", "share", "order")

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hub, mine = None, None
        for batch in batches:
            data, offsets = text_buffers(batch.column(4))
            links_a, links_b, rows = [], [], list(zip(*(batch.column(i).to_pylist() for i in range(4)), strict=True))
            for first, last in runs(offsets):
                part = offsets[first : last + 1]
                shingles, bounds = shingle_sets(data[part[0] : part[-1]], part - part[0], size)
                for (b, share, order, a), x, y in zip(rows[first:last], bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
                    own = shingles[x:y]
                    if not order:
                        hub, mine = (b, share), own
                    elif hub == (b, share):
                        shared = len(np.intersect1d(own, mine, assume_unique=True))
                        if 100 * shared >= percent * (len(own) + len(mine) - shared):
                            links_a.append(a)
                            links_b.append(b)
            yield pa.RecordBatch.from_arrays([pa.array(links_a, batch.schema.field(3).type), pa.array(links_b, batch.schema.field(0).type)], names=["a", "b"])

    return dealt.mapInArrow(scan, f"a {kind}, b {kind}")


def _merged(labels: DataFrame, links: DataFrame) -> DataFrame:
    """Labels (id, component) after further links (a, b): only the labels that they join are gone through again."""
    ends = links.join(labels.toDF("a", "left"), "a").join(labels.toDF("b", "right"), "b")
    joined = components(ends.select(F.col("left").alias("a"), F.col("right").alias("b")))
    lower = joined.select(F.col("id").alias("component"), F.col("component").alias("least"))
    out = staged(labels.join(lower, "component", "left").select("id", F.coalesce("least", "component").alias("component")))
    forget(joined, labels)
    return out


def groups(docs: DataFrame, size: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text", draws: int = 3) -> DataFrame:
    """One row per document: size of its shingle set, smallest id of its component, whether it is that document."""
    small_batches(docs.sparkSession)
    every = staged(described(docs, size, id_col, text_col))
    classes = every.where("n_shingles > 0 and id is not null").groupBy("one", "two")
    reps = staged(classes.agg(F.min("id").alias("id"), F.first("n_shingles").alias("n_shingles"), F.first("signature").alias("signature")))
    entered = reps.select("id", "n_shingles", F.explode(keys()).alias("key"))
    buckets = entered.groupBy("key").agg(F.min("id").alias("hub"), F.count("*").alias("members")).where("members > 1")
    members = staged(entered.join(buckets, "key").select("key", "id", "n_shingles", "hub"))
    wanted = members.select("id").distinct()
    texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).join(wanted, "id", "left_semi")
    texts = staged(texts.groupBy("id").agg(F.min("text").alias("text")))

    # First each member against the least member of the bucket it shares most keys with.
    first = members.where("id <> hub").groupBy("id", "hub").agg(F.count("*").alias("shared"))
    first = first.groupBy("id").agg(F.max_by("hub", F.struct("shared", "hub")).alias("b")).select(F.col("id").alias("a"), "b")
    tried = staged(within(first, reps))
    links = staged(confirmed(tried, texts, size, percent))
    labels = _merged(staged(wanted.select("id", F.col("id").alias("component"))), links)
    forget(links)
    drawing = 0
    while True:
        # Buckets that hold members of several components.
        told = members.select("key", "id", "n_shingles").join(labels, "id")
        open_ = told.groupBy("key").agg(F.min("component").alias("least"), F.max("component").alias("most"), F.count("*").alias("n")).where("least < most")
        told, spare = staged(told.join(open_.drop("most"), "key")), []
        if drawing < draws:
            # Members of other components against a member of the least one, drawn anew each time.
            at_random = F.xxhash64("id", "key", F.lit(drawing))
            drawn = told.where("component = least").groupBy("key").agg(F.min_by(F.struct("id", "n_shingles"), at_random).alias("of"))
            near = F.least("n_shingles", "of.n_shingles") * 100 >= F.greatest("n_shingles", "of.n_shingles") * percent
            pairs = told.where("component <> least").join(drawn, "key").where(near).select(F.greatest("id", "of.id").alias("a"), F.least("id", "of.id").alias("b"))
        else:
            # What is left: each pair of different components in a bucket.
            pairs = crossed(told.where(F.col("n") <= CROWD).withColumn("left", F.col("n_shingles")), "key", percent)
            crowded = staged(told.where(F.col("n") > CROWD).select("id", "n_shingles", "component").distinct())
            spare.append(crowded)
            if crowded.limit(1).count():
                sharing = staged(rarest(crowded, texts, size, percent))
                spare.append(sharing)
                several = sharing.groupBy("shingle").agg(F.min("component").alias("least"), F.max("component").alias("most")).where("least < most").select("shingle")
                pairs = pairs.union(crossed(sharing.join(several, "shingle"), "shingle", percent))
        # Pairs that were not alike need no second look.
        pairs = staged(within(pairs.distinct().join(tried, ["a", "b"], "left_anti"), reps))
        tested, found = pairs.count(), 0
        if tested:
            links = staged(confirmed(pairs, texts, size, percent))
            found = links.count()
            labels = _merged(labels, links) if found else labels
            forget(links)
        forget(told, *spare)
        if drawing >= draws:
            break
        # Draws join the large groups of near copies; once few pairs are links, the last step takes what is left.
        drawing = drawing + 1 if 20 * found > tested else draws
        tried, last = staged(tried.union(pairs)), tried
        forget(last, pairs)
    forget(members, texts, tried, pairs)
    by_class = reps.select("one", "two", "id").join(labels, "id", "left").select("one", "two", F.coalesce("component", "id").alias("component"))
    out = every.join(by_class, ["one", "two"], "left").select(F.col("id").alias("doc_id"), "n_shingles", F.when(F.col("n_shingles") > 0, F.col("component")).otherwise(F.col("id")).alias("component_id"))
    return out.withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))


def keep_one(docs: DataFrame, size: int = 5, percent: int = 80) -> DataFrame:
    """The documents that are the smallest of their component, each text of them once, and those without an id; their own columns."""
    gone = groups(docs, size, percent).where("not kept").select("doc_id").distinct()
    named = docs.where(docs["doc_id"].isNotNull())
    kept = named.join(gone, named["doc_id"] == gone["doc_id"], "left_anti").dropDuplicates(["doc_id", "text"])
    return kept.unionByName(docs.where(docs["doc_id"].isNull()))
