"""Near duplicates by a multi-index Hamming join of b-bit minhash signatures.

A signature has 80 symbols of 16 bits, in 16 chunks of 5. Each chunk is looked
up with one error allowed: a key for each symbol left out. By the pigeonhole
principle any two signatures that differ in at most 31 symbols share a key; two
sets at the threshold of 0.75 differ in 20 on average and share none with
probability 1e-7.

Texts of equal sets are one class, with a number of its own, so that null and
repeated ids do no harm. Links are confirmed on the full sets, in two rounds
that never list the pairs within a bucket. First, each class is compared with
the earliest class of each of its buckets. In what is then still more than one
component, the members outside a bucket's largest component are dealt into
blocks, and every other member of their buckets is sent once to each block that
needs it; there it meets all members of the block at once, by an index of their
shingles, and only links come out.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import checkpointed, column, ship_package, sliced, table
from .components import components
from .shingles import mix, shingle_sets, stream

#: Links have 100 * shared >= THRESHOLD * union.
THRESHOLD = 75
CHUNKS, CHUNK = 16, 5
SYMBOLS = CHUNKS * CHUNK
#: Shingles of the classes that one block holds, about.
BLOCK_SHINGLES = 60_000
#: Other classes that a task compares a block with, about.
OTHERS = 1024
#: Rows of ids that may be broadcast (under 100 bytes each).
BROADCAST_IDS = 200_000

_FACTORS = stream(11, SYMBOLS) | np.uint64(1)
_KEYS = stream(12, SYMBOLS)
_DIGESTS = stream(13, 2)


def signature(shingles: np.ndarray) -> np.ndarray:
    """The low 16 bits of the least hash under each of 80 permutations."""
    least = np.full(SYMBOLS, np.iinfo(np.uint64).max, dtype=np.uint64)
    with np.errstate(over="ignore"):
        for i in range(0, len(shingles), 4096):
            np.minimum(least, (_FACTORS[:, None] * shingles[None, i : i + 4096]).min(axis=1), out=least)
    return least.astype(np.uint16)


def keys(signatures: np.ndarray) -> np.ndarray:
    """The 80 keys of each signature: a chunk less one of its symbols, and which."""
    chunks = signatures.reshape(-1, CHUNKS, CHUNK).astype(np.uint64)
    out = np.empty((len(signatures), CHUNKS, CHUNK), dtype=np.uint64)
    for gap in range(CHUNK):
        packed = np.zeros(chunks.shape[:2], dtype=np.uint64)
        for k in range(CHUNK):
            if k != gap:
                packed = (packed << np.uint64(16)) | chunks[:, :, k]
        out[:, :, gap] = packed
    with np.errstate(over="ignore"):
        return mix(out.reshape(-1, SYMBOLS) ^ _KEYS)


def digest(shingles: np.ndarray) -> tuple[int, int]:
    """128 bits that tell sets apart."""
    with np.errstate(over="ignore"):
        return tuple(int(mix(shingles ^ d).sum().astype(np.int64)) for d in _DIGESTS)


class Block:
    """Members ``(class, component, set)`` and an index of their shingles."""

    def __init__(self, members: list[tuple[int, int, np.ndarray]]) -> None:
        self.classes = [m[0] for m in members]
        self.components = np.array([m[1] for m in members], dtype=np.int64)
        self.sizes = np.array([len(m[2]) for m in members], dtype=np.int64)
        shingles = np.concatenate([m[2] for m in members]) if members else np.empty(0, dtype=np.uint64)
        order = np.argsort(shingles, kind="stable")
        self.shingles, self.owners = shingles[order], np.repeat(np.arange(len(members)), self.sizes)[order]
        #: Of each component met so far, the members that have no link with it yet and are not its own.
        self.open: dict[int, np.ndarray] = {}

    def links(self, other: int, component: int, shingles: np.ndarray) -> Iterator[tuple[int, int]]:
        """Links of members with another class, one at most for a member and a component."""
        left = self.open.setdefault(component, self.components != component)
        if not left.any():
            return
        low, high = (np.searchsorted(self.shingles, shingles, side=side) for side in ("left", "right"))
        counts = high - low
        at = np.repeat(low - np.concatenate(([0], np.cumsum(counts)[:-1])), counts) + np.arange(counts.sum())
        shared = np.bincount(self.owners[at], minlength=len(self.sizes))
        linked = np.flatnonzero((100 * shared >= THRESHOLD * (self.sizes + len(shingles) - shared)) & left)
        left[linked] = False
        for k in linked.tolist():
            yield self.classes[k], other


def _identified(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``(id, h, text)``: a row's id and text hash tell it from rows with other texts."""
    text = column(text_col)
    return docs.select(column(id_col).cast("long").alias("id"), F.xxhash64(text).alias("h"), text.alias("text"))


def _signed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``(id, h, n, d1, d2, sign)`` for each document: size and digest of its set, and its signature."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches):
            sizes, firsts, seconds, signs = [], [], [], []
            for s in shingle_sets([(t or "").encode() for t in batch.column(2).to_pylist()]):
                d = digest(s)
                sizes.append(len(s))
                firsts.append(d[0])
                seconds.append(d[1])
                signs.append(signature(s).tobytes() if len(s) else None)
            arrays = [batch.column(0), batch.column(1), pa.array(sizes, pa.int64()), pa.array(firsts, pa.int64()), pa.array(seconds, pa.int64()), pa.array(signs, pa.binary())]
            yield pa.RecordBatch.from_arrays(arrays, ["id", "h", "n", "d1", "d2", "sign"])

    return _identified(docs, id_col, text_col).mapInArrow(run, "id long, h long, n long, d1 long, d2 long, sign binary")


def _keyed(classes: DataFrame) -> DataFrame:
    """``(key, class)`` for each key of each class."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            signs = np.frombuffer(b"".join(batch.column(1).to_pylist()), dtype=np.uint16).reshape(-1, SYMBOLS)
            numbers = np.repeat(batch.column(0).to_numpy(zero_copy_only=False), SYMBOLS)
            yield pa.RecordBatch.from_arrays([pa.array(keys(signs).reshape(-1).view(np.int64)), pa.array(numbers)], ["key", "class"])

    return classes.select("class", "sign").mapInArrow(run, "key long, class long")


def _sets(docs: DataFrame, classes: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``(class, set)`` of the classes, from the text of each one's first document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches):
            found = shingle_sets([t.encode() for t in batch.column(1).to_pylist()])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([s.view(np.int64) for s in found], pa.list_(pa.int64()))], ["class", "set"])

    first = few(classes.select("class", F.col("first.id").alias("first_id"), F.col("first.h").alias("first_h")))
    texts = _identified(docs, id_col, text_col).join(first, F.col("id").eqNullSafe(F.col("first_id")) & (F.col("h") == F.col("first_h")))
    # Rows equal in id and text are one document.
    return texts.groupBy("class").agg(F.first("text").alias("text")).mapInArrow(run, "class long, set array<long>")


def few(rows: DataFrame) -> DataFrame:
    """Rows of ids to join with: broadcast if they are few enough, by count."""
    return F.broadcast(rows) if rows.count() <= BROADCAST_IDS else rows


def _second_round(shared: DataFrame, sets: DataFrame, labels: DataFrame) -> DataFrame:
    """Links ``(a, b)`` between components that still share a bucket; ``sets`` are those of all classes in ``shared``."""
    members = shared.join(labels, shared["class"] == labels["node"], "left").select(
        "key", "class", F.coalesce("component", "class").alias("component")
    )
    counts = members.groupBy("key", "component").agg(F.count(F.lit(1)).alias("n"))
    split = (
        counts.groupBy("key")
        .agg(F.max(F.struct("n", "component")).alias("x"), F.count(F.lit(1)).alias("components"), F.sum("n").alias("size"))
        .where("components > 1")
        .select("key", "size", F.col("x.component").alias("main"))
    )
    members = checkpointed(members.join(split, "key"))
    outside = members.where("component <> main")
    # Blocks hold members of like buckets, so that they need the same others; those are dealt in parts at once.
    homes = outside.groupBy("class").agg(F.min("main").alias("home"), F.max("size").alias("size"))
    homes = homes.join(sets.select("class", F.size("set").alias("n")), "class")
    sizes = homes.groupBy("home").agg(F.ceil(F.sum("n") / BLOCK_SHINGLES).alias("blocks"), F.ceil(F.max("size") / OTHERS).cast("int").alias("parts"))
    homes = homes.join(sizes, "home").select(
        "class", F.xxhash64("home", F.pmod(F.xxhash64("class"), "blocks")).alias("block"), "parts"
    )
    homes = checkpointed(homes)
    wanted = outside.join(homes, "class").select("key", "block", "parts").distinct()
    needs = members.join(wanted, "key").select(
        "block", F.pmod(F.xxhash64("class"), "parts").cast("int").alias("part"), "class", "component"
    )
    own = homes.join(members.select("class", "component").distinct(), "class").select(
        "block", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), "class", "component"
    )
    rows = (
        own.withColumn("role", F.lit(0))
        .unionByName(needs.distinct().withColumn("role", F.lit(1)))
        .join(sets, "class")
        .select(F.xxhash64("block", "part").alias("block"), "role", "class", "component", "set")
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, own, block = None, [], None
        for batch in batches:
            out = []
            offsets = batch.column(4).offsets.to_numpy()
            values = batch.column(4).values.to_numpy().view(np.uint64)
            for k, (at, role, number, component) in enumerate(zip(*[batch.column(i).to_pylist() for i in range(4)], strict=True)):
                if at != now:
                    now, own, block = at, [], None
                shingles = values[offsets[k] : offsets[k + 1]]
                if not role:
                    own.append((number, component, shingles.copy()))
                    continue
                if block is None:
                    block = Block(own)
                out += block.links(number, component, shingles)
            yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in out], pa.int64()), pa.array([x[1] for x in out], pa.int64())], ["a", "b"])

    return rows.repartition("block").sortWithinPartitions("block", "role").mapInArrow(run, "a long, b long")


def _resolved(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``(id, h, n, first)`` for each row: ``first`` is the first document of its component, null without words."""
    ship_package(docs.sparkSession)
    signed = checkpointed(_signed(docs, id_col, text_col))
    place = F.struct(F.col("id").isNull().alias("none"), "id", "h")
    classes = signed.where("n > 0").groupBy("d1", "d2").agg(F.min(place).alias("first"), F.max(F.struct("n", "sign")).alias("x"))
    # Numbers rise with the first document, so that the least class of a bucket is the earliest: originals come before
    # their copies more often than not. They stay as they are written.
    classes = classes.repartitionByRange("first").sortWithinPartitions("first")
    classes = checkpointed(classes.select(F.monotonically_increasing_id().alias("class"), "d1", "d2", "first", "x.n", "x.sign"))

    # Sets of one or two shingles reach the threshold only if they are equal.
    keyed = _keyed(classes.where("n > 2"))
    buckets = keyed.groupBy("key").agg(F.min("class").alias("least"), F.max("class").alias("most")).where("least < most")
    shared = checkpointed(keyed.join(buckets.select("key", "least"), "key").distinct())
    stars = checkpointed(shared.where("class <> least").select(F.col("class").alias("a"), F.col("least").alias("b")).distinct())
    sets = checkpointed(_sets(docs, classes.join(shared.select("class").distinct(), "class"), id_col, text_col))

    a, b = sets.select(F.col("class").alias("a"), F.col("set").alias("sa")), sets.select(F.col("class").alias("b"), F.col("set").alias("sb"))
    common = F.size(F.array_intersect("sa", "sb"))
    confirmed = (
        stars.join(a, "a").join(b, "b")
        .where(100 * F.least(F.size("sa"), F.size("sb")) >= THRESHOLD * F.greatest(F.size("sa"), F.size("sb")))
        .where(100 * common >= THRESHOLD * (F.size("sa") + F.size("sb") - common))
        .select("a", "b")
    )
    confirmed = checkpointed(confirmed)
    labels = checkpointed(components(confirmed))
    more = checkpointed(_second_round(shared.select("key", "class"), sets, labels))
    if not more.isEmpty():
        labels = checkpointed(components(confirmed.union(more)))

    linked = classes.select("class", "first").join(labels, F.col("class") == F.col("node"))
    leaders = linked.groupBy("component").agg(F.min("first").alias("leader"))
    named = labels.join(leaders, "component").select(F.col("node").alias("class"), "leader")
    named = classes.select("class", "d1", "d2", "first").join(named, "class", "left")
    named = named.select("d1", "d2", F.coalesce("leader", "first").alias("first"))
    return signed.select("id", "h", "n", "d1", "d2").join(named, ["d1", "d2"], "left").select(
        "id", "h", "n", F.when(F.col("n") > 0, F.col("first")).alias("first")
    )


def near_duplicates(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(doc_id, n_shingles, component_id, kept)`` for each row of ``docs``.

    Texts without words, empty or null, have no shingles and are linked with
    nothing. ``component_id`` is the least id reached; a row without an id
    links others, never names a component and is never kept, and a component
    without ids has a null one. Rows that share an id are linked by their own
    texts. Texts are taken whole, however long. No documents give no rows;
    other columns are not looked at.
    """
    found = _resolved(docs, id_col, text_col)
    component = F.when(F.col("n") > 0, F.col("first.id")).otherwise(F.col("id"))
    return found.select(
        F.col("id").alias("doc_id"),
        F.col("n").alias("n_shingles"),
        component.alias("component_id"),
        F.coalesce(F.col("id") == component, F.lit(False)).alias("kept"),
    )


def drop_near_duplicates(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with one row of each group: the one of the least id (null last), then of a hash of the text.

    Texts without words are no duplicates and stay.
    """
    own = F.col("id").eqNullSafe(F.col("first.id")) & (F.col("h") == F.col("first.h"))
    found = _resolved(docs, id_col, text_col).where("n > 0").groupBy("id", "h", own.alias("own")).agg(F.count(F.lit(1)).alias("n"))
    found = checkpointed(found)
    of = lambda rows: rows.select(F.col("id").alias("__id"), F.col("h").alias("__h"))
    this = column(id_col).cast("long").eqNullSafe(F.col("__id")) & (F.xxhash64(column(text_col)) == F.col("__h"))
    left = docs.join(few(of(found.where("not own"))), this, "left_anti")
    twice = of(found.where("own and n > 1"))
    if twice.isEmpty():
        return left
    # Of rows equal in id and text, one stays.
    twice = few(twice)
    once = left.join(twice, this, "left_semi").withColumn("__i", column(id_col).cast("long")).withColumn("__t", F.xxhash64(column(text_col)))
    once = once.dropDuplicates(["__i", "__t"]).drop("__i", "__t")
    return left.join(twice, this, "left_anti").unionByName(once)


def op7_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's component among five-word shingle sets with a similarity of 0.75 or more."""
    return near_duplicates(table(spark, sf_dir, "documents"))
