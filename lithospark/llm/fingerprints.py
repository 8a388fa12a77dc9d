"""Document fingerprints: threshold-scaled sketches of word shingles.

A sketch retains every shingle hash below a threshold: a fixed fraction of the
hash range, or the text's 64th smallest hash if that is higher, so that small
texts keep enough and those of 64 shingles or fewer keep all. Each sketch says
its threshold, two are compared below the lesser one, and the union of two
sketches, cut by the same rule, is the sketch of both texts.

The estimate is the share of the smaller sketch's hashes below the common
threshold that the other has: of m such hashes, a share c is met with a standard
error of sqrt(c (1 - c) / m). A text of n shingles has about n / 8 hashes to
meet a much longer one by, so a very small one may have none: then there is no
estimate (null).
"""

from __future__ import annotations

import base64
import hashlib
import math
from bisect import bisect_left, bisect_right
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import column, parts, ship_package, sliced, table, without
from .shingles import shingle_sets

#: One in so many shingle hashes is retained.
SCALE = 8
#: Hashes that a sketch has at least, if the text has as many.
LEAST = 64
#: Bits of a hash in a sketch.
BITS = 48

_TOP = 1 << BITS


class Sketch:
    """Sorted hashes and the value below which they are all that the text has."""

    __slots__ = ("below", "hashes")

    def __init__(self, hashes: np.ndarray, below: int) -> None:
        self.hashes, self.below = hashes, below

    @classmethod
    def of(cls, shingles: np.ndarray) -> Sketch:
        hashes = np.unique(shingles >> np.uint64(64 - BITS)).astype(np.int64)
        return cls._cut(hashes, _TOP)

    @classmethod
    def _cut(cls, hashes: np.ndarray, below: int) -> Sketch:
        """Of hashes complete below a value, those that a sketch retains."""
        threshold = min(_TOP // SCALE, below)
        n = int(np.searchsorted(hashes, threshold))
        if n >= LEAST:
            return cls(hashes[:n], threshold)
        if len(hashes) > LEAST:
            return cls(hashes[:LEAST], int(hashes[LEAST - 1]) + 1)
        return cls(hashes, below)

    def merge(self, other: Sketch) -> Sketch:
        """The sketch of both texts together."""
        below = min(self.below, other.below)
        both = np.union1d(self.hashes, other.hashes)
        return self._cut(both[both < below], below)

    def likeness(self, other: Sketch) -> float | None:
        """Estimated share of the smaller set that the larger has; none if no hash of either can tell.

        Of two empty sets it is 1, of an empty one and another 0.
        """
        if not len(self.hashes) or not len(other.hashes):
            return float(len(self.hashes) == len(other.hashes))
        below = min(self.below, other.below)
        a, b = (h[: np.searchsorted(h, below)] for h in (self.hashes, other.hashes))
        # A sketch with few hashes in all is the smaller set, even if it has none below the threshold.
        least = min((a, b), key=len)
        return len(np.intersect1d(a, b, assume_unique=True)) / len(least) if len(least) else None

    def __str__(self) -> str:
        packed = self.hashes.astype(">u8").view(np.uint8).reshape(-1, 8)[:, 8 - BITS // 8 :]
        return f"{self.below:x}:" + base64.b64encode(packed.tobytes()).decode()

    @classmethod
    def parse(cls, text: str) -> Sketch:
        below, packed = text.split(":")
        six = np.frombuffer(base64.b64decode(packed), dtype=np.uint8).reshape(-1, BITS // 8)
        full = np.zeros((len(six), 8), dtype=np.uint8)
        full[:, 8 - BITS // 8 :] = six
        return cls(full.reshape(-1).view(">u8").astype(np.int64), int(below, 16))


def sketches(texts: list[str]) -> list[Sketch]:
    return [Sketch.of(s) for s in shingle_sets([t.encode() for t in texts])]


def fingerprints(docs: DataFrame, *, text_col: str = "text") -> DataFrame:
    """``docs`` with the ``fingerprint`` of each text, taken whole; a null text counts as empty.

    An input column ``fingerprint`` gives way; repeated rows and an empty table
    are as any other.
    """
    ship_package(docs.sparkSession)

    @F.pandas_udf("string")
    def made(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in parts(batches):
            yield pd.Series([str(s) for s in sketches([t or "" for t in batch])], dtype=object)

    return without(docs, "fingerprint").withColumn("fingerprint", made(F.coalesce(column(text_col), F.lit(""))))


def likeness(a: Column, b: Column) -> Column:
    """Likeness of two fingerprints, from their strings; null where they give no estimate, or where one is null."""

    @F.pandas_udf("double")
    def compared(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series([None if x is None or y is None else Sketch.parse(x).likeness(Sketch.parse(y)) for x, y in zip(a, b, strict=True)], dtype=object)

    return compared(a, b)


def merged(a: Column, b: Column) -> Column:
    """The fingerprint of two texts together, from their fingerprints; of a null one and another, the other."""

    @F.pandas_udf("string")
    def together(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series([x or y if x is None or y is None else str(Sketch.parse(x).merge(Sketch.parse(y))) for x, y in zip(a, b, strict=True)], dtype=object)

    return together(a, b)


def edited(text: str, following: str) -> str:
    """``text`` with its last half replaced by as much of the start of ``following``."""
    half = len(text) // 2
    return text[: len(text) - half] + following[:half]


def in_descending_blocks(docs: DataFrame, *, id_col: str, text_col: str, block_bytes: int = 16 << 20) -> DataFrame:
    """Rows ``(id, text, block, tail)`` in blocks of descending id, each ended by a copy of the next block's first row.

    Blocks begin at ids sampled from all rows, of which about 250,000 at most go
    to the driver. Rows of one id go by a hash of their text, null ids come last.
    Tables of over 50,000 blocks have larger ones: a block is sorted on disk and
    read row by row, so its size is no matter of memory.
    """
    rows = docs.select(column(id_col).cast("long").alias("id"), column(text_col).alias("text")).withColumn(
        "hash", F.xxhash64("text")
    )
    count, size, first = rows.agg(
        F.count(F.lit(1)), F.sum(F.octet_length("text")), F.max(F.struct(F.col("id").isNotNull(), F.coalesce("id", F.lit(0)), "hash"))
    ).first()
    blocks = min(max(24, math.ceil((size or 0) / block_bytes)), 50_000)
    # Descending order is ascending order of the negated key.
    negated = lambda known, i, h: (not known, -i, -h)
    sampled = rows.select("id", "hash").sample(fraction=min(1.0, min(20 * blocks, 250_000) / max(1, count)), seed=11).collect()
    keys = sorted({negated(r.id is not None, r.id or 0, r.hash) for r in sampled})
    begin = negated(*first) if first else None
    starts = [k for k in keys[:: max(1, len(keys) // blocks)] if k != begin]

    @F.pandas_udf("array<int>")
    def places(known: pd.Series, ids: pd.Series, hashes: pd.Series) -> pd.Series:
        """The row's block, and the block that it ends, written as its complement."""
        out = []
        for is_known, i, h in zip(known, ids, hashes, strict=True):
            key = (not is_known, -int(i), -int(h))
            own = [bisect_right(starts, key)]
            if own[0] and bisect_left(starts, key) < own[0]:
                own.append(~(own[0] - 1))
            if key == begin:
                own.append(~len(starts))
            out.append(own)
        return pd.Series(out, dtype=object)

    place = F.col("place")
    # Without nulls, pandas keeps ids whole; with them it would round large ones.
    own = places(F.col("id").isNotNull(), F.coalesce("id", F.lit(0)), F.col("hash"))
    return (
        rows.withColumn("place", F.explode(own))
        .withColumns({"block": F.when(place < 0, F.bitwise_not(place)).otherwise(place), "tail": place < 0})
        .repartitionById(len(starts) + 1, "block")
        .sortWithinPartitions("block", "tail", F.col("id").desc_nulls_last(), F.col("hash").desc())
        .select("id", "text", "block", "tail")
    )


def edit_likeness(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Fingerprints of each text, of the text edited with the next one's start, and their likeness.

    The next document is the one of the next lower id (after the last: the
    first); of one id, by a hash of the text. A null text counts as empty; a
    null id comes last. Two texts without words have likeness 1, one with and
    one without have 0, and so have two whose fingerprints give no estimate.
    Texts are taken whole, however long; other columns are not looked at. A
    single document is its own next; no documents give no rows.
    """
    spark = docs.sparkSession
    ship_package(spark)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None  # the row whose next one has not come yet
        for batch in sliced(batches):
            columns = [batch.column(i).to_pylist() for i in range(4)]
            texts = [t or "" for t in columns[1]]
            pairs = []
            for i, text, sketch, block, tail in zip(columns[0], texts, sketches(texts), columns[2], columns[3], strict=True):
                if held and held[3] == block:
                    pairs.append((held, text, sketch))
                held = None if tail else (i, text, sketch, block)
            changed = [edited(own[1], following) for own, following, _ in pairs]
            out = []
            for (own, _, following), new, sketch in zip(pairs, changed, sketches(changed), strict=True):
                digest = hashlib.sha256(new.encode()).hexdigest()
                out.append((own[0], len(own[1]), digest, str(own[2]), str(sketch), own[2].likeness(sketch) or 0.0, own[2].likeness(following) or 0.0))
            if out:
                kinds = [pa.int64(), pa.int64(), *[pa.string()] * 3, *[pa.float64()] * 2]
                names = ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)], names)

    return in_descending_blocks(docs, id_col=id_col, text_col=text_col).mapInArrow(
        run,
        "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double",
    )


def op4_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's fingerprint against its edited text's and the next document's."""
    return edit_likeness(table(spark, sf_dir, "documents"))
