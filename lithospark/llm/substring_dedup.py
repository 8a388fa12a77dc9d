"""Substring dedup by hashed lines and passages of lines.

Lines are cut into pieces: of every few words in a row, the one with the least
hash ends a piece (an end of a sentence before all others), and so does the
last word of a line, so that a passage is cut alike wherever it stands. A unit is the shortest run of pieces, from any
piece on, that has enough words; another one ends each line that is long
enough. Units are normalised (letter case and white space do not count) and
hashed; equal digests are grouped over all documents, the earliest occurrence
is kept and the others are removed, by their offsets in the original.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import BATCH_ROWS, checkpointed, column, ship_package, sliced, table, without
from .shingles import Words, blocks, mix, powers, stream

#: Words of a unit, at least.
PASSAGE = 20
#: Characters that count as one word at least: a line of a script without spaces is a word or a few.
LETTERS = 5
#: Words among which at least one ends a piece. Wherever a passage of n words stands, the pieces between its first and
#: last common ends are the same and have n - 2 * WINDOW + 1 words at least.
WINDOW = 12
#: Equal words in a row that are a piece of their own.
RUN = 4

*_DIGESTS, _SEED = stream(21, 3)


class Units(NamedTuple):
    """The pieces of a text, and its units as runs of them."""

    #: Bytes where pieces start.
    starts: np.ndarray
    #: First and last piece of each unit.
    first: np.ndarray
    last: np.ndarray
    #: 64 and 32 bits that tell units apart.
    one: np.ndarray
    two: np.ndarray

    def distinct(self) -> np.ndarray:
        """The first unit of each digest."""
        pairs = np.column_stack((self.one, self.two.astype(np.int64)))
        return np.sort(np.unique(pairs, axis=0, return_index=True)[1]) if len(pairs) else np.empty(0, dtype=np.int64)

    def spans(self, length: int, found: np.ndarray) -> list[tuple[int, int]]:
        """The bytes to remove from a text so long: units equal to ``found`` ones, and those that stand earlier in the text.

        Of the latter, what overlaps the earlier one stays.
        """
        digests = list(zip(self.one.tolist(), self.two.tolist(), strict=True))
        known = {digests[k] for k in found.tolist()}
        gone = np.zeros(len(self.starts) + 1, dtype=np.int64)
        until: dict[tuple[int, int], int] = {}
        for digest, first, last in sorted(zip(digests, self.first.tolist(), self.last.tolist(), strict=True), key=lambda u: u[1:]):
            if digest not in known:
                if digest not in until:
                    until[digest] = last
                    continue
                first = max(first, until[digest] + 1)
            if first <= last:
                gone[first] += 1
                gone[last + 1] -= 1
        edges = np.flatnonzero(np.diff(np.concatenate(([0], (np.cumsum(gone) > 0).view(np.int8)))))
        bounds = np.append(self.starts, length)
        return [(int(bounds[a]), int(bounds[b])) for a, b in zip(edges[::2], edges[1::2], strict=True)]


def _slide(of: np.ufunc, x: np.ndarray) -> np.ndarray:
    """``of`` every ``WINDOW`` numbers in a row."""
    have = 1
    while have < WINDOW:
        step = min(have, WINDOW - have)
        x = of(x[:-step], x[step:])
        have += step
    return x


def _least(keys: np.ndarray) -> np.ndarray:
    """Which keys are the least of any ``WINDOW`` ones in a row."""
    if len(keys) < WINDOW:
        return np.zeros(len(keys), dtype=bool)
    # The greatest of the windows' minima around a key is the key itself if it is one of them.
    edge = np.zeros(WINDOW - 1, dtype=keys.dtype)
    return _slide(np.maximum, np.concatenate((edge, _slide(np.minimum, keys), edge))) == keys


def _keys(words: Words) -> np.ndarray:
    """A hash of each word above 0; the last word of a sentence is less than any other."""
    ends = np.isin(words.raw[words.ends - 1], np.frombuffer(b".!?", dtype=np.uint8)) if len(words.ends) else np.empty(0, dtype=bool)
    return (mix(words.hashes ^ _SEED) >> np.uint64(1)) | np.where(ends, np.uint64(1), np.uint64(1 << 63))


def _pieces(words: Words) -> np.ndarray:
    """Which words begin a piece."""
    n = len(words.starts)
    lines = np.concatenate(([0], np.cumsum(words.raw == 10)))
    begins = np.ones(n, dtype=bool)
    begins[1:] = lines[words.starts[1:]] > lines[words.ends[:-1]]
    same = (words.hashes[1:] == words.hashes[:-1]) & ~begins[1:]
    edges = np.flatnonzero(np.diff(np.concatenate(([0], same.view(np.int8), [0]))))
    runs = np.column_stack((edges[::2], edges[1::2] + 1))
    runs = runs[runs[:, 1] - runs[:, 0] >= RUN]
    inside = np.zeros(n + 1, dtype=np.int64)
    inside[runs[:, 0]] = 1
    inside[runs[:, 1] - 1] = -1
    keys = _keys(words)
    # The last word of a line is less than all others, so that no window looks beyond it.
    keys[np.append(begins[1:], True)] = 0
    begins[1:] |= (_least(keys) & (np.cumsum(inside)[:n] == 0))[:-1]
    begins[runs[:, 0]] = True
    begins[runs[:, 1][runs[:, 1] < n]] = True
    return begins


def units(texts: list[bytes], least: int = PASSAGE) -> Iterator[Units]:
    """The units of each text, of ``least`` words (or five times as many characters)."""
    for i, j in blocks(texts):
        with np.errstate(over="ignore"):
            words = Words(texts[i:j])
            n = len(words.starts)
            first = np.flatnonzero(_pieces(words)) if n else np.empty(0, dtype=np.int64)
            ends = np.append(first[1:], n)[: len(first)]
            points = np.concatenate(([0], np.cumsum((words.raw & 0xC0) != 0x80)))
            letters = np.concatenate(([0], np.cumsum(points[words.ends] - points[words.starts])))
            weight = np.maximum(ends - first, (letters[ends] - letters[first]) // LETTERS)
            before = np.concatenate(([0], np.cumsum(weight)))
            until = np.searchsorted(first, words.until)
            text = np.searchsorted(until, np.arange(len(first)), side="right")
            last = np.searchsorted(before, before[:-1] + least) - 1
            whole = np.flatnonzero(last < until[text]) if len(first) else np.empty(0, dtype=np.int64)
            unit_first, unit_last = whole, last[whole]
            # One more for a line whose end no unit has.
            lines = np.concatenate(([0], np.cumsum(words.raw == 10)))
            line = lines[words.starts[first]]
            closing = np.flatnonzero(np.append(line[1:] != line[:-1], True)) if len(first) else np.empty(0, dtype=np.int64)
            back = np.searchsorted(before, before[closing + 1] - least, side="right") - 1
            opening = np.searchsorted(line, line[closing])
            extra = (back >= opening) & (last[np.maximum(back, 0)] != closing)
            unit_first, unit_last = np.concatenate((unit_first, back[extra])), np.concatenate((unit_last, closing[extra]))
            order = np.lexsort((unit_last, unit_first))
            unit_first, unit_last = unit_first[order], unit_last[order]
            up, down = powers(1 << max(20, (n + 1).bit_length()))
            digests, a, b = [], first[unit_first], ends[unit_last]
            for seed in _DIGESTS:
                sums = np.zeros(n + 1, dtype=np.uint64)
                np.cumsum(mix(words.hashes ^ seed) * up[:n], out=sums[1:])
                digests.append(mix((sums[b] - sums[a]) * down[a] + (b - a).astype(np.uint64)))
        upto = np.searchsorted(unit_first, until)
        at = piece = unit = 0
        for end, pieces, k in zip(words.text_ends.tolist(), until.tolist(), upto.tolist(), strict=True):
            own = slice(unit, k)
            one, two = digests[0][own].view(np.int64), (digests[1][own] >> np.uint64(32)).astype(np.uint32).view(np.int32)
            yield Units(words.starts[first[piece:pieces]] - at, unit_first[own] - piece, unit_last[own] - piece, one, two)
            at, piece, unit = end, pieces, k


def _identified(docs: DataFrame, id_col: str, text_col: str) -> list[Column]:
    text = column(text_col)
    return [column(id_col).cast("long").alias("id"), F.xxhash64(text).alias("h"), text.alias("text")]


def _units(rows: DataFrame, least: int) -> DataFrame:
    """``(id, h, unit, d1, d2)``: the digests of each document and the number of the first unit of each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches):
            found = list(units([(t or "").encode() for t in batch.column(2).to_pylist()], least))
            picked = [u.distinct() for u in found]
            each = np.repeat(np.arange(len(found)), [len(p) for p in picked])
            heads = [batch.column(k).take(pa.array(each)) for k in (0, 1)]
            tails = [picked, [u.one[p] for u, p in zip(found, picked, strict=True)], [u.two[p] for u, p in zip(found, picked, strict=True)]]
            tails = [pa.array(np.concatenate(t) if t else [], k) for t, k in zip(tails, (pa.int32(), pa.int64(), pa.int32()), strict=True)]
            yield pa.RecordBatch.from_arrays([*heads, *tails], ["id", "h", "unit", "d1", "d2"])

    return rows.mapInArrow(run, "id long, h long, unit int, d1 long, d2 int")


def repeated_units(docs: DataFrame, *, least: int = PASSAGE, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(id, h, found)``: the units of each document that an earlier one has, in order of id (null last) and text hash."""
    all_units = _units(docs.select(*_identified(docs, id_col, text_col)), least)
    # What occurs once goes no further. Written tables on both sides let a join split a hot digest.
    repeated = all_units.groupBy("d1", "d2").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    repeated = checkpointed(repeated.select("d1", "d2"))
    several = checkpointed(all_units.join(repeated, ["d1", "d2"]))
    rank = F.struct(F.col("id").isNull().alias("none"), F.coalesce("id", F.lit(0)).alias("id"), "h")
    firsts = checkpointed(several.groupBy("d1", "d2").agg(F.min(rank).alias("first")))
    later = several.join(firsts, ["d1", "d2"]).where(rank != F.col("first"))
    return later.groupBy("id", "h").agg(F.collect_set("unit").alias("found"))


def drop_repeated_passages(
    docs: DataFrame, *, least: int = PASSAGE, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """``docs`` with repeated passages cut out of the text, and ``removed``: the spans cut, in bytes of the original.

    A repeat has ``least`` words, or five times as many characters; with 1,
    repeated lines of any length go. Every row stays. A text may be left empty;
    a null one stays null. The order of documents is that of their ids, null
    last, then of a hash of the text; rows equal in both count as one document
    and are cut alike. Texts are taken whole, however long. Input columns
    ``removed`` give way; all others are kept as they are. An empty table gives
    no rows.
    """
    ship_package(docs.sparkSession)
    repeats = repeated_units(docs, least=least, id_col=id_col, text_col=text_col)
    docs = without(docs, "removed")
    repeats = repeats.select(F.col("id").alias("__id"), F.col("h").alias("__h"), F.col("found").alias("__found"))
    known = column(id_col).cast("long").eqNullSafe(F.col("__id")) & (F.xxhash64(column(text_col)) == F.col("__h"))
    marked = docs.join(repeats, known, "left")

    @F.pandas_udf("struct<text: string, removed: array<struct<start: long, end: long>>>")
    def cut(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        for whole, all_found in batches:
            for k in range(0, len(whole), BATCH_ROWS):
                texts, found = whole.iloc[k : k + BATCH_ROWS], all_found.iloc[k : k + BATCH_ROWS]
                out, spans = list(texts), []
                raws = [(t or "").encode() for t in texts]
                for i, (raw, own, hits) in enumerate(zip(raws, units(raws, least), found, strict=True)):
                    spans.append(own.spans(len(raw), np.empty(0, dtype=np.int64) if hits is None else np.asarray(hits)))
                    if spans[i]:
                        edges = [0, *(e for span in spans[i] for e in span), len(raw)]
                        out[i] = b"".join(raw[a:b] for a, b in zip(edges[::2], edges[1::2], strict=True)).decode()
                yield pd.DataFrame({"text": out, "removed": [[{"start": a, "end": b} for a, b in s] for s in spans]})

    return marked.withColumn("__cut", cut(column(text_col), F.col("__found"))).select(
        *[F.col("__cut.text").alias(c) if c == text_col else column(c) for c in docs.columns], "__cut.removed"
    )


def op6_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's text without the passages that occur earlier, and their spans."""
    return drop_repeated_passages(table(spark, sf_dir, "documents").select("doc_id", "text"))
