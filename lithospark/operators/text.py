"""Substring search by an index of trigrams."""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import ship_package

#: Letters with marks up to this code point are searched without them.
LAST_MARKED = 0x24F
#: Trigrams of a pattern that a search looks up: the rarest.
LOOKED_UP = 4
#: Characters of a block of documents, about, and its documents at most.
BLOCK_CHARS, BLOCK_DOCS = 4_000_000, 1 << 16
#: Fixed value: of fewer different characters, a trigram's number has 48 bits.
DENSE_LETTERS = 1 << 16


def _plain_letters() -> tuple[str, str]:
    """Lower-case Latin letters with marks, and the letters without."""
    marked = [chr(k) for k in range(0xC0, LAST_MARKED + 1) if chr(k).islower()]
    found = [(c, base) for c in marked if len(base := unicodedata.normalize("NFD", c)[0]) and base != c]
    return "".join(c for c, _ in found), "".join(b for _, b in found)


_MARKED, _PLAIN = _plain_letters()


def folded(text: Column) -> Column:
    """A text as it is searched: in lower case, Latin letters without their marks."""
    # Letter by letter only where any has marks: a text of as many bytes as characters has none.
    return F.when(F.octet_length(text) == F.char_length(text), F.lower(text)).otherwise(F.translate(F.lower(text), _MARKED, _PLAIN))


def trigrams(text: Column) -> Column:
    """The different runs of three characters of a text, in one pass over it."""
    return F.array_distinct(F.regexp_extract_all(text, F.lit("(?s)(?=(.{3}))"), F.lit(1)))


def _listed(slots: int, docs: int) -> bool:
    """Whether some of a block's documents are written as a list of their places, which is then no longer than a bit for each."""
    return 2 * slots <= -(-docs // 8)


def block_postings(texts: list[str]) -> tuple[list[str], list[int], list[bytes]]:
    """The trigrams of a block's texts in order, how many of the texts have each, and which: as two bytes for each place, or as a bit for each text."""
    points = np.frombuffer("".join(texts).encode("utf-32-le"), dtype=np.uint32)
    lengths = np.array([len(t) for t in texts])
    slots = np.repeat(np.arange(len(texts), dtype=np.uint64), lengths)
    alphabet = np.zeros(int(points.max(initial=0)) + 1, dtype=np.uint64)
    alphabet[points] = 1
    letters = np.flatnonzero(alphabet)
    ranks, many = (np.cumsum(alphabet) - alphabet)[points], np.uint64(len(letters))
    codes = (ranks[:-2] * many + ranks[1:-1]) * many + ranks[2:]
    numbers = None
    if len(letters) >= DENSE_LETTERS:
        # Their numbers leave no room for a place: they are numbered anew.
        numbers, codes = np.unique(codes, return_inverse=True)
        codes = codes.astype(np.uint64)
    # A trigram's number and a text's place in one: sorted, each trigram's texts stand together.
    keys = np.sort((codes << np.uint64(16) | slots[:-2])[slots[:-2] == slots[2:]])
    keys = keys[np.append(True, keys[1:] != keys[:-1])] if len(keys) else keys
    codes, places = keys >> np.uint64(16), (keys & np.uint64(0xFFFF)).astype("<u2")
    cuts = np.flatnonzero(np.append(True, codes[1:] != codes[:-1])) if len(codes) else np.zeros(0, dtype=np.int64)
    found = codes[cuts] if numbers is None else numbers[codes[cuts]]
    chars = [chr(c) for c in letters.tolist()]
    grams = [chars[a] + chars[b] + chars[c] for a, b, c in zip(*((found // many**np.uint64(k) % many).tolist() for k in (2, 1, 0)), strict=True)]
    ends = [*cuts[1:].tolist(), len(keys)] if len(cuts) else []
    packed = []
    for i, j in zip(cuts.tolist(), ends, strict=True):
        if _listed(j - i, len(texts)):
            packed.append(places[i:j].tobytes())
        else:
            bits = np.zeros(len(texts), dtype=bool)
            bits[places[i:j]] = True
            packed.append(np.packbits(bits).tobytes())
    return grams, [j - i for i, j in zip(cuts.tolist(), ends, strict=True)], packed


def _bits(packed: bytes, n: int, docs: int) -> np.ndarray:
    """Which of a block's documents ``block_postings`` packed."""
    if not _listed(n, docs):
        return np.unpackbits(np.frombuffer(packed, dtype=np.uint8), count=docs).astype(bool)
    bits = np.zeros(docs, dtype=bool)
    bits[np.frombuffer(packed, dtype="<u2")] = True
    return bits


def _blocks(texts: list[str]) -> Iterator[tuple[int, int]]:
    """Where blocks of texts begin and end."""
    start, size = 0, 0
    for k, text in enumerate(texts):
        if k > start and (size + len(text) > BLOCK_CHARS or k - start == BLOCK_DOCS):
            yield start, k
            start, size = k, 0
        size += len(text)
    if texts:
        yield start, len(texts)


def write_index(docs: DataFrame, path: str, *, id_col: str, text_col: str) -> None:
    """Writes the trigrams of every text, each with its documents, and how many documents have it.

    Documents are taken in blocks of about ``BLOCK_CHARS`` characters: a block
    has one row for each trigram, in which its documents are a list of places or
    a bit each, whichever is shorter, and one row without a trigram (``''``),
    its ids. Each task writes a segment of its own, in order of trigrams, so
    nothing but the counts is shuffled, a trigram that most documents have is
    spread over all segments, and a search reads only the parts of each segment
    that its trigrams lie in.
    """
    ship_package(docs.sparkSession)

    def indexed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 32
        for batch in batches:
            texts = [t or "" for t in batch.column(1).to_pylist()]
            for i, j in _blocks(texts):
                grams, many, packed = block_postings(texts[i:j])
                ids = pa.ListArray.from_arrays([0, *[0] * len(grams), j - i], batch.column(0).slice(i, j - i))
                arrays = [pa.array([*grams, ""]), pa.array([number] * (len(grams) + 1), pa.int64()), pa.array([*many, j - i], pa.int64()), pa.array([*packed, b""], pa.binary()), ids]
                yield pa.RecordBatch.from_arrays(arrays, ["gram", "block", "n", "docs", "ids"])
                number += 1

    kept = docs.select(F.col(id_col).alias("id"), folded(F.col(text_col)).alias("text")).where("text is not null")
    rows = kept.mapInArrow(indexed, f"gram string, block long, n long, docs binary, ids array<{dict(kept.dtypes)['id']}>")
    rows.sortWithinPartitions("gram", "block").write.option("compression", "zstd").parquet(f"{path}/postings")
    written = docs.sparkSession.read.parquet(f"{path}/postings").where("gram <> ''")
    written.groupBy("gram").agg(F.sum("n").alias("n")).write.parquet(f"{path}/counts")


def search(spark: SparkSession, path: str, docs: DataFrame, pattern: str, *, id_col: str, text_col: str) -> DataFrame:
    """The documents whose folded text holds the folded pattern; see ``search_all``."""
    return search_all(spark, path, docs, [pattern], id_col=id_col, text_col=text_col).select(*[F.col(f"`{c}`") for c in docs.columns])


def search_all(spark: SparkSession, path: str, docs: DataFrame, patterns: Sequence[str], *, id_col: str, text_col: str) -> DataFrame:
    """A row for each of several patterns and document whose folded text holds the folded pattern: ``pattern`` and the columns of ``docs``.

    Ids come from the index: those that have all of a pattern's rarest
    trigrams. Only their texts are then searched, those of all patterns in one
    join. A pattern of under three characters has no trigram, so all texts are
    searched. ``docs`` is what the index was written from; rows that repeat an
    id are found each.
    """
    ship_package(spark)
    rows = spark.createDataFrame([(k, p) for k, p in enumerate(dict.fromkeys(patterns))], "k int, pattern string")
    told = rows.select("k", "pattern", folded(F.col("pattern")).alias("p"), trigrams(folded(F.col("pattern"))).alias("g")).collect()
    every = {g for r in told for g in r.g}
    counts = {r.gram: r.n for r in spark.read.parquet(f"{path}/counts").where(F.col("gram").isin([*every])).collect()} if every else {}
    short, indexed = [r for r in told if not r.g], [r for r in told if r.g and all(g in counts for g in r.g)]
    columns = [F.col(f"`{c}`") for c in docs.columns]
    if not short and not indexed:
        return docs.where("false").select(F.lit("").alias("pattern"), *columns)
    pair = lambda r: F.struct(F.lit(r.pattern).alias("pattern"), F.lit(r.p).alias("p"))
    rows, wanted = docs, F.array(*map(pair, short))
    if indexed:
        rare = {r.k: sorted(r.g, key=lambda g: (counts[g], g))[:LOOKED_UP] for r in indexed}

        def met(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for rows, ids in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                    has = {r["gram"]: _bits(r["docs"], r["n"], len(ids)) for r in rows if r["gram"]}
                    hits = {k: np.logical_and.reduce([has[g] for g in grams]) for k, grams in rare.items() if all(g in has for g in grams)}
                    for k, bits in hits.items():
                        at = pa.array(np.flatnonzero(bits))
                        if len(at):
                            yield pa.RecordBatch.from_arrays([ids.values.take(at), pa.array(np.full(len(at), k, dtype=np.int32))], ["__id", "__k"])

        postings = spark.read.parquet(f"{path}/postings").where(F.col("gram").isin(["", *{g for grams in rare.values() for g in grams}]))
        blocks = postings.groupBy("block").agg(
            F.collect_list(F.struct("gram", "n", "docs")).alias("rows"), F.max_by("ids", F.col("gram") == "").alias("ids")
        )
        ids = blocks.select("rows", "ids").mapInArrow(met, f"__id {dict(docs.dtypes)[id_col]}, __k int").groupBy("__id").agg(F.collect_set("__k").alias("__ks"))
        pairs = F.create_map(*[x for r in indexed for x in (F.lit(r.k), pair(r))])
        # The ids are the lesser side, so that texts are not sorted; where all texts are searched, all stay.
        rows = docs.join(ids.hint("shuffle_hash"), docs[id_col] == ids["__id"], "left" if short else "inner")
        own = F.transform("__ks", lambda k: pairs[k])
        wanted = F.concat(wanted, F.when(F.col("__ks").isNotNull(), own).otherwise(F.array())) if short else own
    # Folded before the patterns are taken apart: once a text.
    texts = rows.select(*columns, folded(F.col(text_col)).alias("__text"), F.explode(wanted).alias("__p"))
    return texts.where(F.contains(F.col("__text"), F.col("__p.p"))).select(F.col("__p.pattern").alias("pattern"), *columns)
