"""Alignment of two tokenizers over a corpus: where their tokens end together, and which ids meet how often.

In a task the tokens of a batch of texts lie end to end: running sums of byte
lengths are their ends, common ends are cuts, a search labels each token with
its group, and links come from repeating each cut's tokens of one side for
those of the other. A document's links are kept as different id pairs with
their numbers. The pairs of all documents are then added up in two shuffles, the
first salted, and each document takes the counts of its pairs.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import temporary_folder
from .bpe import Codec, tokenizer_json
from .common import checkpointed, column, ship_package, sliced, table

#: Different id pairs that are broadcast at most (about 100 bytes each, as Spark holds them); beyond, they are joined by shuffle.
BROADCAST_PAIRS = 1_000_000
#: Parts that an id pair's partial counts are spread over.
SALTS = 16
#: Fixed value: how pieces write a space.
SPACE = "▁"


class ByteTokens:
    """A byte-level BPE vocabulary, its special tokens plain text; texts are encoded after a space."""

    def __init__(self, model: str) -> None:
        self.codec = Codec(model)
        self.codec.split_special = None
        vocab = json.loads(model)["model"]["vocab"]
        self.bytes_of = [b""] * (max(vocab.values()) + 1)
        for i in vocab.values():
            self.bytes_of[i] = self.codec.bytes_of.get(i, b"")
        # Pieces cover a text, so where bytes stand for themselves and every merge joins its parts' bytes, all texts come back.
        of = self.bytes_of
        merges = zip(*(m.tolist() for m in (self.codec.made, self.codec.left, self.codec.right)), strict=True)
        self.exact = all(of[i] == bytes([k]) for k, i in enumerate(self.codec.first.tolist())) and all(of[m] == of[x] + of[y] for m, x, y in merges)

    def encode(self, texts: list[str]) -> list[list[int]]:
        return list(self.codec.encode_batch([" " + t for t in texts]))


class PieceTokens:
    """A sentencepiece model that puts a space before each text and turns unknown characters into bytes."""

    def __init__(self, model: bytes) -> None:
        import sentencepiece

        self.library = sentencepiece.SentencePieceProcessor(model_proto=model)
        self.exact = False
        names = [self.library.id_to_piece(i) for i in range(self.library.vocab_size())]
        self.bytes_of = [
            bytes([int(n[3:5], 16)]) if self.library.is_byte(i) else n.replace(SPACE, " ").encode() for i, n in enumerate(names)
        ]

    def encode(self, texts: list[str]) -> list[list[int]]:
        return self.library.encode(texts, num_threads=1)


@lru_cache(maxsize=2)
def _both(byte_model: str, piece_model: bytes) -> tuple[ByteTokens, PieceTokens, _Names]:
    a, b = ByteTokens(byte_model), PieceTokens(piece_model)
    return a, b, _Names(len(a.bytes_of), len(b.bytes_of))


class _Names:
    """Ids written with what may follow them in a list of groups."""

    def __init__(self, a: int, b: int) -> None:
        self.a, self.b = a, b
        made = [f"{i}{end}" for n, ends in ((a, ",|"), (b, ",;")) for end in ends for i in range(n)]
        self.table = np.array(made, dtype=object)


def linked(a_ends: np.ndarray, b_ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The cuts, and the places of all pairs of an A token and a B token that end at one of them.

    Ends ascend; several tokens of a side that end together are paired each.
    """
    rising = all((e[1:] > e[:-1]).all() for e in (a_ends, b_ends))
    if rising:
        # One token of each side ends at a cut.
        at = np.searchsorted(a_ends, b_ends)
        same = np.flatnonzero(a_ends[np.minimum(at, len(a_ends) - 1)] == b_ends) if len(a_ends) else np.zeros(0, np.int64)
        return b_ends[same], at[same], same
    cuts = np.intersect1d(a_ends, b_ends)
    first_a, first_b = np.searchsorted(a_ends, cuts), np.searchsorted(b_ends, cuts)
    many_a = np.searchsorted(a_ends, cuts, side="right") - first_a
    many_b = np.searchsorted(b_ends, cuts, side="right") - first_b
    many = many_a * many_b
    inside = np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many)
    of_b = np.repeat(many_b, many)
    return cuts, np.repeat(first_a, many) + inside // np.maximum(of_b, 1), np.repeat(first_b, many) + inside % np.maximum(of_b, 1)


def written(names: _Names, a: np.ndarray, b: np.ndarray, upto_a: np.ndarray, upto_b: np.ndarray) -> str:
    """Groups as ``a1,a2|b1;a3|b2,b3``, of each side's tokens up to a place each."""
    group_a, group_b = (np.repeat(np.arange(len(u)), np.diff(u, prepend=0)) for u in (upto_a, upto_b))
    last_a, last_b = np.zeros(len(a), dtype=np.int64), np.zeros(len(b), dtype=np.int64)
    last_a[upto_a - 1] = 1
    last_b[upto_b - 1] = 1
    out = np.empty(len(a) + len(b), dtype=np.int64)
    before_b = np.concatenate(([0], upto_b[:-1]))
    out[np.arange(len(a)) + before_b[group_a]] = a + last_a * names.a
    out[np.arange(len(b)) + upto_a[group_b]] = b + last_b * names.b + 2 * names.a
    return "".join(names.table[out].tolist())[:-1]


def _aligned(a: np.ndarray, b: np.ndarray, ends: tuple[np.ndarray, np.ndarray], names: _Names) -> dict:
    """What one document's tokens and their ends give."""
    cuts, left, right = linked(*ends)
    # Where each cut ends one link, its tokens are the last of their groups.
    upto_a, upto_b = (left + 1, right + 1) if len(left) == len(cuts) else (np.searchsorted(e, cuts, side="right") for e in ends)
    pairs, times = np.unique(a[left] * names.b + b[right], return_counts=True)
    text = written(names, a, b, upto_a, upto_b)
    return {"n_a": len(a), "n_b": len(b), "n_groups": len(cuts), "n_links": len(left), "groups": text, "pairs": pairs, "times": times}


_NOTHING = {"n_a": 0, "n_b": 0, "n_groups": 0, "n_links": 0, "groups": "", "pairs": np.zeros(0, np.int64), "times": np.zeros(0, np.int64)}


def piece_model(path: str | None = None) -> bytes:
    """A sentencepiece model file, read by the driver (0.5 MB); by default the public 32k one."""
    if path is None:
        import public_tokenizers

        path = public_tokenizers.path("piece_bpe_32k.model")
    with open(path, "rb") as f:
        return f.read()


def align(
    docs: DataFrame, *, byte_path: str | None = None, piece_path: str | None = None, id_col: str = "doc_id", text_col: str = "text", with_groups: bool = False
) -> DataFrame:
    """Per document: its id, ``n_a``, ``n_b``, ``n_groups``, ``n_links``, ``groups_sha256``, ``pairs`` and ``times``; on demand ``groups``.

    A is the byte-level vocabulary, B the pieces. ``pairs`` are the different id
    pairs that the document links, as ``a * (size of B) + b`` in order, and
    ``times`` how often. A text that is null or empty, or that either side does
    not give back byte for byte after a space, has no tokens: zeros, ``''`` and
    empty arrays. Texts are taken whole; rows that repeat are rows each, other
    columns are not looked at, and no rows give none.
    """
    spark = docs.sparkSession
    ship_package(spark)
    models = spark.sparkContext.broadcast((tokenizer_json(byte_path), piece_model(piece_path)))
    kind = dict(docs.dtypes)[id_col]
    columns = ["n_a", "n_b", "n_groups", "n_links"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own_a, own_b, names = _both(*models.value)
        size_a, size_b = (np.array([len(x) for x in own.bytes_of]) for own in (own_a, own_b))
        for batch in sliced(batches):
            texts = [t or "" for t in batch.column(1).to_pylist()]
            made = []
            for text, a, b in zip(texts, own_a.encode(texts), own_b.encode(texts), strict=True):
                whole = (" " + text).encode()
                if not text or any(not own.exact and b"".join(map(own.bytes_of.__getitem__, ids)) != whole for own, ids in ((own_a, a), (own_b, b))):
                    made.append(_NOTHING)
                    continue
                a, b = np.array(a, dtype=np.int64), np.array(b, dtype=np.int64)
                made.append(_aligned(a, b, (np.cumsum(size_a[a]), np.cumsum(size_b[b])), names))
            arrays = [batch.column(0), *[pa.array([m[c] for m in made], pa.int64()) for c in columns]]
            arrays.append(pa.array([m["groups"] and hashlib.sha256(m["groups"].encode()).hexdigest() for m in made], pa.string()))
            offsets = np.cumsum([0, *[len(m["pairs"]) for m in made]]).astype(np.int32)
            for c, t in (("pairs", np.int64), ("times", np.int32)):
                values = np.concatenate([np.zeros(0, t), *[m[c].astype(t) for m in made]])
                arrays.append(pa.ListArray.from_arrays(offsets, values))
            if with_groups:
                arrays.append(pa.array([m["groups"] for m in made], pa.string()))
            yield pa.RecordBatch.from_arrays(arrays, ["id", *columns, "groups_sha256", "pairs", "times", *(["groups"] if with_groups else [])])

    more = ", groups string" if with_groups else ""
    kinds = f"id {kind}, " + ", ".join(f"{c} long" for c in columns) + f", groups_sha256 string, pairs array<long>, times array<int>{more}"
    return docs.select(column(id_col), column(text_col)).mapInArrow(run, kinds).withColumnRenamed("id", id_col)


def pair_counts(aligned: DataFrame) -> DataFrame:
    """``(pair, n)``: how many links of all documents hold each id pair."""
    rows = aligned.select(F.explode(F.arrays_zip("pairs", "times")).alias("x"), (F.spark_partition_id() % SALTS).alias("salt"))
    parts = rows.groupBy(F.col("x.pairs").alias("pair"), "salt").agg(F.sum("x.times").alias("n"))
    return parts.groupBy("pair").agg(F.sum("n").alias("n"))


def with_counts(aligned: DataFrame, b_size: int, *, row_col: str = "row", broadcast_pairs: int = BROADCAST_PAIRS) -> DataFrame:
    """``aligned`` with ``n_best`` and ``count_sum`` instead of its pairs.

    ``count_sum`` adds up, over a document's links, the number of links of all
    documents with the same id pair; ``n_best`` counts the links whose pair is
    as frequent as any of its B id. ``aligned`` is read several times, so it
    should be a written table; ``row_col`` tells its rows apart.
    """
    counts = checkpointed(pair_counts(aligned))
    b = F.col("pair") % b_size
    most = counts.groupBy(b.alias("b")).agg(F.max("n").alias("most"))
    scored = counts.withColumn("b", b).join(most, "b").select("pair", "n", (F.col("n") == F.col("most")).cast("int").alias("best"))
    if counts.count() <= broadcast_pairs:
        scored = F.broadcast(scored)
    own = aligned.select(row_col, F.explode(F.arrays_zip("pairs", "times")).alias("x")).select(row_col, "x.pairs", "x.times")
    times = F.col("times").cast("long")
    sums = own.join(scored, F.col("pairs") == F.col("pair")).groupBy(row_col).agg(F.sum(times * F.col("best")).alias("n_best"), F.sum(times * F.col("n")).alias("count_sum"))
    found = aligned.drop("pairs", "times").join(sums, row_col, "left").drop(row_col)
    return found.withColumns({c: F.coalesce(c, F.lit(0)).cast("long") for c in ("n_best", "count_sum")})


def op13_cross_tokenizer_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's groups and links between the two public vocabularies, and how frequent its links are in all documents."""
    folder = temporary_folder(spark, "alignment")
    align(table(spark, sf_dir, "documents")).withColumn("row", F.monotonically_increasing_id()).write.parquet(folder)
    found = with_counts(spark.read.parquet(folder), len(PieceTokens(piece_model()).bytes_of))
    return found.select("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")
