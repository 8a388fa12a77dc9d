"""Merkle manifest of a dataset: a tree of digests over each source's rows, and one over the sources.

Leaves are digests of rows, computed in the JVM. They are put in order by range,
numbered by prefix sums of the ranges' counts, and dealt into aligned blocks of
4,096: a block is a contiguous matrix of 64-byte digests, reshaped by the fanout
and hashed row by row, level by level. The blocks' digests are the leaves of the
next blocks, so no task holds more than a block, whatever the size of a source.
Proofs come down the same way: a block gets the siblings above it, and each of
its rows adds those inside by index arithmetic.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import ascii_lower, checkpointed, column, ship_package, table

#: Children of a node.
FANOUT = 16
#: Levels inside a block; a block has ``FANOUT ** LEVELS`` leaves.
LEVELS = 3
#: Hex characters of a digest.
WIDTH = 64
#: The fields of a leaf, in order.
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")

PATH = "array<struct<left: string, right: string>>"
_PATH = pa.list_(pa.struct([("left", pa.string()), ("right", pa.string())]))


def digest(*inputs: Column) -> Column:
    """Lower-case hex sha256 of the inputs one after the other."""
    return F.sha2(F.concat(*inputs), 256)


def field(value: Column) -> Column:
    """A value with its length, so that no two rows give the same bytes: ``-`` if null."""
    text = value.cast("string")
    return F.when(text.isNull(), "-").otherwise(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text))


def leaf(*values: Column) -> Column:
    return digest(*[field(v) for v in values])


def _sha(data: bytes) -> str:
    return hashlib.sha256(data).hexdigest()


def climb(leaves: np.ndarray, total: int, levels: int = LEVELS) -> list[np.ndarray]:
    """The digest matrices of a block, from its leaves up, where its whole level has ``total`` nodes.

    A level that has one node in all is the top. Rows are runs of ``FANOUT``
    digests; the last may be shorter.
    """
    out = [leaves]
    while total > 1 and len(out) <= levels:
        own = out[-1]
        full = len(own) // FANOUT
        rows = [r.tobytes() for r in own[: full * FANOUT].reshape(full, FANOUT * WIDTH)]
        if full * FANOUT < len(own):
            rows.append(own[full * FANOUT :].tobytes())
        out.append(np.frombuffer("".join(map(_sha, rows)).encode(), dtype=np.uint8).reshape(-1, WIDTH))
        total = -(-total // FANOUT)
    return out


def siblings(matrices: list[np.ndarray], i: int) -> list[tuple[bytes, bytes]]:
    """What stands left and right of leaf ``i`` and of each node above it, in its run, up to the block's top."""
    out = []
    for own in matrices[:-1]:
        start = i // FANOUT * FANOUT
        out.append((own[start:i].tobytes(), own[i + 1 : start + FANOUT].tobytes()))
        i //= FANOUT
    return out


def folded(node: bytes, path: Sequence[tuple[bytes, bytes]]) -> bytes:
    """The root that a node and its siblings make."""
    for left, right in path:
        node = _sha(left + node + right).encode()
    return node


def _numbered(rows: DataFrame, group: str, order: Sequence[str]) -> DataFrame:
    """Rows, each ``n`` times in ``group``'s order, with ``pos``, the first place they take there, and the group's ``total``.

    Ranges of all rows are sorted apart; a range's rows are counted within it,
    and the counts of the ranges before are added, so no task holds a group.
    """
    ordered = checkpointed(rows.repartitionByRange(group, *order).sortWithinPartitions(group, *order))
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in ordered.schema)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at = 0
        for batch in batches:
            n = batch.column("n").to_numpy()
            ends = at + np.cumsum(n)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(ends - n, pa.int64())], names=[*batch.schema.names, "__at"])
            at = int(ends[-1]) if len(n) else at

    counted = ordered.mapInArrow(count, f"{kinds}, __at long").withColumn("__range", F.spark_partition_id())
    sums = counted.groupBy("__range", group).agg(F.sum("n").alias("many"), F.min("__at").alias("first"))
    whole = Window.partitionBy(group)
    before = F.coalesce(F.sum("many").over(whole.orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    sums = sums.select("__range", group, (before - F.col("first")).alias("shift"), F.sum("many").over(whole).alias("total"))
    return counted.join(sums, ["__range", group]).select(*ordered.columns, (F.col("__at") + F.col("shift")).alias("pos"), "total")


def _dealt(rows: DataFrame, size: int) -> DataFrame:
    """Rows in aligned blocks: ``block``, the first place there (``at``) and how many of the places are theirs (``n``)."""
    first, last = F.expr(f"pos div {size}"), F.expr(f"(pos + n - 1) div {size}")
    rows = rows.withColumn("block", F.explode(F.sequence(first, last)))
    begin = F.greatest(F.col("pos"), F.col("block") * size)
    end = F.least(F.col("pos") + F.col("n"), (F.col("block") + 1) * size)
    return rows.withColumns({"at": begin - F.col("block") * size, "n": end - begin})


def _block(rows: pa.Table) -> tuple[pa.Table, np.ndarray, int]:
    """A block's rows in order, its digests as a matrix with copies beside each other, and its level's size."""
    rows = rows.sort_by("at")
    data = rows.column("digest").combine_chunks()
    raw = np.frombuffer("".join(data.to_pylist()).encode(), dtype=np.uint8).reshape(-1, WIDTH)
    return rows, np.repeat(raw, rows.column("n").to_numpy(), axis=0), rows.column("total")[0].as_py()


def _up(rows: DataFrame, levels: int) -> DataFrame:
    """Each block's top, as nodes of the next blocks."""
    size = FANOUT**levels

    def run(rows: pa.Table) -> pa.Table:
        rows, own, total = _block(rows)
        top = climb(own, total, levels)[-1].tobytes().decode()
        made = {"key": rows.column("key").slice(0, 1), "pos": rows.column("block").slice(0, 1), "digest": [top], "n": [1], "total": [-(-total // size)]}
        return pa.table(made, schema=pa.schema([("key", pa.string()), ("pos", pa.int64()), ("digest", pa.string()), ("n", pa.int64()), ("total", pa.int64())]))

    dealt = _dealt(rows, size).select("key", "block", "at", "n", "digest", "total")
    return checkpointed(dealt.groupBy("key", "block").applyInArrow(run, "key string, pos long, digest string, n long, total long"))


def _tables(rows: DataFrame, levels: int) -> list[DataFrame]:
    """The nodes above the rows' blocks, table by table, up to one node of each key."""
    out = [_up(rows, levels)]
    while (out[-1].agg(F.max("total")).first()[0] or 0) > 1:
        out.append(_up(out[-1], levels))
    return out


def _down(rows: DataFrame, above: DataFrame, levels: int, made: Callable[[pa.Table, pa.Table], pa.Table], kinds: str) -> DataFrame:
    """Blocks of rows, each with the path of its top."""
    dealt = _dealt(rows, FANOUT**levels)
    parents = above.select("key", F.col("pos").alias("block"), "path", "subroot", "root")
    return dealt.groupBy("key", "block").cogroup(parents.groupBy("key", "block")).applyInArrow(made, kinds)


def _paths(rows: DataFrame, above: DataFrame, levels: int) -> DataFrame:
    """``(key, pos, path, subroot, root)`` of nodes whose parents' are given."""

    def run(rows: pa.Table, above: pa.Table) -> pa.Table:
        rows, own, total = _block(rows)
        matrices = climb(own, total, levels)
        upper = above.column("path")[0].as_py()
        paths = [[{"left": a.decode(), "right": b.decode()} for a, b in siblings(matrices, i)] + upper for i in range(len(own))]
        fixed = {c: [above.column(c)[0].as_py()] * len(own) for c in ("subroot", "root")}
        kinds = pa.schema([("key", pa.string()), ("pos", pa.int64()), ("path", _PATH), ("subroot", pa.string()), ("root", pa.string())])
        return pa.table({"key": rows.column("key"), "pos": rows.column("pos"), "path": paths, **fixed}, schema=kinds)

    return checkpointed(_down(rows, above, levels, run, f"key string, pos long, path {PATH}, subroot string, root string"))


def manifest(
    docs: DataFrame,
    *,
    id_col: str = "doc_id",
    source_col: str = "source",
    fields: Sequence[str] = FIELDS,
    claimed: Column | None = None,
    with_path: bool = False,
    levels: int = LEVELS,
) -> DataFrame:
    """``(id, leaf, subroot, root, proof_sha256, folded_root, verified)`` of each row of ``docs``.

    ``leaf`` is the digest of the row's fields, ``subroot`` that of its source
    (null is a source), ``root`` that of all. ``proof_sha256`` is the digest of
    the siblings from the leaf to the root, ``folded_root`` the root that they
    make with the leaf ``claimed`` for the row, or with its own where none is
    (null), and ``verified`` whether it is the root. ``with_path`` adds the
    siblings, left and right of each level's node (6 kB a row or so).

    Leaves ascend by id, null first; of one id, by leaf. Rows that repeat are
    leaves each. Rows alone in all have no siblings. No rows give none; texts
    are taken whole, and columns that are not named don't matter.
    """
    spark = docs.sparkSession
    ship_package(spark)
    # Null before every name, and names by their bytes.
    key = F.coalesce(F.concat(F.lit("="), column(source_col).cast("string")), F.lit("")).alias("key")
    claim = F.lit(None).cast("string") if claimed is None else claimed
    rows = docs.select(key, column(id_col).alias("id"), leaf(*[column(c) for c in fields]).alias("digest"), claim.alias("claim"))
    # Equal rows travel as one, with a count.
    rows = checkpointed(rows.groupBy("key", "id", "digest", "claim").agg(F.count(F.lit(1)).alias("n")))
    leaves = checkpointed(_numbered(rows, "key", ["id", "digest", "claim"]))
    nodes = _tables(leaves, levels)

    subroots = nodes[-1].select(F.lit("").alias("all"), "key", "digest", "n")
    sources = checkpointed(_numbered(subroots, "all", ["key"]).withColumnsRenamed({"key": "source", "all": "key"}))
    above = _tables(sources, levels)
    paths = above[-1].select("key", "pos", F.array().cast(PATH).alias("path"), F.col("digest").alias("subroot"), F.col("digest").alias("root"))
    for at in [*above[-2::-1], sources]:
        paths = _paths(at, paths, levels)
    named = sources.join(paths.select("pos", "path", "root"), "pos").select(F.col("source").alias("key"), "path", "root")
    paths = nodes[-1].join(named, "key").select("key", "pos", "path", F.col("digest").alias("subroot"), "root")
    for at in nodes[-2::-1]:
        paths = _paths(at, paths, levels)

    kind = dict(docs.dtypes)[id_col]
    names = ["leaf", "subroot", "root", "proof_sha256", "folded_root"]

    def prove(rows: pa.Table, above: pa.Table) -> pa.Table:
        rows, own, total = _block(rows)
        matrices = climb(own, total, levels)
        upper = [(p["left"].encode(), p["right"].encode()) for p in above.column("path")[0].as_py()]
        often = rows.column("n").to_numpy()
        claims = np.repeat(np.array(rows.column("claim").to_pylist(), dtype=object), often).tolist()
        out: list[list] = [[], [], []]
        for i, claimed in enumerate(claims):
            path = siblings(matrices, i) + upper
            out[0].append(_sha(b"".join(a + b for a, b in path)))
            out[1].append(folded(claimed.encode() if claimed else own[i].tobytes(), path).decode())
            if with_path:
                out[2].append([{"left": a.decode(), "right": b.decode()} for a, b in path])
        each = pa.array(np.repeat(np.arange(len(often)), often))
        fixed = [pa.array([above.column(c)[0].as_py()] * len(own), pa.string()) for c in ("subroot", "root")]
        columns = [rows.column("id").take(each), rows.column("digest").take(each), *fixed, pa.array(out[0], pa.string()), pa.array(out[1], pa.string())]
        return pa.table([*columns, *([pa.array(out[2], _PATH)] if with_path else [])], names=["id", *names, *(["path"] if with_path else [])])

    kinds = f"id {kind}, " + ", ".join(f"{n} string" for n in names) + (f", path {PATH}" if with_path else "")
    proved = _down(leaves, paths, levels, prove, kinds)
    return proved.withColumn("verified", F.col("folded_root") == F.col("root")).withColumnRenamed("id", id_col)


def op12_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's place in the manifest; of those whose id's CRC 5 divides, a lower-cased text is held against it."""
    docs = table(spark, sf_dir, "documents")
    values = {c: F.col(c) for c in FIELDS} | {"text": ascii_lower(F.col("text"))}
    tampered = F.when(F.crc32(F.col("doc_id").cast("string")) % 5 == 0, leaf(*values.values()))
    return manifest(docs, claimed=tampered)
