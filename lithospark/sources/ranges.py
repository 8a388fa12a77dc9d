"""Large GeoJSON files read in byte ranges, by many tasks.

A range may begin anywhere, inside a text or a feature. A first pass over all
ranges counts quotes, and brackets both for a range that begins outside a text
and for one that begins inside; from these, running sums over a file's ranges
give the state at each range's start, exactly. In the second pass each range
yields the features that begin in it, reading on to the end of its last one.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from itertools import groupby
from typing import BinaryIO, NamedTuple

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.geometry import with_bounds
from ..session import checkpointed, ship_package
from .geojson import FEATURE, MEMBERS, NATURAL_KEYS, layer_of, named, own_layer

#: Bytes of a range.
RANGE_BYTES = 16 << 20
#: Bytes that are read on for a feature that goes on after its range: at first, and at a time at most.
FIRST_BYTES, MORE_BYTES = 1 << 12, 1 << 20
#: Ranges of a task at most, where they are small.
RANGES_EACH = 256
#: Bytes of features' texts that are handed on at once, about.
HANDED_BYTES = 4 << 20
#: Brackets around a feature: the collection's and its list's.
DEPTH = 2

_STEP = np.zeros(256, dtype=np.int8)
_STEP[[ord("{"), ord("[")]] = 1
_STEP[[ord("}"), ord("]")]] = -1


class Part(NamedTuple):
    """Where brackets stand in a part of a text, how many of the part's quotes come before each, and its quotes in all."""

    places: np.ndarray
    quotes: np.ndarray
    total: int


def part_of(data: np.ndarray, escapes: int = 0) -> Part:
    """The structure of a part that ``escapes`` backslashes come right before."""
    quotes = np.flatnonzero(data == ord('"'))
    behind = np.flatnonzero((quotes == 0) | (data[quotes - 1] == ord("\\")))
    escaped = []
    for k in behind.tolist():
        at = int(quotes[k])
        run = at
        while run and data[run - 1] == ord("\\"):
            run -= 1
        if (at - run + (escapes if run == 0 else 0)) % 2:
            escaped.append(k)
    quotes = np.delete(quotes, escaped)
    places = np.flatnonzero(_STEP[data])
    return Part(places, np.searchsorted(quotes, places), len(quotes))


def _open(path: str) -> BinaryIO:
    if path.startswith("file:") or "://" not in path:
        return fs.LocalFileSystem().open_input_file("/" + path.removeprefix("file:").lstrip("/"))
    found, inside = fs.FileSystem.from_uri(path.replace("s3a://", "s3://"))
    return found.open_input_file(inside)


def _read(file: BinaryIO, start: int, end: int) -> np.ndarray:
    file.seek(start)
    return np.frombuffer(file.read(end - start), dtype=np.uint8)


def _escapes(file: BinaryIO, start: int) -> int:
    """How many backslashes stand right before a place."""
    n = 0
    while n < start:
        back = bytes(_read(file, max(0, start - n - 1024), start - n))
        run = len(back) - len(back.rstrip(b"\\"))
        n += run
        if run < len(back):
            break
    return n


def _opened(rows: list[dict]) -> Iterator[tuple[BinaryIO, dict]]:
    """Ranges with their files, each opened once."""
    order = sorted(rows, key=lambda r: (r["path"], r["start"]))
    for path, same in groupby(order, key=lambda r: r["path"]):
        with _open(path) as file:
            for row in same:
                yield file, row


def _summary(file: BinaryIO, start: int, end: int) -> tuple[int, int, int, str]:
    """A range's quotes, its change of depth if it begins outside a text and if inside, and the file's first character."""
    data = _read(file, start, end)
    part = part_of(data, _escapes(file, start))
    head = bytes(_read(file, 0, 64)).lstrip(b"\xef\xbb\xbf \t\r\n")[:1] if start == 0 else b""
    steps = _STEP[data[part.places]].astype(np.int64)
    outside = part.quotes % 2 == 0
    return part.total, int(steps[outside].sum()), int(steps[~outside].sum()), head.decode("latin-1")


def _features(file: BinaryIO, path: str, start: int, end: int, size: int, inside: int, depth: int) -> Iterator[tuple[int, str]]:
    """The objects at the features' depth that begin in a range, with their places."""
    data = _read(file, start, end)
    part = part_of(data, _escapes(file, start))
    places = part.places[(part.quotes + inside) % 2 == 0]
    kinds = data[places]
    after = depth + np.cumsum(_STEP[kinds].astype(np.int64))
    if (start and depth == 0 and len(places)) or (after[:-1] == 0).any():
        raise ValueError(f"not one feature collection: {path}")
    begins = places[(kinds == ord("{")) & (after == DEPTH + 1)]
    ends = places[(kinds == ord("}")) & (after == DEPTH)]
    if len(begins) and (not len(ends) or ends[-1] < begins[-1]):
        # The last one goes on after the range: its brackets are counted on, in the state that the range ends in.
        level, within = int(after[-1]), (inside + part.total) % 2
        at, more, step = end, [data], FIRST_BYTES
        while at < size:
            then, step = min(size, at + step), min(2 * step, MORE_BYTES)
            block = _read(file, at, then)
            own = part_of(block, _escapes(file, at))
            spots = own.places[(own.quotes + within) % 2 == 0]
            levels = level + np.cumsum(_STEP[block[spots]].astype(np.int64))
            more.append(block)
            closed = np.flatnonzero(levels == DEPTH)
            if len(closed):
                ends = np.append(ends, at - start + spots[closed[0]])
                break
            level, within, at = (int(levels[-1]) if len(levels) else level), (within + own.total) % 2, then
        data = np.concatenate(more)
    for begin in begins.tolist():
        later = int(np.searchsorted(ends, begin))
        if later < len(ends):
            yield start + begin, bytes(data[begin : int(ends[later]) + 1]).decode()


def scan_layer(
    spark: SparkSession, path: str, *, layer: str | None = None, repair: bool = False, keys: Sequence[str] = NATURAL_KEYS, range_bytes: int = RANGE_BYTES
) -> DataFrame:
    """The layers of files, as ``read_layer`` gives them, with a task for each range of bytes instead of each file; small ranges share tasks.

    Features are the objects of type ``Feature`` in a list of the outermost
    object. One without an id or key is named by its place in bytes (``@123``).
    A file that isn't one whole collection is an error, as is a fragment unless
    ``repair`` is set. Tasks open the files themselves: local paths of a shared
    disk, or stores that Arrow knows (hdfs, s3, gs).
    """
    ship_package(spark)
    files = spark.read.format("binaryFile").load(path).select("path", "length").where("length > 0")
    ranges = files.select("path", "length", F.explode(F.expr(f"sequence(0L, length - 1, {range_bytes}L)")).alias("start"))
    ranges = ranges.withColumn("end", F.least(F.col("start") + range_bytes, F.col("length")))
    many = ranges.count()
    least = max(4 * spark.sparkContext.defaultParallelism, many // RANGES_EACH, many * range_bytes // RANGE_BYTES)
    tasks = min(20_000, max(1, many), least)

    def summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = [(r["path"], r["length"], r["start"], r["end"], *_summary(file, r["start"], r["end"])) for file, r in _opened(batch.to_pylist())]
            if made:
                kinds = (pa.string(), *(pa.int64(),) * 6, pa.string())
                arrays = [pa.array(c, k) for c, k in zip(zip(*made, strict=True), kinds, strict=True)]
                yield pa.RecordBatch.from_arrays(arrays, [*batch.schema.names, "quotes", "outside", "within", "head"])

    kinds = "path string, length long, start long, end long"
    told = checkpointed(ranges.repartition(tasks).mapInArrow(summed, f"{kinds}, quotes long, outside long, within long, head string"))
    of_file = Window.partitionBy("path").orderBy("start")
    before = of_file.rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy("path")
    told = told.withColumn("inside", F.coalesce(F.sum("quotes").over(before), F.lit(0)) % 2)
    told = told.withColumn("change", F.when(F.col("inside") == 0, F.col("outside")).otherwise(F.col("within")))
    bare = F.max(F.when(F.col("start") == 0, (F.col("head") != "{").cast("long"))).over(whole)
    told = told.withColumns({"bare": bare, "depth": F.coalesce(F.sum("change").over(before), F.lit(0)), "left": F.sum("change").over(whole), "open": F.sum("quotes").over(whole) % 2})
    name = F.lit(layer) if layer else layer_of(F.col("path"))
    fault = F.when((F.col("left") != 0) | (F.col("open") != 0), "not one feature collection: ")
    if not repair:
        fault = F.when(F.col("bare") == 1, "not a feature collection: ").otherwise(fault)
    told = told.withColumn("depth", F.when(fault.isNull(), F.col("depth") + F.col("bare")).otherwise(F.raise_error(F.concat(fault, name)).cast("long")))

    def found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, size = [], 0

        def handed() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), (pa.string(), pa.int64(), pa.string()), strict=True)], ["path", "at", "text"])

        for batch in batches:
            for file, row in _opened(batch.to_pylist()):
                for place, text in _features(file, row["path"], row["start"], row["end"], row["length"], row["inside"], row["depth"]):
                    out.append((row["path"], place, text))
                    size += len(text)
                    if size > HANDED_BYTES:
                        yield handed()
                        out, size = [], 0
        if out:
            yield handed()

    texts = told.select("path", "length", "start", "end", "inside", "depth").repartition(tasks).mapInArrow(found, "path string, at long, text string")
    read = texts.select(name.alias("layer"), "at", F.from_json("text", FEATURE).alias("f")).where(F.col("f.type") == "Feature")
    return with_bounds(named(read.select(own_layer(F.col("layer")), "at", *MEMBERS), F.concat(F.lit("@"), F.col("at").cast("string")), keys))
