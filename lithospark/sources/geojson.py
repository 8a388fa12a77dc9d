"""GeoJSON layers as DataFrames.

A layer is a feature collection, one file each. Coordinates stay JSON text
until a geometry function parses them by type, so points and multipolygons are
not lost to a polygon's schema; attributes are a map, so a key that a feature
leaves out differs from one that is null.

``read_layer`` takes a file as one JSON text, so one task reads it whole and it
must be under 2 GB; ``ranges.scan_layer`` reads a large one in many tasks, and
``ingest`` writes layers in a form that filters reach. What this module writes
has a folder a layer as long as layers are few; thousands share files, as
opening a file takes longer than reading a small layer.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.geometry import with_bounds
from ..operators.layers import TITLE
from ..session import checkpointed, exists

FEATURE = "struct<type: string, layer: string, id: string, properties: map<string, string>, geometry: struct<type: string, coordinates: string, geometries: string>>"
FEATURES = f"array<{FEATURE}>"
ENVELOPE = f"type string, features {FEATURES}"
#: Layers that are written to a folder each, at most.
FOLDERS = 100
#: The folder of collections whose features name their layers.
SHARED = "layers=many.geojson"
#: Bytes of a collection in it, about.
SHARED_BYTES = 8 << 20
#: The folder of layers' texts that share files.
TEXTS = "texts=many.parquet"
OPEN, CLOSE = '{"type":"FeatureCollection","features":[', "]}"
#: The attributes that tell features apart where they have no id.
NATURAL_KEYS = (TITLE,)
#: A layer's features, with bounds.
LAYERS = "layer string, feature_id string, props map<string, string>, geom_type string, coords_json string, xmin double, ymin double, xmax double, ymax double"


def repaired(text: Column) -> Column:
    """The text of a fragment made whole: its trailing comma dropped, its outer braces added.

    A text that begins with a brace is left as it is.
    """
    bare = F.regexp_replace(text, r"[\s,]+$", "")
    return F.when(text.rlike(r"^\s*\{"), text).otherwise(F.concat(F.lit("{"), bare, F.lit("}")))


def parse_layers(texts: DataFrame, *, repair: bool = False, keys: Sequence[str] = NATURAL_KEYS) -> DataFrame:
    """``(layer, feature_id, props, geom_type, coords_json)`` from rows ``(layer, text)``.

    A feature without an id is named by the first of the attributes ``keys``
    that it has, one without those by its place in the layer (``#0``). A text
    that is no feature collection, or that goes on after the first, raises an
    error that names the layer; with ``repair`` fragments of one are read too.
    """
    text = repaired(F.col("text")) if repair else F.col("text")
    name = F.coalesce("layer", F.lit("?"))
    read = F.from_json(text, ENVELOPE, {"mode": "PERMISSIVE"}).features
    fail = lambda what: F.raise_error(F.concat(F.lit(what), name)).cast(FEATURES)
    # As the one item of a list, a text is JSON only if nothing follows it.
    alone = F.json_array_length(F.concat(F.lit("["), text, F.lit("]"))).eqNullSafe(F.lit(1))
    whole = F.when(read.isNull(), fail("not a feature collection: ")).when(~alone, fail("not one feature collection: ")).otherwise(read)
    features = texts.select("layer", F.posexplode(whole).alias("at", "f")).select(own_layer(F.col("layer")), "at", *MEMBERS)
    return named(features, F.concat(F.lit("#"), F.col("at").cast("string")), keys)


def named(features: DataFrame, place: Column, keys: Sequence[str]) -> DataFrame:
    """Features as read, with their names and flat: ``place`` names those that nothing else does."""
    return features.select(
        "layer",
        F.coalesce("id", *[F.col("properties")[k] for k in keys], place).alias("feature_id"),
        F.coalesce("properties", F.create_map().cast("map<string, string>")).alias("props"),
        F.col("geometry.type").alias("geom_type"),
        F.coalesce("geometry.coordinates", "geometry.geometries").alias("coords_json"),
    )


#: What of a feature ``f`` is kept.
MEMBERS = ("f.id", "f.properties", "f.geometry")


def own_layer(layer: Column) -> Column:
    """The layer of a feature ``f`` read from a file of ``layer``: in a shared file, the feature names it."""
    return F.when(layer == SHARED.removesuffix(".geojson"), F.coalesce("f.layer", layer)).otherwise(layer).alias("layer")


def _few(layers: DataFrame) -> bool:
    """Whether layers are so few that each may have a folder."""
    return layers.select("layer").distinct().limit(FOLDERS + 1).count() <= FOLDERS


def _decoded(text: Column) -> Column:
    return F.url_decode(F.replace(text, F.lit("+"), F.lit("%2B")))


def layer_of(path: Column) -> Column:
    """The layer that a file belongs to: its name, or that of the folder ``*.geojson`` that it lies in, less the ending.

    Folders that ``write_layers`` made begin with ``file=``.
    """
    of_folder = F.regexp_extract(path, r"([^/]+)\.geojson/[^/]*$", 1)
    of_folder = F.when(F.startswith(of_folder, F.lit("file=")), _decoded(F.substring(of_folder, 6, 1 << 30))).otherwise(of_folder)
    return F.when(of_folder != "", of_folder).otherwise(F.regexp_replace(F.element_at(F.split(path, "/"), -1), r"\.[^.]*$", ""))


def read_layer(spark: SparkSession, path: str, *, layer: str | None = None, repair: bool = False, keys: Sequence[str] = NATURAL_KEYS) -> DataFrame:
    """One layer file; the layer is named after the file unless told otherwise."""
    return with_bounds(parse_layers(_files(spark, path, layer), repair=repair, keys=keys))


def _files(spark: SparkSession, path: str, layer: str | None = None) -> DataFrame:
    name = F.lit(layer) if layer else layer_of(_decoded(F.col("_metadata.file_path")))
    return spark.read.text(path, wholetext=True).select(name.alias("layer"), F.col("value").alias("text"))


def write_texts(texts: DataFrame, folder: str) -> None:
    """Writes rows ``(layer, text)``, the whole text of a layer each, as they are, fragments too; ``read_layers`` reads them.

    Up to ``FOLDERS`` layers have a folder ``file=<layer>.geojson`` each. More
    share the files of one folder, ``TEXTS``, a row a layer.
    """
    if _few(texts):
        texts.select("text", F.concat("layer", F.lit(".geojson")).alias("file")).write.partitionBy("file").text(folder)
    else:
        texts.select("layer", "text").write.parquet(f"{folder}/{TEXTS}")


def read_layers(spark: SparkSession, folder: str, *, prefix: str = "", repair: bool = False, keys: Sequence[str] = NATURAL_KEYS) -> DataFrame:
    """Every ``*.geojson`` of a folder, each a layer: a file, or a folder of files as Spark writes it; layers that share files are among them.

    ``prefix`` is what the names of the wanted layers begin with.
    """
    found = []
    if exists(spark, f"{folder}/{TEXTS}"):
        found.append(spark.read.parquet(f"{folder}/{TEXTS}"))
    if not found or exists(spark, f"{folder}/*.geojson"):
        found.append(_files(spark, f"{folder}/*.geojson"))
    wanted = F.startswith(F.col("layer"), F.lit(prefix))
    # Before the texts are parsed, and again for the features of shared files.
    texts = [t.where(wanted | (F.col("layer") == SHARED.removesuffix(".geojson"))) if prefix else t for t in found]
    every = reduce(DataFrame.unionByName, [with_bounds(parse_layers(t, repair=repair, keys=keys)) for t in texts])
    return every.where(wanted) if prefix else every


def feature_json() -> Column:
    """A feature as GeoJSON text, from the columns of a layer; attributes are written as text, as they are held."""
    head = F.to_json(F.struct(F.lit("Feature").alias("type"), F.col("feature_id").alias("id"), F.col("props").alias("properties")))
    member = F.when(F.col("geom_type") == "GeometryCollection", "geometries").otherwise("coordinates")
    kind = F.concat(F.lit('{"type":"'), F.col("geom_type"), F.lit('","'), member, F.lit('":'), F.col("coords_json"), F.lit("}"))
    return F.concat(F.regexp_replace(head, r"\}$", ""), F.lit(',"geometry":'), F.coalesce(kind, F.lit("null")), F.lit("}"))


def write_layers(features: DataFrame, folder: str, *, mode: str = "errorifexists") -> None:
    """Writes layers as GeoJSON collections with a line a feature.

    Up to ``FOLDERS`` layers have a folder ``file=<layer>.geojson`` each; each
    task writes what it holds of a layer to a file of its own, so a layer is as
    many files as it has parts. More share the files of one folder, ``SHARED``,
    and their features have a member ``layer``. ``read_layers`` and
    ``scan_layer`` read both back as they were.
    """
    # Read again: to tell whether layers are few, for the ranges, and to write.
    rows = checkpointed(features.select("layer", feature_json().alias("value")))
    if _few(rows):
        column, file, value = "file", F.concat("layer", F.lit(".geojson")), F.col("value")
        rows = rows.repartitionByRange("layer", "value")
    else:
        column, file = SHARED.split("=")
        size = rows.agg(F.sum(F.octet_length("value"))).first()[0]
        file, value = F.lit(file), F.concat(F.regexp_replace(F.to_json(F.struct("layer")), r"\}$", ","), F.substring("value", 2, 1 << 30))
        rows = rows.repartitionByRange(-(-size // SHARED_BYTES), "layer", "value")

    def framed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        begun: set[str] = set()
        for batch in batches:
            files, values = (c.to_pylist() for c in batch.columns)
            out = []
            for file, value in zip(files, values, strict=True):
                if file not in begun:
                    begun.add(file)
                    out += [(file, 0, OPEN), (file, 1, value), (file, 3, CLOSE)]
                else:
                    out.append((file, 2, "," + value))
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*out, strict=True)], [column, "rank", "value"])

    lines = rows.select(file.alias("file"), value.alias("value")).mapInArrow(framed, f"{column} string, rank long, value string")
    # In the order that writing by file asks for, so that it sorts no more.
    lines.sortWithinPartitions(column, "rank").select("value", column).write.mode(mode).partitionBy(column).text(folder)


#: Bits of each axis in a place on the curve.
CURVE_BITS = 16


def _spread(v: Column) -> Column:
    """A number's 16 bits with a gap after each."""
    for by, mask in ((8, 0x00FF00FF), (4, 0x0F0F0F0F), (2, 0x33333333), (1, 0x55555555)):
        v = v.bitwiseOR(F.shiftleft(v, by)).bitwiseAND(F.lit(mask).cast("long"))
    return v


def on_curve(layers: DataFrame) -> Column:
    """The place of a feature's middle on a curve that goes through all bounds in squares within squares; null without bounds."""
    low_x, low_y, high_x, high_y = layers.agg(F.min("xmin"), F.min("ymin"), F.max("xmax"), F.max("ymax")).first()
    top = (1 << CURVE_BITS) - 1

    def axis(low: str, high: str, least: float | None, most: float | None) -> Column:
        middle = (F.col(low) + F.col(high)) / 2 - F.lit(least or 0.0)
        return F.floor(middle * (top / ((most or 0.0) - (least or 0.0) or 1.0))).cast("long")

    x, y = axis("xmin", "xmax", low_x, high_x), axis("ymin", "ymax", low_y, high_y)
    return _spread(x).bitwiseOR(F.shiftleft(_spread(y), 1))


def ingest(layers: DataFrame, path: str, *, parts: int | None = None) -> None:
    """Writes layers for fast loading: Parquet in order of layers and, in each, of a space-filling curve, so that parts of files are small squares.

    A view then meets few of them by their bounds, in both directions; sorted by
    ``xmin`` alone, they would be strips as high as the layer. Up to
    ``FOLDERS`` layers have a folder each. Of more, whose folders would take
    longer than their rows, the names are a column, and filters on layers go by
    its bounds in the files. ``parts`` says how many tasks write.
    """
    # Read once: the ends of the curve, the ranges and the rows are three passes.
    layers = checkpointed(layers)
    rows = layers.withColumn("__place", on_curve(layers))
    order = ["layer", "__place", "feature_id"]
    rows = rows.repartitionByRange(parts, *order) if parts else rows.repartitionByRange(*order)
    rows = rows.sortWithinPartitions(*order).drop("__place")
    (rows.write.partitionBy("layer") if _few(layers) else rows.write).parquet(path)


def open_layers(spark: SparkSession, path: str) -> DataFrame:
    """Ingested layers, their names as they were written."""
    return spark.read.schema(LAYERS).parquet(path).select("layer", "feature_id", "props", "geom_type", "coords_json", "xmin", "ymin", "xmax", "ymax")
