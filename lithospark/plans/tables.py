"""Layers made from the driver's tables, which hold no geometry.

Parts become mining claims, suppliers land units, customers points; keys give
places, so their density stays the same however large the tables are. Texts are
GeoJSON, many layers of a bounded number of features each; some of the units'
are fragments.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.geometry import with_bounds
from ..operators.layers import AREA, CLASSES, CONFLICTS, GRANTED, HOLDER, NAME, PLACE, POLICY, POPULATION, SUBSTANCES, TITLE, UNIT, UNIT_AREA
from ..sources.geojson import parse_layers

#: Features in a layer's text.
CLAIMS_EACH, UNITS_EACH = 50, 4
METALS = ("Au", "Ag", "Cu", "Fe", "Mn", "Ni", "Ti", "Zn")
POLICIES = ("Protección ", "Conservación ", "Aprovechamiento")
KINDS = ("Faro, Muelle y Bahía", "Selva y Manglar", "Río")
TROUBLES = ("Ruido y polvo, Basura ", "Tala", None)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _one_of(values: tuple, k: Column) -> Column:
    return F.element_at(F.array(*[F.lit(v) for v in values]), (k % len(values) + 1).cast("int"))


def _ring(*points: tuple[Column, Column]) -> Column:
    return F.array(*[F.array(x, y) for x, y in points])


def _square(x: Column, y: Column, w: Column) -> Column:
    return _ring((x, y), (x + w, y), (x + w, y + w), (x, y + w), (x, y))


def _texts(features: DataFrame, each: int, name: str) -> DataFrame:
    """``(layer, number, body)`` from rows ``(k, properties, geometry, id)`` of JSON: the features of a layer in order of their keys."""
    member = F.coalesce(F.concat(F.lit(',"id":"'), F.col("id"), F.lit('"')), F.lit(""))
    text = F.concat(F.lit('{"type":"Feature","properties":'), F.col("properties"), F.lit(',"geometry":'), F.col("geometry"), member, F.lit("}"))
    rows = features.groupBy(F.expr(f"k div {each}").alias("number")).agg(F.sort_array(F.collect_list(F.struct("k", text.alias("f")))).alias("all"))
    return rows.select(F.concat(F.lit(name), F.col("number").cast("string")).alias("layer"), "number", F.array_join("all.f", ",\n").alias("body"))


def claim_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``(layer, text)``: claims of parts, a square or an L each; substance keys that a claim doesn't use are left out."""
    k, size = F.col("p_partkey"), F.col("p_size")
    metals = [F.when(F.lit(j) <= size % 5, _one_of(METALS, k + j)).alias(key) for j, key in enumerate(SUBSTANCES)]
    properties = F.to_json(
        F.struct(
            k.alias(TITLE), F.concat("p_name", F.lit(" ")).alias(NAME), F.col("p_brand").alias(HOLDER), F.col("p_retailprice").cast("decimal(20,11)").cast("string").alias(AREA),
            F.date_format(F.date_add(F.lit("2000-01-01"), (k % 7000).cast("int")), "yyyy/MM/dd").alias(GRANTED), *metals,
        )
    )
    x, y, w = (k % 40 * 3).cast("double"), (F.expr("p_partkey div 40") * 3).cast("double"), (size % 4 + 2).cast("double")
    bent = _ring((x, y), (x + w, y), (x + w, y + w / 2), (x + w / 2, y + w / 2), (x + w / 2, y + w), (x, y + w), (x, y))
    ring = F.when(k % 3 == 0, bent).otherwise(_square(x, y, w))
    geometry = F.concat(F.lit('{"type":"Polygon","coordinates":['), F.to_json(ring), F.lit("]}"))
    features = table(spark, sf_dir, "part").select(k.alias("k"), properties.alias("properties"), geometry.alias("geometry"), F.lit(None).cast("string").alias("id"))
    return _texts(features, CLAIMS_EACH, "claims ").select("layer", F.concat(F.lit('{"type":"FeatureCollection","features":['), F.col("body"), F.lit("]}")).alias("text"))


def unit_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``(layer, text)``: land units of suppliers, of four kinds of geometry; every other layer is a fragment without its outer braces and with a comma too many."""
    k = F.col("s_suppkey")
    properties = F.to_json(
        F.struct(
            F.col("s_name").alias(UNIT), F.concat(F.lit("N"), F.col("s_nationkey").cast("string")).alias(PLACE), F.col("s_acctbal").alias(UNIT_AREA), (k % 100).alias(POPULATION),
            _one_of(KINDS, k).alias(CLASSES), _one_of(POLICIES, F.col("s_nationkey")).alias(POLICY), _one_of(TROUBLES, k).alias(CONFLICTS),
        )
    )
    x, y, one = (k % 30 * 4).cast("double"), (F.expr("s_suppkey div 30") * 4).cast("double"), F.lit(1.0)
    square, other = F.to_json(_square(x, y, one)), F.to_json(_square(x + 2, y + 2, one))
    shapes = (
        F.concat(F.lit('{"coordinates":['), square, F.lit('],"type":"Polygon"}')),
        F.concat(F.lit('{"type":"MultiPolygon","coordinates":[['), square, F.lit("],["), other, F.lit("]]}")),
        F.concat(F.lit('{"type":"Point","coordinates":'), F.to_json(F.array(x, y)), F.lit("}")),
        F.concat(F.lit('{"type":"LineString","coordinates":'), F.to_json(F.array(F.array(x, y), F.array(x + 3, y - 1))), F.lit("}")),
    )
    geometry = F.element_at(F.array(*shapes), (k % 4 + 1).cast("int"))
    features = table(spark, sf_dir, "supplier").select(k.alias("k"), properties.alias("properties"), geometry.alias("geometry"), F.concat(F.lit("u"), k.cast("string")).alias("id"))
    member = F.concat(F.lit('"features": [\n'), F.col("body"), F.lit("]"))
    text = F.when(F.col("number") % 2 == 0, F.concat(F.lit("\n"), member, F.lit(",\n"))).otherwise(F.concat(F.lit("{"), member, F.lit("}")))
    return _texts(features, UNITS_EACH, "units-").select("layer", text.alias("text"))


def claims_layer(spark: SparkSession, sf_dir: str) -> DataFrame:
    return with_bounds(parse_layers(claim_texts(spark, sf_dir)))


def units_layer(spark: SparkSession, sf_dir: str) -> DataFrame:
    return with_bounds(parse_layers(unit_texts(spark, sf_dir), repair=True))


def points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers as points among the claims."""
    k = F.col("c_custkey")
    x, y = (k * 37 % 1201).cast("double") / 10, (k * 53 % 97).cast("double") / 10 + k.cast("double") / 10
    return table(spark, sf_dir, "customer").select("c_custkey", "c_acctbal", x.alias("x"), y.alias("y"))


def points_layer(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers as one layer of points."""
    rows = points(spark, sf_dir)
    return rows.select(
        F.lit("customers").alias("layer"), F.col("c_custkey").cast("string").alias("feature_id"), F.create_map(F.lit("balance"), F.col("c_acctbal").cast("string")).alias("props"),
        F.lit("Point").alias("geom_type"), F.to_json(F.array("x", "y")).alias("coords_json"), F.col("x").alias("xmin"), F.col("y").alias("ymin"), F.col("x").alias("xmax"), F.col("y").alias("ymax"),
    )


_METALS = "[" + ", ".join(f"'{m}'" for m in METALS) + "]"
_PICK = lambda values, k: "[" + ", ".join("NULL" if v is None else f"'{v}'" for v in values) + f"][CAST({k} % {len(values)} AS INTEGER) + 1]"

#: The same in SQL: ``claims`` with ``r``, their rings; ``e``, their edges; ``units`` with their bounds; ``p``, the points.
SQL = (
    "WITH c AS (SELECT p_partkey AS title, p_name AS name, p_brand AS holder, CAST(p_retailprice AS DECIMAL(20,11)) AS area_ha, "
    "CAST(DATE '2000-01-01' + CAST(p_partkey % 7000 AS INTEGER) AS DATE) AS granted, p_size % 5 + 1 AS many, "
    f"list_transform(range(0, p_size % 5 + 1), lambda j: {_METALS}[CAST((p_partkey + j) % {len(METALS)} AS INTEGER) + 1]) AS substances, "
    f"'claims ' || (p_partkey // {CLAIMS_EACH}) AS layer, CAST(p_partkey AS VARCHAR) AS feature_id, "
    "CAST(p_partkey % 40 * 3 AS DOUBLE) AS x, CAST(p_partkey // 40 * 3 AS DOUBLE) AS y, CAST(p_size % 4 + 2 AS DOUBLE) AS w FROM part), "
    "claims AS (SELECT *, CASE WHEN title % 3 = 0 THEN [[x, y], [x + w, y], [x + w, y + w / 2], [x + w / 2, y + w / 2], [x + w / 2, y + w], [x, y + w], [x, y]] "
    "ELSE [[x, y], [x + w, y], [x + w, y + w], [x, y + w], [x, y]] END AS r FROM c), "
    "e AS (SELECT title, layer, feature_id, k - 1 AS seq, r[k][1] AS x1, r[k][2] AS y1, r[k + 1][1] AS x2, r[k + 1][2] AS y2 FROM (SELECT *, unnest(range(1, len(r))) AS k FROM claims)), "
    f"u AS (SELECT s_suppkey AS k, 'units-' || (s_suppkey // {UNITS_EACH}) AS layer, 'u' || s_suppkey AS feature_id, s_name AS name, s_acctbal AS area_total, CAST(s_suppkey % 100 AS INTEGER) AS population, "
    f"{_PICK(KINDS, 's_suppkey')} AS kinds, trim({_PICK(POLICIES, 's_nationkey')}) AS policy, trim({_PICK(TROUBLES, 's_suppkey')}) AS troubles, "
    "CAST(s_suppkey % 30 * 4 AS DOUBLE) AS x, CAST(s_suppkey // 30 * 4 AS DOUBLE) AS y FROM supplier), "
    "units AS (SELECT *, regexp_split_to_array(kinds, '\\s*,\\s*|\\s+y\\s+') AS classes, regexp_split_to_array(troubles, '\\s*,\\s*') AS conflicts, x AS xmin, CASE WHEN k % 4 = 3 THEN y - 1 ELSE y END AS ymin, "
    "x + [1, 3, 0, 3][CAST(k % 4 AS INTEGER) + 1] AS xmax, y + [1, 3, 0, 0][CAST(k % 4 AS INTEGER) + 1] AS ymax FROM u), "
    "p AS (SELECT c_custkey, c_acctbal, CAST(c_custkey * 37 % 1201 AS DOUBLE) / 10 AS x, CAST(c_custkey * 53 % 97 AS DOUBLE) / 10 + CAST(c_custkey AS DOUBLE) / 10 AS y FROM customer) "
)
