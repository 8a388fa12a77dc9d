"""Queries of geographic layers.

The driver's tables hold no geometry: the layers are made from their keys, as
GeoJSON text that is read back (see ``tables``).
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.attributes import has_prop, listed, matches_text, prop
from ..functions.geometry import centroid, hectares, ring_faults, rings, signed_area, vertex_count, with_bounds
from ..functions.sql import query
from ..operators.layers import CLASSES, HOLDER, LAST_ITEM, NAME, POLICY, SUBSTANCES, UNIT, by_key, by_substance, categories, concessions, in_view, land_units, layers, repeats, where, with_policy, with_substance
from ..operators.spatial import bounds, edges, planar_areas, points_in_polygons
from ..session import temporary_folder
from ..sources.geojson import ingest, open_layers, parse_layers, read_layers, write_layers, write_texts
from ..sources.ranges import scan_layer
from . import tables
from .tables import claim_texts, claims_layer, points, points_layer, unit_texts, units_layer


def _claims(spark: SparkSession, sf_dir: str) -> DataFrame:
    return concessions(claims_layer(spark, sf_dir))


def _plain(name: str) -> Column:
    """A date as text and a decimal as a double, as any engine hands them over."""
    return F.col(name).cast("string" if name == "granted" else "double").alias(name)


def _both(spark: SparkSession, sf_dir: str) -> DataFrame:
    return claims_layer(spark, sf_dir).unionByName(units_layer(spark, sf_dir))


def _claim_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return edges(claims_layer(spark, sf_dir))


def _ring() -> Column:
    return F.element_at(rings(F.col("geom_type"), F.col("coords_json")), 1)


def _written(spark: SparkSession, texts: DataFrame) -> str:
    """Layers as files of a folder."""
    folder = temporary_folder(spark, "layers")
    write_texts(texts, folder)
    return folder


def claims_typed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _claims(spark, sf_dir).select("layer", "title", "name", _plain("area_ha"), "holder", F.array_join("substances", ",").alias("substances"), _plain("granted"))


def claims_with_iron(spark: SparkSession, sf_dir: str) -> DataFrame:
    return where(with_substance(_claims(spark, sf_dir), "Fe"), F.col("area_ha") > 905).select("title", "name", _plain("area_ha"), _plain("granted"))


def layer_selection(spark: SparkSession, sf_dir: str) -> DataFrame:
    return layers(_both(spark, sf_dir), "units-0", "units-1", "claims 2").select("layer", "feature_id", F.trim(F.coalesce(prop(UNIT), prop(NAME))).alias("name"))


def layer_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _both(spark, sf_dir).groupBy("layer").agg(F.count(F.lit(1)).alias("n"), F.count_if(has_prop(SUBSTANCES[2])).alias("with_third"))


def unit_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    units = land_units(units_layer(spark, sf_dir))
    return units.select("name", "population", "area_total", "policy", F.array_join("classes", "|").alias("classes"), F.array_join("conflicts", "|").alias("conflicts"))


def units_by_policy(spark: SparkSession, sf_dir: str) -> DataFrame:
    return with_policy(units_layer(spark, sf_dir), "Protección").select("layer", "feature_id")


def policy_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    return categories(_both(spark, sf_dir), POLICY)


def holder_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    return categories(_both(spark, sf_dir), HOLDER)


def text_without_accents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return units_layer(spark, sf_dir).where(matches_text(prop(CLASSES), "bahia")).select("feature_id", F.size(listed(prop(CLASSES), last=LAST_ITEM)).cast("long").alias("items"))


def features_in_view(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Features of every kind of geometry whose bounds meet a rectangle."""
    return in_view(_both(spark, sf_dir), 10.5, 1.5, 50.0, 4.0).select("layer", "feature_id", "geom_type")


def area_by_holder(spark: SparkSession, sf_dir: str) -> DataFrame:
    return by_key(_claims(spark, sf_dir), "holder").withColumn("area_ha", _plain("area_ha"))


def area_by_year(spark: SparkSession, sf_dir: str) -> DataFrame:
    return by_key(_claims(spark, sf_dir), F.year("granted").cast("long").alias("year")).withColumn("area_ha", _plain("area_ha"))


def area_by_substance(spark: SparkSession, sf_dir: str) -> DataFrame:
    return by_substance(_claims(spark, sf_dir)).withColumn("area_ha", _plain("area_ha"))


def claim_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _claim_edges(spark, sf_dir).select("layer", "feature_id", F.col("seq").cast("long").alias("seq"), "x1", "y1", "x2", "y2")


def claim_bounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bounds(_claim_edges(spark, sf_dir), "layer", "feature_id")


def claim_areas(spark: SparkSession, sf_dir: str) -> DataFrame:
    return planar_areas(_claim_edges(spark, sf_dir), "layer", "feature_id")


def claim_measures(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = claims_layer(spark, sf_dir).select("layer", "feature_id", _ring().alias("ring"))
    return made.select(
        "layer",
        "feature_id",
        signed_area("ring").alias("area"),
        vertex_count(F.col("ring")).cast("long").alias("vertices"),
        F.size(ring_faults(F.col("ring"))).cast("long").alias("faults"),
        F.round(hectares(F.col("ring")), 1).alias("hectares"),
        F.round(centroid(F.col("ring"))["x"], 4).alias("cx"),
        F.round(centroid(F.col("ring"))["y"], 4).alias("cy"),
    )


def _customers_inside(spark: SparkSession, sf_dir: str) -> DataFrame:
    return points_in_polygons(points(spark, sf_dir), _claim_edges(spark, sf_dir))


def customers_in_claims(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers as points in claims, and what they hold: a spatial join and an aggregate."""
    balance = F.sum(F.col("c_acctbal").cast("decimal(20,2)")).cast("double")
    return _customers_inside(spark, sf_dir).groupBy("layer", "feature_id").agg(F.count(F.lit(1)).alias("n"), balance.alias("balance"))


def points_per_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many points lie in no, one or more claims."""
    hits = _customers_inside(spark, sf_dir).groupBy("c_custkey").agg(F.count(F.lit(1)).alias("k"))
    return points(spark, sf_dir).join(hits, "c_custkey", "left").groupBy(F.coalesce("k", F.lit(0)).alias("claims")).agg(F.count(F.lit(1)).alias("n"))


def orders_in_claims(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders at their customers' points, so that points repeat: each counts."""
    places = points(spark, sf_dir).select("c_custkey", "x", "y")
    orders = tables.table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey")
    # By shuffle: Spark guesses the points' size by their files and would broadcast millions of them.
    hits = points_in_polygons(orders.join(places.hint("merge"), F.col("o_custkey") == F.col("c_custkey")), _claim_edges(spark, sf_dir))
    return hits.groupBy("layer", "feature_id").agg(F.count(F.lit(1)).alias("orders"), F.countDistinct("c_custkey").alias("customers"))


def layer_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All layers written as files, fragments among them, and read as a folder: the features' names and bounds."""
    folder = _written(spark, claim_texts(spark, sf_dir).unionByName(unit_texts(spark, sf_dir)))
    found = read_layers(spark, folder, repair=True)
    return found.select("layer", "feature_id", F.trim(F.coalesce(prop(NAME), prop(UNIT))).alias("name"), "xmin", "ymin", "xmax", "ymax")


def layer_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Layers of one kind written as files and read by their names: typed claims by their own key, and how many sides each has."""
    folder = _written(spark, claim_texts(spark, sf_dir))
    claims = concessions(read_layers(spark, folder, prefix="claims"))
    sides = edges(claims).groupBy("layer", "feature_id").agg(F.count(F.lit(1)).alias("sides"))
    joined = claims.join(sides, ["layer", "feature_id"])
    return joined.select("layer", "feature_id", "title", "holder", _plain("area_ha"), "sides")


def ingested_view(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All layers ingested to Parquet; those in view of two layers, pushed down to the files."""
    folder = temporary_folder(spark, "ingested")
    ingest(_both(spark, sf_dir), folder)
    return in_view(layers(open_layers(spark, folder), "claims 0", "units-1"), 10.5, 1.5, 50.0, 4.0).select("layer", "feature_id", "xmin", "ymax")


def view_of_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers as a layer in order of a curve; those in a view, of which few files hold any."""
    folder = temporary_folder(spark, "ingested")
    ingest(points_layer(spark, sf_dir), folder, parts=32)
    return in_view(open_layers(spark, folder), 20.0, 3.0, 50.0, 9.0).select("feature_id", "xmin", "ymin")


def exported(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Units written as GeoJSON and read back in byte ranges, several a file."""
    folder = temporary_folder(spark, "exported")
    write_layers(units_layer(spark, sf_dir), folder)
    units = land_units(scan_layer(spark, f"{folder}/*.geojson", range_bytes=500))
    return units.select("layer", "feature_id", "geom_type", "name", "area_total", "population", "policy", "xmin", "ymin", "xmax", "ymax")


def _ingested(spark: SparkSession, sf_dir: str) -> str:
    folder = temporary_folder(spark, "ingested")
    ingest(_both(spark, sf_dir), folder)
    return folder


SQL_IN_VIEW = "SELECT layer, feature_id, geom_type FROM features WHERE meets_view(xmin, ymin, xmax, ymax, 10.5, 1.5, 50, 4)"
SQL_AREAS = (
    "SELECT holder, count(*) AS n, sum(rings_area(rings_of(geom_type, coords_json))) AS area, max(area_ha) AS largest "
    "FROM claims WHERE layer LIKE 'claims%' AND xmin < 60 AND geom_type = 'Polygon' GROUP BY holder"
)
SQL_HOLDING = (
    "SELECT layer, feature_id FROM features WHERE meets_view(xmin, ymin, xmax, ymax, 13.25, 1.25, 13.25, 1.25) "
    "AND rings_hold(rings_of(geom_type, coords_json), 13.25, 1.25)"
)


def sql_in_view(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A query in SQL: features that meet a rectangle."""
    return query(spark, _ingested(spark, sf_dir), SQL_IN_VIEW)


def sql_areas(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A query in SQL: planar areas of claims by holder."""
    return query(spark, _ingested(spark, sf_dir), SQL_AREAS).withColumn("largest", _plain("largest"))


def sql_holding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A query in SQL: features that hold a point."""
    return query(spark, _ingested(spark, sf_dir), SQL_HOLDING)


def repeated_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Claims read with their names as keys, which they share: the names that don't tell features apart."""
    return repeats(parse_layers(claim_texts(spark, sf_dir), keys=[NAME]))


def faulty_rings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rings made from suppliers' keys, some open, short or clockwise: how many have which faults."""
    key = F.col("s_suppkey")
    point = lambda x, y: F.array(F.lit(float(x)), F.lit(float(y)))
    ring = F.when(key % 5 == 0, F.array(point(0, 0), point(2, 0), point(0, 0))).otherwise(F.array(point(0, 0), point(2, 0), point(2, 2), point(0, 2), point(0, 0)))
    ring = F.when(key % 3 == 0, F.slice(ring, 1, F.size(ring) - 1)).otherwise(ring)
    ring = F.when(key % 2 == 0, F.reverse(ring)).otherwise(ring)
    rows = spark.read.parquet(f"{sf_dir}/supplier.parquet").select(F.array_join(ring_faults(ring), ",").alias("faults"))
    return rows.groupBy("faults").agg(F.count(F.lit(1)).alias("n"))


def generated_layers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A layer for each supplier written as GeoJSON text and read back, by nation."""
    rows = spark.read.parquet(f"{sf_dir}/supplier.parquet")
    text = F.concat(
        F.lit('{"type":"FeatureCollection","features":[{"type":"Feature","properties":{"nation":"'), F.col("s_nationkey").cast("string"),
        F.lit('","key":'), F.col("s_suppkey").cast("string"), F.lit('},"geometry":{"type":"Point","coordinates":['), F.col("s_suppkey").cast("string"),
        F.lit(","), F.col("s_nationkey").cast("string"), F.lit("]}}]}"),
    )
    features = with_bounds(parse_layers(rows.select(F.col("s_name").alias("layer"), text.alias("text"))))
    return features.groupBy(prop("nation").cast("int").alias("nation")).agg(F.count(F.lit(1)).alias("n"), F.sum("xmin").alias("x"), F.max("ymax").alias("y"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    found = (
        claims_typed, claims_with_iron, layer_selection, layer_counts, unit_lists, units_by_policy, policy_values, holder_values, text_without_accents,
        features_in_view, area_by_holder, area_by_year, area_by_substance, claim_edges, claim_bounds, claim_areas, claim_measures, customers_in_claims,
        points_per_overlap, orders_in_claims, layer_files, layer_file, ingested_view, view_of_points, exported, sql_in_view, sql_areas, sql_holding, repeated_names, faulty_rings, generated_layers,
    )
    return {f"geo_{f.__name__}": f for f in found}


_HITS = (
    ", h AS (SELECT p.c_custkey, e.layer, e.feature_id FROM p JOIN e ON (y1 > y) <> (y2 > y) AND x < (x2 - x1) * (y - y1) / nullif(y2 - y1, 0) + x1 "
    "GROUP BY ALL HAVING count(*) % 2 = 1) "
)
_BOUNDS = "min(x1) AS xmin, min(y1) AS ymin, max(x1) AS xmax, max(y1) AS ymax"
_VIEW = "xmin <= 50 AND xmax >= 10.5 AND ymin <= 4 AND ymax >= 1.5"


def oracle_sql() -> dict[str, str]:
    cross = "(x1 * y2 - x2 * y1)"
    radius = "6378137.0 * 6378137.0 / 2 / 10000"
    square = "[[0,0],[2,0],[2,2],[0,2],[0,0]]::DOUBLE[][]"
    bounded = f"SELECT layer, feature_id, 'Polygon' AS geom_type, any_value(name) AS name, {_BOUNDS} FROM claims JOIN e USING (layer, feature_id) GROUP BY ALL"
    kinds = "['Polygon', 'MultiPolygon', 'Point', 'LineString'][CAST(k % 4 AS INTEGER) + 1]"
    every = f"({bounded} UNION ALL SELECT layer, feature_id, {kinds}, name, xmin, ymin, xmax, ymax FROM units)"
    made = {
        "claims_typed": "SELECT layer, title, name, CAST(area_ha AS DOUBLE) AS area_ha, holder, array_to_string(substances, ',') AS substances, CAST(granted AS VARCHAR) AS granted FROM claims",
        "claims_with_iron": "SELECT title, name, CAST(area_ha AS DOUBLE) AS area_ha, CAST(granted AS VARCHAR) AS granted FROM claims WHERE list_contains(substances, 'Fe') AND area_ha > 905",
        "layer_selection": "SELECT layer, feature_id, name FROM (SELECT layer, feature_id, name FROM claims UNION ALL SELECT layer, feature_id, name FROM units) WHERE layer IN ('units-0', 'units-1', 'claims 2')",
        "layer_counts": "SELECT layer, count(*) AS n, count(*) FILTER (len(substances) > 2) AS with_third FROM claims GROUP BY layer UNION ALL SELECT layer, count(*), 0 FROM units GROUP BY layer",
        "unit_lists": "SELECT name, population, area_total, policy, array_to_string(classes, '|') AS classes, array_to_string(conflicts, '|') AS conflicts FROM units",
        "units_by_policy": "SELECT layer, feature_id FROM units WHERE policy = 'Protección'",
        "policy_values": "SELECT DISTINCT layer, policy AS value FROM units",
        "holder_values": "SELECT DISTINCT layer, holder AS value FROM claims",
        "text_without_accents": "SELECT feature_id, len(classes) AS items FROM units WHERE contains(lower(strip_accents(kinds)), 'bahia')",
        "features_in_view": f"SELECT layer, feature_id, geom_type FROM {every} WHERE {_VIEW}",
        "area_by_holder": "SELECT holder, count(*) AS n, CAST(sum(area_ha) AS DOUBLE) AS area_ha FROM claims GROUP BY holder",
        "area_by_year": "SELECT CAST(year(granted) AS BIGINT) AS year, count(*) AS n, CAST(sum(area_ha) AS DOUBLE) AS area_ha FROM claims GROUP BY ALL",
        "area_by_substance": "SELECT substance, count(*) AS n, CAST(sum(area_ha) AS DOUBLE) AS area_ha FROM (SELECT unnest(substances) AS substance, area_ha FROM claims) GROUP BY substance",
        "claim_edges": "SELECT layer, feature_id, CAST(seq AS BIGINT) AS seq, x1, y1, x2, y2 FROM e",
        "claim_bounds": f"SELECT layer, feature_id, {_BOUNDS} FROM e GROUP BY ALL",
        "claim_areas": f"SELECT layer, feature_id, abs(sum{cross}) / 2 AS area FROM e GROUP BY ALL",
        "claim_measures": f"SELECT layer, feature_id, sum{cross} / 2 AS area, any_value(len(r)) AS vertices, "
        f"CAST(any_value(r[1] <> r[len(r)])::INTEGER + any_value(len(r) < 4)::INTEGER + (sum{cross} < 0)::INTEGER AS BIGINT) AS faults, "
        f"round(abs(sum(radians(x2 - x1) * (2 + sin(radians(y1)) + sin(radians(y2))))) * {radius}, 1) AS hectares, "
        f"round(sum((x1 + x2) * {cross}) / (3 * sum{cross}), 4) AS cx, round(sum((y1 + y2) * {cross}) / (3 * sum{cross}), 4) AS cy FROM e JOIN claims USING (layer, feature_id) GROUP BY ALL",
        "customers_in_claims": "SELECT layer, feature_id, count(*) AS n, CAST(sum(CAST(c_acctbal AS DECIMAL(20,2))) AS DOUBLE) AS balance FROM h JOIN p USING (c_custkey) GROUP BY ALL",
        "points_per_overlap": "SELECT claims, count(*) AS n FROM (SELECT p.c_custkey, count(h.feature_id) AS claims FROM p LEFT JOIN h USING (c_custkey) GROUP BY ALL) GROUP BY claims",
        "orders_in_claims": "SELECT layer, feature_id, count(*) AS orders, count(DISTINCT c_custkey) AS customers FROM h JOIN orders ON o_custkey = c_custkey GROUP BY ALL",
        "layer_files": f"SELECT layer, feature_id, name, xmin, ymin, xmax, ymax FROM {every}",
        "layer_file": "SELECT layer, feature_id, title, holder, CAST(area_ha AS DOUBLE) AS area_ha, CAST(len(r) - 1 AS BIGINT) AS sides FROM claims",
        "ingested_view": f"SELECT layer, feature_id, xmin, ymax FROM {every} WHERE {_VIEW} AND layer IN ('claims 0', 'units-1')",
        "view_of_points": "SELECT CAST(c_custkey AS VARCHAR) AS feature_id, x AS xmin, y AS ymin FROM p WHERE x BETWEEN 20 AND 50 AND y BETWEEN 3 AND 9",
        "exported": f"SELECT layer, feature_id, {kinds} AS geom_type, name, area_total, population, policy, xmin, ymin, xmax, ymax FROM units",
        "sql_in_view": f"SELECT layer, feature_id, geom_type FROM {every} WHERE {_VIEW}",
        "sql_areas": "SELECT holder, count(*) AS n, sum(area) AS area, CAST(max(area_ha) AS DOUBLE) AS largest FROM claims JOIN "
        f"(SELECT layer, feature_id, abs(sum{cross}) / 2 AS area FROM e GROUP BY ALL) USING (layer, feature_id) WHERE x < 60 GROUP BY holder",
        "sql_holding": "SELECT layer, feature_id FROM e WHERE (y1 > 1.25) <> (y2 > 1.25) AND 13.25 < (x2 - x1) * (1.25 - y1) / nullif(y2 - y1, 0) + x1 GROUP BY ALL HAVING count(*) % 2 = 1 "
        "UNION ALL SELECT layer, feature_id FROM units WHERE k % 4 < 2 AND ((13.25 >= x AND 13.25 < x + 1 AND 1.25 >= y AND 1.25 < y + 1) OR (k % 4 = 1 AND 13.25 >= x + 2 AND 13.25 < x + 3 AND 1.25 >= y + 2 AND 1.25 < y + 3))",
        "repeated_names": "SELECT layer, name || ' ' AS feature_id, count(*) AS n FROM claims GROUP BY ALL HAVING count(*) > 1",
    }
    joins = {"customers_in_claims", "points_per_overlap", "orders_in_claims"}
    made = {k: tables.SQL + (_HITS if k in joins else "") + v for k, v in made.items()}
    made |= {
        "faulty_rings": f"WITH a AS (SELECT s_suppkey AS k, CASE WHEN s_suppkey % 5 = 0 THEN [[0,0],[2,0],[0,0]]::DOUBLE[][] ELSE {square} END AS r FROM supplier), "
        "b AS (SELECT k, CASE WHEN k % 3 = 0 THEN r[:len(r) - 1] ELSE r END AS r FROM a), d AS (SELECT k, CASE WHEN k % 2 = 0 THEN list_reverse(r) ELSE r END AS r FROM b), "
        "g AS (SELECT r, list_sum(list_transform(range(1, len(r)), lambda i: r[i][1] * r[i + 1][2] - r[i + 1][1] * r[i][2])) AS twice FROM d) "
        "SELECT array_to_string(list_filter([CASE WHEN r[1] <> r[len(r)] THEN 'open' END, CASE WHEN len(r) < 4 THEN 'short' END, CASE WHEN twice < 0 THEN 'clockwise' END], lambda x: x IS NOT NULL), ',') AS faults, count(*) AS n FROM g GROUP BY ALL",
        "generated_layers": "SELECT s_nationkey AS nation, count(*) AS n, CAST(sum(s_suppkey) AS DOUBLE) AS x, CAST(max(s_nationkey) AS DOUBLE) AS y FROM supplier GROUP BY s_nationkey",
    }
    return {f"geo_{k}": v for k, v in made.items()}
