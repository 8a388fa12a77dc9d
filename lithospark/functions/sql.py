"""Layers in SQL: views of ingested layers, and functions for geometry in the text of a query."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..operators.layers import concessions, land_units
from ..sources.geojson import open_layers

_RINGS = (
    "flatten(CASE geom_type WHEN 'Polygon' THEN array(from_json(coords, 'array<array<array<double>>>')) "
    "WHEN 'MultiPolygon' THEN from_json(coords, 'array<array<array<array<double>>>>') END)"
)
#: Each ring's sides from point a to point b, added up by a term.
_OVER_SIDES = (
    "aggregate(rings, 0D, (total, r) -> total + aggregate(zip_with(slice(r, 1, greatest(size(r) - 1, 0)), slice(r, 2, greatest(size(r) - 1, 0)), "
    "(a, b) -> {}), 0D, (s, x) -> s + x))"
)
#: What a query can call. Spark puts their bodies in place of the calls, so filters in them reach the files.
FUNCTIONS = {
    "rings_of(geom_type STRING, coords STRING) RETURNS ARRAY<ARRAY<ARRAY<DOUBLE>>>": _RINGS,
    "rings_area(rings ARRAY<ARRAY<ARRAY<DOUBLE>>>) RETURNS DOUBLE": "abs(" + _OVER_SIDES.format("a[0] * b[1] - b[0] * a[1]") + ") / 2",
    "rings_hold(rings ARRAY<ARRAY<ARRAY<DOUBLE>>>, x DOUBLE, y DOUBLE) RETURNS BOOLEAN": _OVER_SIDES.format(
        "CAST((a[1] > y) <> (b[1] > y) AND x < (b[0] - a[0]) * (y - a[1]) / nullif(b[1] - a[1], 0D) + a[0] AS DOUBLE)"
    )
    + " % 2 = 1",
    "meets_view(xmin DOUBLE, ymin DOUBLE, xmax DOUBLE, ymax DOUBLE, west DOUBLE, south DOUBLE, east DOUBLE, north DOUBLE) RETURNS BOOLEAN": (
        "xmin <= east AND xmax >= west AND ymin <= north AND ymax >= south"
    ),
}


def register(spark: SparkSession, path: str) -> None:
    """Makes the layers ingested at ``path`` the views ``features``, ``claims`` and ``units``, and the functions known to SQL.

    ``features`` holds every layer; the other two are its typed views, with the
    columns of ``concessions`` and ``land_units``; which layers are which is for
    the query to say.
    """
    for signature, body in FUNCTIONS.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {signature} RETURN {body}")
    features = open_layers(spark, path)
    features.createOrReplaceTempView("features")
    concessions(features).createOrReplaceTempView("claims")
    land_units(features).createOrReplaceTempView("units")


def query(spark: SparkSession, path: str, text: str) -> DataFrame:
    """What a query in SQL says of the layers ingested at ``path``."""
    register(spark, path)
    return spark.sql(text)
