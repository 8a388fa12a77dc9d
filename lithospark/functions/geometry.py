"""Polygon geometry from coordinate text: rings, bounds, areas and checks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

RING = "array<array<double>>"
#: Fixed value: the sphere's radius in metres.
RADIUS = 6378137.0


def polygons(geom_type: Column, coords_json: Column) -> Column:
    """All polygons of a geometry, each an array of rings; null for points, lines and no geometry."""
    one = F.array(F.from_json(coords_json, f"array<{RING}>"))
    many = F.from_json(coords_json, f"array<array<{RING}>>")
    return F.when(geom_type == "Polygon", one).when(geom_type == "MultiPolygon", many)


def rings(geom_type: Column, coords_json: Column) -> Column:
    """All rings of a geometry, outer ones and holes, in order."""
    return F.flatten(polygons(geom_type, coords_json))


def positions(geom_type: Column, coords_json: Column) -> Column:
    """All points of a geometry of any type, in order; of a collection, those of its members."""
    of = lambda depth: F.from_json(coords_json, "array<" * depth + "double" + ">" * depth)
    number = r"(-?[0-9][0-9.eE+-]*)"
    axis = lambda k: F.regexp_extract_all(coords_json, F.lit(rf"\[\s*{number}\s*,\s*{number}"), F.lit(k))
    members = F.zip_with(axis(1), axis(2), lambda x, y: F.array(x.cast("double"), y.cast("double")))
    return (
        F.when(geom_type == "Point", F.array(of(1)))
        .when(geom_type.isin("LineString", "MultiPoint"), of(2))
        .when(geom_type.isin("Polygon", "MultiLineString"), F.flatten(of(3)))
        .when(geom_type == "MultiPolygon", F.flatten(F.flatten(of(4))))
        .when(geom_type == "GeometryCollection", members)
    )


def with_bounds(features: DataFrame) -> DataFrame:
    """Features with ``xmin``, ``ymin``, ``xmax`` and ``ymax`` of all their points; null where they have none."""
    made = features.withColumn("__points", positions(F.col("geom_type"), F.col("coords_json")))
    xs, ys = F.transform("__points", lambda p: p[0]), F.transform("__points", lambda p: p[1])
    return made.select(
        *features.columns,
        F.array_min(xs).alias("xmin"),
        F.array_min(ys).alias("ymin"),
        F.array_max(xs).alias("xmax"),
        F.array_max(ys).alias("ymax"),
    )


def _sides(ring: Column) -> Column:
    """Pairs of neighbouring points of a ring."""
    ends = F.slice(ring, 2, F.greatest(F.size(ring) - 1, F.lit(0)))
    return F.zip_with(F.slice(ring, 1, F.greatest(F.size(ring) - 1, F.lit(0))), ends, lambda a, b: F.struct(a.alias("a"), b.alias("b")))


def signed_area(ring: Column) -> Column:
    """Planar area by the shoelace formula, positive if counter-clockwise."""
    cross = lambda s: s["a"][0] * s["b"][1] - s["b"][0] * s["a"][1]
    return F.aggregate(_sides(ring), F.lit(0.0), lambda acc, s: acc + cross(s)) / 2


def hectares(ring: Column) -> Column:
    """Area on the sphere of a ring in degrees of longitude and latitude."""
    term = lambda s: F.radians(s["b"][0] - s["a"][0]) * (2 + F.sin(F.radians(s["a"][1])) + F.sin(F.radians(s["b"][1])))
    total = F.aggregate(_sides(ring), F.lit(0.0), lambda acc, s: acc + term(s))
    return F.abs(total) * RADIUS * RADIUS / 2 / 10_000


def ring_faults(ring: Column) -> Column:
    """What is wrong with a ring: open, fewer than four points, clockwise. Empty if nothing is."""
    return F.filter(
        F.array(
            F.when(~F.element_at(ring, 1).eqNullSafe(F.element_at(ring, -1)), "open"),
            F.when(F.size(ring) < 4, "short"),
            F.when(signed_area(ring) < 0, "clockwise"),
        ),
        lambda x: x.isNotNull(),
    )


def centroid(ring: Column) -> Column:
    """The centre of a ring's area, ``(x, y)``; null if the area is 0."""
    area = signed_area(ring)
    cross = lambda s: s["a"][0] * s["b"][1] - s["b"][0] * s["a"][1]
    along = lambda i: F.aggregate(_sides(ring), F.lit(0.0), lambda acc, s: acc + (s["a"][i] + s["b"][i]) * cross(s))
    return F.when(area != 0, F.struct((along(0) / (6 * area)).alias("x"), (along(1) / (6 * area)).alias("y")))


def vertex_count(ring: Column) -> Column:
    """Points of a ring, the closing one included."""
    return F.size(ring)
