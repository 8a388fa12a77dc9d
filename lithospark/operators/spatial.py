"""Edge tables, point in polygon and spatial joins, as plain relations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.geometry import rings
from ..session import checkpointed


def edges(features: DataFrame, *keys: str) -> DataFrame:
    """A row for each side of each ring: the keys, ``ring``, ``seq`` and ``x1, y1, x2, y2``."""
    keys = keys or ("layer", "feature_id")
    ring_rows = features.select(*keys, F.posexplode(rings(F.col("geom_type"), F.col("coords_json"))).alias("ring", "__points"))
    sides = F.expr("transform(slice(__points, 1, greatest(size(__points) - 1, 0)), (p, i) -> struct(p[0] as x1, p[1] as y1, __points[i + 1][0] as x2, __points[i + 1][1] as y2))")
    return ring_rows.select(*keys, "ring", F.posexplode(sides).alias("seq", "s")).select(*keys, "ring", "seq", "s.*")


def crosses(x: Column, y: Column, *side: Column) -> Column:
    """Whether an edge crosses the ray to the right of a point: half-open, so that shared sides belong to one polygon."""
    x1, y1, x2, y2 = side or (F.col(c) for c in ("x1", "y1", "x2", "y2"))
    return ((y1 > y) != (y2 > y)) & (x < (x2 - x1) * (y - y1) / F.nullif(y2 - y1, F.lit(0.0)) + x1)


def bounds(edge_rows: DataFrame, *keys: str) -> DataFrame:
    return edge_rows.groupBy(*keys).agg(F.min("x1").alias("xmin"), F.min("y1").alias("ymin"), F.max("x1").alias("xmax"), F.max("y1").alias("ymax"))


def planar_areas(edge_rows: DataFrame, *keys: str) -> DataFrame:
    """Planar area by the shoelace formula; holes, wound the other way, are taken off."""
    cross = F.col("x1") * F.col("y2") - F.col("x2") * F.col("y1")
    return edge_rows.groupBy(*keys).agg((F.abs(F.sum(cross)) / 2).alias("area"))


#: Sides from which on a cell is split; how often a cell is, at most, so that a polygon has at most ``4 * 4 ** SPLITS`` cells.
MOST_SIDES, SPLITS = 16, 5
#: Cells are squares of two to the power of a level, so that their edges are exact.
LEVELS = (-40, 60)


def _size(level: Column) -> Column:
    return F.pow(F.lit(2.0), level)


def cover(edge_rows: DataFrame, *keys: str) -> DataFrame:
    """``(keys, level, cx, cy, inner, sides)``: each polygon's cells, by a quadtree of its own.

    A polygon begins with the one to four cells that its bounds meet, as large
    as itself. A cell that no side touches is inner, or dropped if it lies
    outside; one with many sides is split in four. Cells that are not inner keep
    the sides that a ray to the right from there can cross.
    """
    keys = keys or ("layer", "feature_id")
    side = F.struct("x1", "y1", "x2", "y2")
    shapes = edge_rows.groupBy(*keys).agg(
        F.collect_list(side).alias("sides"), F.min("x1").alias("xmin"), F.min("y1").alias("ymin"), F.max("x1").alias("xmax"), F.max("y1").alias("ymax")
    )
    extent = F.greatest(F.col("xmax") - F.col("xmin"), F.col("ymax") - F.col("ymin"), F.lit(2.0 ** LEVELS[0]))
    level = F.least(F.greatest(F.ceil(F.log2(extent)), F.lit(LEVELS[0])), F.lit(LEVELS[1])).cast("int")
    span = lambda lo, hi: F.explode(F.sequence(F.floor(F.col(lo) / _size(F.col("level"))), F.floor(F.col(hi) / _size(F.col("level")))))
    cells = shapes.withColumn("level", level).select(*keys, "level", "sides", "ymin", "ymax", span("xmin", "xmax").alias("cx"))
    cells = _judged(cells.select(*keys, "level", "cx", span("ymin", "ymax").alias("cy"), "sides"), keys)
    for _ in range(SPLITS):
        own = F.struct("level", "cx", "cy")
        quarters = F.array(*[F.struct((F.col("level") - 1).alias("level"), (F.col("cx") * 2 + dx).alias("cx"), (F.col("cy") * 2 + dy).alias("cy")) for dx in (0, 1) for dy in (0, 1)])
        split = (F.size("sides") > MOST_SIDES) & (F.col("level") > LEVELS[0])
        cells = _judged(cells.select(*keys, F.explode(F.when(split, quarters).otherwise(F.array(own))).alias("c"), "sides", "inner").select(*keys, "c.*", "sides", "inner"), keys)
    return cells


def _judged(cells: DataFrame, keys: tuple[str, ...]) -> DataFrame:
    """Cells with the sides that matter to them; those outside are dropped."""
    size = _size(F.col("level"))
    x, y = F.col("cx") * size, F.col("cy") * size
    ahead = lambda s: (F.greatest(s["y1"], s["y2"]) >= y) & (F.least(s["y1"], s["y2"]) <= y + size) & (F.greatest(s["x1"], s["x2"]) >= x)
    known = F.col("inner") if "inner" in cells.columns else F.lit(False)
    made = cells.select(*keys, "level", "cx", "cy", known.alias("__known"), F.filter("sides", ahead).alias("__ahead"))
    touched = F.exists("__ahead", lambda s: F.least(s["x1"], s["x2"]) <= x + size)
    crossed = F.size(F.filter("__ahead", lambda s: crosses(x + size / 2, y + size / 2, s["x1"], s["y1"], s["x2"], s["y2"])))
    made = made.withColumns({"__touched": ~F.col("__known") & touched, "inner": F.col("__known") | (~touched & (crossed % 2 == 1))})
    made = made.where(F.col("__touched") | F.col("inner"))
    return made.select(*keys, "level", "cx", "cy", "inner", F.when(F.col("inner"), F.slice("__ahead", 1, 0)).otherwise(F.col("__ahead")).alias("sides"))


def points_in_polygons(points: DataFrame, edge_rows: DataFrame, *keys: str, x: str = "x", y: str = "y") -> DataFrame:
    """``points`` with ``keys``: a row for each point and polygon that holds it, by the even-odd rule.

    Points and polygons meet by equal cells. A polygon has a bounded number of
    them, large ones inside and small ones along its sides (``cover``); a point
    goes to one cell of each size that some polygon uses. In an inner cell a
    point is a hit; in others it is tested against the cell's sides where it
    meets them. So the join is on equal keys, and Spark splits a cell that many
    points share; rows that repeat a point are rows of their own. Both sides are
    shuffled: cells carry their sides, and Spark's guess at the size of a
    checkpoint is far too low for a broadcast to be safe. A point
    without a coordinate, or with one that is not finite, lies in no polygon.
    ``keys`` tell polygons apart: by default the layer and the feature's name.
    """
    keys = keys or ("layer", "feature_id")
    cells = checkpointed(cover(edge_rows, *keys)).withColumnsRenamed({c: f"__{c}" for c in ("level", "cx", "cy", "inner", "sides")})
    # As many sizes as powers of two at most.
    levels = sorted(r[0] for r in cells.select("__level").distinct().collect())
    finite = lambda c: F.abs(F.col(c)) < float("inf")
    placed = points.where(finite(x) & finite(y)).withColumn("__level", F.explode(F.array(*[F.lit(k) for k in levels]).cast("array<int>")))
    cell = lambda c: F.floor(F.col(c) / _size(F.col("__level")))
    placed = placed.withColumns({"__cx": cell(x), "__cy": cell(y)})
    hit = lambda s: crosses(F.col(x), F.col(y), s["x1"], s["y1"], s["x2"], s["y2"])
    pairs = placed.join(cells.hint("merge"), ["__level", "__cx", "__cy"]).where(F.col("__inner") | (F.size(F.filter("__sides", hit)) % 2 == 1))
    return pairs.select(*[placed[c] for c in points.columns], *[cells[k] for k in keys])
