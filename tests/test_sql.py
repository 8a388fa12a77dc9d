"""SQL over ingested layers: what is pushed down, and functions against the operators."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from lithospark.functions.sql import query, register
from lithospark.operators.layers import in_view
from lithospark.operators.spatial import edges, planar_areas, points_in_polygons
from lithospark.plans.geo import SQL_AREAS, SQL_HOLDING, SQL_IN_VIEW
from lithospark.sources.geojson import ingest, read_layers

from .claims import claims_json, unit_fragment
from .test_layers import EVERY, MIXED


@pytest.fixture(scope="module")
def layers(spark, tmp_path_factory):
    folder = tmp_path_factory.mktemp("layers")
    for name, text in (("claims", claims_json()), ("mixed", MIXED), ("every", EVERY), ("units", unit_fragment())):
        (folder / f"{name}.geojson").write_text(text, encoding="utf-8")
    found = read_layers(spark, str(folder), repair=True)
    ingest(found, str(folder / "out"))
    return str(folder / "out"), found


@pytest.mark.parametrize("text", [SQL_IN_VIEW, SQL_AREAS, SQL_HOLDING])
def test_filters_reach_the_files(spark, layers, text):
    plan = query(spark, layers[0], text)._jdf.queryExecution().toString()
    pushed = plan[plan.index("PushedFilters: [") :].split("]")[0]
    assert "(xmin" in pushed and "LessThan" in pushed


def test_functions_like_the_operators(spark, layers):
    path, found = layers
    register(spark, path)
    areas = {(r.layer, r.feature_id): r.area for r in planar_areas(edges(found), "layer", "feature_id").collect()}
    got = spark.sql("SELECT layer, feature_id, rings_area(rings_of(geom_type, coords_json)) AS area FROM features").collect()
    assert {(r.layer, r.feature_id): r.area for r in got if r.area is not None} == pytest.approx(areas)
    places = [(i, x / 2, y / 2) for i, (x, y) in enumerate((x, y) for x in range(-1, 26) for y in range(-1, 26))]
    points = spark.createDataFrame(places, "p int, x double, y double")
    points.createOrReplaceTempView("places")
    held = spark.sql("SELECT p, layer, feature_id FROM places JOIN features ON rings_hold(rings_of(geom_type, coords_json), x, y)")
    want = points_in_polygons(points, edges(found)).select("p", "layer", "feature_id")
    assert sorted(held.collect()) == sorted(want.collect()) and held.count() > 100
    seen = spark.sql("SELECT layer, feature_id FROM features WHERE meets_view(xmin, ymin, xmax, ymax, 4.5, 4.5, 7, 9)")
    assert sorted(seen.collect()) == sorted(in_view(found, 4.5, 4.5, 7, 9).select("layer", "feature_id").collect())
    assert {r.name for r in spark.sql("SELECT name FROM claims WHERE layer = 'claims' AND array_contains(substances, 'Fe') AND area_ha > 8").collect()} == {"ALPHA", "GAMMA"}
    assert [r.policy for r in spark.sql("SELECT policy FROM units WHERE layer = 'units'").collect()] == ["Protección"]


@pytest.mark.parametrize("users", [10, 3000, 60_000])
def test_sketches_err_little_and_merge(spark, users):
    rows = spark.range(users * 2).select((F.col("id") % users).alias("u"), (F.col("id") % 7).alias("day"))
    days = rows.groupBy("day").agg(F.hll_sketch_agg("u", 14).alias("s"))
    n = days.agg(F.hll_sketch_estimate(F.hll_union_agg("s")).alias("n")).first().n
    assert abs(n - users) <= 0.03 * users
