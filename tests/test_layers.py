"""Layers: reading, typed views, filters and aggregates, on small synthetic files."""

from __future__ import annotations

import datetime
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from lithospark.functions.attributes import has_prop, matches_text, prop
from lithospark.functions.geometry import with_bounds
from lithospark.operators.layers import by_key, by_substance, categories, concessions, in_view, land_units, layers, repeats, with_policy, with_substance
from lithospark.operators.spatial import edges
from lithospark.session import shared_folder
from lithospark.sources.geojson import ingest, open_layers, parse_layers, read_layer, read_layers
from lithospark.sources.geojson import write_texts as write_layer_texts

from .claims import claims_json, unit_fragment, write_texts

MIXED = """{"type": "FeatureCollection", "features": [
 {"type": "Feature", "id": "p", "properties": null, "geometry": {"type": "Point", "coordinates": [1, 2]}},
 {"type": "Feature", "id": "n", "properties": {}, "geometry": null},
 {"type": "Feature", "id": "m", "properties": {"a": {"b": 1}, "c": null},
  "geometry": {"type": "MultiPolygon", "coordinates": [[[[0, 0], [1, 0], [1, 1], [0, 0]]], [[[5, 5], [6, 5], [6, 7], [5, 5]]]]}}]}"""


@pytest.fixture
def folder(tmp_path):
    (tmp_path / "claims fixture.geojson").write_text(claims_json())
    (tmp_path / "crlf.geojson").write_bytes(claims_json().replace(", ", ",\r\n").encode())
    (tmp_path / "fragment.geojson").write_text(unit_fragment(), encoding="utf-8")
    (tmp_path / "mixed.geojson").write_text(MIXED)
    return tmp_path


def read(spark, folder, name, **more):
    return read_layer(spark, str(folder / name), **more)


def test_typed_view_is_exact(spark, folder):
    rows = {r.name: r for r in concessions(read(spark, folder, "claims fixture.geojson")).collect()}
    assert rows["DELTA"].area_ha == Decimal("7.12345678901")
    assert rows["ALPHA"].granted == datetime.date(2004, 3, 5)
    assert rows["DELTA"].substances == ["Fe", "Mn", "Sn", "Ti", "Zn"]
    assert rows["ALPHA"].layer == "claims fixture"
    assert (rows["GAMMA"].xmin, rows["GAMMA"].ymin, rows["GAMMA"].xmax, rows["GAMMA"].ymax) == (0, 4, 6, 8)
    assert sum(r.area_ha for r in rows.values()) == Decimal("167.87345678901")


def test_line_ends_do_not_matter(spark, folder):
    a, b = (concessions(read(spark, folder, n)).select("title", "area_ha", "granted", "substances") for n in ("claims fixture.geojson", "crlf.geojson"))
    assert a.exceptAll(b).isEmpty() and b.exceptAll(a).isEmpty()


def test_fragments_only_on_demand(spark, folder):
    with pytest.raises(Exception, match="not a feature collection"):
        read(spark, folder, "fragment.geojson").collect()
    unit = land_units(read(spark, folder, "fragment.geojson", repair=True)).first()
    assert unit.classes == ["Faro", "Muelle", "Bahía"]
    assert unit.conflicts == ["Ruido y polvo", "Basura"]
    assert unit.policy == "Protección" and unit.props["politica_ambiental"] == "Protección "
    assert unit.feature_id == "a1"


def test_repair_leaves_whole_layers_alone(spark, folder):
    assert read(spark, folder, "claims fixture.geojson", repair=True).count() == 4


def test_other_geometries_keep_their_coordinates(spark, folder):
    rows = {r.feature_id: r for r in read(spark, folder, "mixed.geojson").collect()}
    assert rows["p"].coords_json == "[1,2]" and (rows["p"].xmin, rows["p"].ymax) == (1, 2)
    assert rows["n"].geom_type is None and rows["n"].xmin is None and rows["n"].props == {}
    assert rows["m"].coords_json is not None and (rows["m"].xmax, rows["m"].ymax) == (6, 7)
    assert rows["m"].props == {"a": '{"b":1}', "c": None}


EVERY = """{"type": "FeatureCollection", "features": [
 {"type": "Feature", "id": "l", "geometry": {"type": "LineString", "coordinates": [[0, 5], [3, 1.5e0], [2, -1]]}},
 {"type": "Feature", "id": "mp", "geometry": {"type": "MultiPoint", "coordinates": [[7, 7], [8, 9, 100]]}},
 {"type": "Feature", "id": "ml", "geometry": {"type": "MultiLineString", "coordinates": [[[1, 1], [2, 2]], [[-3, 4], [0, 0]]]}},
 {"type": "Feature", "id": "c", "geometry": {"type": "GeometryCollection", "geometries": [{"type": "Point", "coordinates": [1, 2]}, {"type": "LineString", "coordinates": [[ -5e1 , 6], [3, 4]]}]}},
 {"type": "Feature", "id": "e", "geometry": {"type": "MultiPoint", "coordinates": []}}, {"type": "Feature", "id": "e"}]}"""


def test_every_kind_of_geometry_has_bounds_and_can_be_in_view(spark, folder):
    (folder / "every.geojson").write_text(EVERY)
    found = read(spark, folder, "every.geojson")
    rows = {r.feature_id: (r.xmin, r.ymin, r.xmax, r.ymax) for r in found.collect()}
    assert rows == {"l": (0, -1, 3, 5), "mp": (7, 7, 8, 9), "ml": (-3, 0, 2, 4), "c": (-50, 2, 3, 6), "e": (None,) * 4}
    assert sorted(r.feature_id for r in in_view(found, -10, 4.5, -4, 5).collect()) == ["c"]
    assert sorted(r.feature_id for r in in_view(found, 0, 0, 1, 1).collect()) == ["l", "ml"]
    assert [tuple(r) for r in repeats(found).collect()] == [("every", "e", 2)]


def test_folder_and_ingest(spark, folder, tmp_path):
    found = read_layers(spark, str(folder), repair=True)
    assert {r.layer: r["count"] for r in found.groupBy("layer").count().collect()} == {"claims fixture": 4, "crlf": 4, "fragment": 1, "mixed": 3}
    ingest(found, str(tmp_path / "out"))
    back = open_layers(spark, str(tmp_path / "out"))
    assert layers(back, "mixed", "fragment").count() == 4
    seen = in_view(back, 4.5, 4.5, 7, 9)
    assert "PushedFilters: [IsNotNull(xmin)" in seen._jdf.queryExecution().toString()
    assert {r.layer for r in seen.select("layer").distinct().collect()} == {"claims fixture", "crlf", "mixed"}


def test_features_without_an_id_have_their_own_key(spark, folder):
    claims = read(spark, folder, "claims fixture.geojson")
    assert sorted(r.feature_id for r in claims.collect()) == ["1", "2", "3", "4"]
    assert edges(claims).groupBy("feature_id").count().count() == 4
    assert sorted(r.feature_id for r in read(spark, folder, "claims fixture.geojson", keys=["NOMBRELOTE"]).collect()) == ["ALPHA", "BETA", "DELTA", "GAMMA"]
    assert sorted(r.feature_id for r in read(spark, folder, "claims fixture.geojson", keys=[]).collect()) == ["#0", "#1", "#2", "#3"]


@pytest.mark.parametrize("more", [claims_json(), " {}", ", {}", " x"])
def test_text_after_the_collection_is_an_error(spark, folder, more):
    (folder / "two.geojson").write_text(claims_json() + more)
    with pytest.raises(Exception, match="not one feature collection: two"):
        read(spark, folder, "two.geojson").collect()
    (folder / "two.geojson").write_text(claims_json() + "\n \n")
    assert read(spark, folder, "two.geojson").count() == 4


def test_layer_names_stay_text(spark, folder, tmp_path):
    for name in ("007", "a+b", "c%20d", "e.f"):
        (folder / f"{name}.geojson").write_text(claims_json())
    write_texts(spark, str(folder / "written"))
    found = read_layers(spark, str(folder), repair=True)
    names = {"007", "a+b", "c%20d", "e.f", "claims fixture", "crlf", "fragment", "mixed"}
    assert {r.layer for r in found.select("layer").distinct().collect()} == names
    ingest(found, str(tmp_path / "out"))
    back = open_layers(spark, str(tmp_path / "out"))
    assert back.columns == found.columns and {r.layer for r in back.select("layer").distinct().collect()} == names
    assert {r.layer for r in read_layers(spark, str(folder / "written"), repair=True).collect()} == {"claims", "units"}


def test_a_cluster_needs_a_shared_folder():
    class Context:
        master = "spark://host:7077"
        getCheckpointDir = staticmethod(lambda: None)

    class Session:
        sparkContext = Context
        conf = {}

    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        shared_folder(Session)


def test_filters_and_aggregates(spark, folder):
    raw = read(spark, folder, "claims fixture.geojson")
    claims = concessions(raw)
    assert {r.name for r in with_substance(claims, "Fe").collect()} == {"ALPHA", "GAMMA", "DELTA"}
    assert raw.where(has_prop("SUST3")).count() == 2
    assert {r.substance: (r.n, r.area_ha) for r in by_substance(claims).collect()}["Zn"] == (2, Decimal("57.37345678901"))
    assert {r.holder: r.n for r in by_key(claims, "holder").collect()} == {"HOLDER ONE": 2, "HOLDER TWO": 1, "HOLDER THREE": 1}
    assert {r.y: r.n for r in by_key(claims, F.year("granted").alias("y")).collect()} == {2004: 2, 2006: 1, 2009: 1}
    unit = read(spark, folder, "fragment.geojson", repair=True)
    assert with_policy(unit, "Protección").count() == 1
    assert [r.value for r in categories(unit, "politica_ambiental").collect()] == ["Protección"]
    assert unit.where(matches_text(prop("clasificacion"), "bahia")).count() == 1


def test_many_layers_are_few_files(spark, tmp_path):
    """Files are as many as tasks write, not as there are layers, and a filter on layers reaches them."""
    one = "array(struct('k' AS layer, 'f' AS feature_id, map('a', 'b') AS props, 'Point' AS geom_type, '[1,2]' AS coords_json, 1D AS xmin, 2D AS ymin, 1D AS xmax, 2D AS ymax))"
    rows = spark.range(300).selectExpr("id", f"inline({one})").withColumn("layer", F.concat(F.lit("layer "), F.col("id").cast("string"))).drop("id")
    ingest(rows, str(tmp_path / "out"), parts=3)
    assert len(list((tmp_path / "out").rglob("*.parquet"))) <= 3
    back = layers(open_layers(spark, str(tmp_path / "out")), "layer 7", "layer 70")
    assert sorted(r.layer for r in back.collect()) == ["layer 7", "layer 70"]
    assert "In(layer" in back._jdf.queryExecution().toString()


def test_many_layers_share_files(spark, tmp_path):
    fragment = '\n"features": [{"type":"Feature","id":"u","properties":{},"geometry":{"type":"Point","coordinates":[1,2]}}],\n'
    texts = spark.createDataFrame([(f"{'a' if k % 2 else 'b'} %={k}", claims_json() if k % 2 else fragment) for k in range(120)], "layer string, text string")
    few = texts.limit(30)
    for name, rows in (("few", few), ("many", texts)):
        write_layer_texts(rows, str(tmp_path / name))
        want = sorted(map(repr, with_bounds(parse_layers(rows, repair=True)).collect()))
        assert want and sorted(map(repr, read_layers(spark, str(tmp_path / name), repair=True).collect())) == want
        named = sorted(map(repr, with_bounds(parse_layers(rows.where("layer LIKE 'a%'"))).collect()))
        assert sorted(map(repr, read_layers(spark, str(tmp_path / name), prefix="a").collect())) == named
    assert len(list((tmp_path / "few").iterdir())) > 20 and len(list((tmp_path / "many").rglob("part-*"))) < 20
    (tmp_path / "many" / "more.geojson").write_text(claims_json())
    assert read_layers(spark, str(tmp_path / "many"), repair=True).where("layer = 'more' OR layer = 'a %=1'").count() == 8
    with pytest.raises(Exception, match="PATH_NOT_FOUND"):
        read_layers(spark, str(tmp_path / "none"))
