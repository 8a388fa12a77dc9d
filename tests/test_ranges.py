"""Layers written as GeoJSON, and files read in byte ranges, against reading them whole."""

from __future__ import annotations

import json

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from lithospark.plans.tables import claims_layer, units_layer
from lithospark.sources import ranges
from lithospark.sources.geojson import read_layer, read_layers, write_layers
from lithospark.sources.ranges import part_of, scan_layer

from .claims import claims_json, unit_fragment

NASTY = {
    "type": "FeatureCollection", "crs": {"type": "name", "properties": {"name": "x"}}, "bbox": [0, 1, 2, 3],
    "other": [{"type": "Thing", "a": [{"b": {}}]}, {"type": "Thing"}],
    "features": [
        {"type": "Feature", "id": 'quote " and \\ and \\" and {[', "properties": {"a": "}]}", "b": {"type": "Feature", "c": ["\\"]}, "d": "\u00e9\U0001f600"}, "geometry": {"type": "Point", "coordinates": [1, 2]}},
        {"type": "Feature", "properties": {"TITULO": 7, "long": "x{" * 300}, "geometry": None},
        {"type": "Feature", "properties": None, "geometry": {"type": "LineString", "coordinates": [[k, k] for k in range(90)]}},
        {"type": "Feature", "id": "\\\\\\", "properties": {}, "geometry": {"type": "GeometryCollection", "geometries": [{"type": "Point", "coordinates": [3, 4]}]}},
    ],
}


def same(a, b):
    return sorted(map(repr, a.collect())) == sorted(map(repr, b.collect()))


@pytest.mark.parametrize("step", [7, 64, 1000, 1 << 20])
@pytest.mark.parametrize("indent", [None, 1])
def test_ranges_like_the_whole_file(spark, tmp_path, step, indent):
    text = json.dumps(NASTY, indent=indent, ensure_ascii=bool(indent))
    (tmp_path / "a b%20+c.geojson").write_text(text, encoding="utf-8")
    path = str(tmp_path / "a b%20+c.geojson")
    named = lambda df: df.withColumn("feature_id", F.regexp_replace("feature_id", "^[@#][0-9]+$", "?"))
    assert same(named(scan_layer(spark, path, range_bytes=step)), named(read_layer(spark, path)))


@pytest.mark.parametrize("step", [11, 4096])
def test_fragments_and_faults(spark, tmp_path, step):
    (tmp_path / "f.geojson").write_text(unit_fragment(), encoding="utf-8")
    (tmp_path / "c.geojson").write_text(claims_json())
    (tmp_path / "empty.geojson").write_text("")
    assert same(scan_layer(spark, str(tmp_path / "[fc].geojson"), repair=True, range_bytes=step), read_layer(spark, str(tmp_path / "[fc].geojson"), repair=True))
    with pytest.raises(Exception, match="not a feature collection: f"):
        scan_layer(spark, str(tmp_path / "f.geojson"), range_bytes=step).collect()
    for k, fault in enumerate([claims_json()[:-1], claims_json() + claims_json(), claims_json()[:-3] + '"']):
        (tmp_path / f"bad{k}.geojson").write_text(fault)
        with pytest.raises(Exception, match="not one feature collection"):
            scan_layer(spark, str(tmp_path / f"bad{k}.geojson"), range_bytes=step).collect()
    assert scan_layer(spark, str(tmp_path / "empty.geojson")).count() == 0


def test_a_file_is_read_by_many_tasks(spark, tmp_path):
    feature = {"type": "Feature", "properties": {"k": "v"}, "geometry": {"type": "Point", "coordinates": [1, 2]}}
    text = json.dumps({"type": "FeatureCollection", "features": [feature | {"id": str(k)} for k in range(3000)]})
    (tmp_path / "many.geojson").write_text(text)
    found = scan_layer(spark, str(tmp_path / "many.geojson"), range_bytes=len(text) // 8)
    assert found.select(F.spark_partition_id().alias("t")).distinct().count() > 2
    assert sorted(int(r.feature_id) for r in found.collect()) == list(range(3000))


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet='"\\\\{}[]a', max_size=60), st.integers(0, 60))
def test_structure_of_parts_adds_up(text, cut):
    """Quotes and brackets of a text cut in two are those of the whole."""
    data = np.frombuffer(text.encode(), dtype=np.uint8)
    cut = min(cut, len(data))
    head = text.encode()[:cut]
    a, b, whole = part_of(data[:cut]), part_of(data[cut:], len(head) - len(head.rstrip(b"\\"))), part_of(data)
    assert a.total + b.total == whole.total
    assert [*a.places.tolist(), *(b.places + cut).tolist()] == whole.places.tolist()
    assert [*a.quotes.tolist(), *(b.quotes + a.total).tolist()] == whole.quotes.tolist()


def test_layers_written_come_back(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "x y%=\u00e9.geojson").write_text(json.dumps(NASTY))
    (tmp_path / "in" / "007.geojson").write_text(claims_json())
    whole = read_layers(spark, str(tmp_path / "in"))
    tables = claims_layer(spark, "/root/testdata/sf0.001").unionByName(units_layer(spark, "/root/testdata/sf0.001"))
    for k, layers in enumerate((whole, tables)):
        write_layers(layers, str(tmp_path / f"out{k}"))
        assert same(read_layers(spark, str(tmp_path / f"out{k}")), layers)
        assert same(scan_layer(spark, str(tmp_path / f"out{k}" / "*.geojson"), range_bytes=300), layers)
    files = list((tmp_path / "out1").rglob("part-*"))
    assert len(files) >= 5
    for file in files:
        read = json.loads(file.read_text(encoding="utf-8"))
        assert read["type"] == "FeatureCollection" and len(file.read_text(encoding="utf-8").splitlines()) == len(read["features"]) + 2
    write_layers(whole.where("false"), str(tmp_path / "none"))


def test_many_layers_share_files(spark, tmp_path):
    names = F.concat(F.lit('a"\\/\u00e9 %='), F.col("id").cast("string"))
    (tmp_path / "nasty.geojson").write_text(json.dumps(NASTY))
    nasty = read_layer(spark, str(tmp_path / "nasty.geojson")).drop("layer")
    many = spark.range(130).select(names.alias("layer")).crossJoin(nasty)
    write_layers(many, str(tmp_path / "out"))
    files = list((tmp_path / "out").rglob("part-*"))
    assert len(files) < 20 and all(json.loads(f.read_text(encoding="utf-8"))["type"] == "FeatureCollection" for f in files)
    assert same(read_layers(spark, str(tmp_path / "out")), many)
    for step in (300, 1 << 20):
        assert same(scan_layer(spark, str(tmp_path / "out" / "*.geojson"), range_bytes=step), many)


def test_small_ranges_share_tasks_and_read_on_little(spark, tmp_path, monkeypatch):
    feature = {"type": "Feature", "properties": {"k": "v" * 90}, "geometry": {"type": "Point", "coordinates": [1, 2]}}
    (tmp_path / "many.geojson").write_text(json.dumps({"type": "FeatureCollection", "features": [feature | {"id": str(k)} for k in range(6000)]}))
    found = scan_layer(spark, str(tmp_path / "many.geojson"), range_bytes=300)
    assert found.rdd.getNumPartitions() <= 64
    assert sorted(int(r.feature_id) for r in found.collect()) == list(range(6000))
    read = []
    monkeypatch.setattr(ranges, "_read", lambda file, start, end, real=ranges._read: read.append(end - start) or real(file, start, end))
    with open(tmp_path / "many.geojson", "rb") as file:
        size = (tmp_path / "many.geojson").stat().st_size
        assert len(list(ranges._features(file, "many", 0, 300, size, 0, 0))) == 2
    assert sum(read) < 10_000
