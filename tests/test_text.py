"""Substring search against a plain one, and layers in order of a curve."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from lithospark.operators import text
from lithospark.operators.layers import in_view
from lithospark.operators.text import _bits, block_postings, folded, search, search_all, trigrams, write_index
from lithospark.sources.geojson import ingest, open_layers, on_curve

TEXTS = [None, "", "ab", "abc", "ABCabc", "x\ny z", "Bah\u00eda de Cádiz", "bahia", "a" * 5000, "\U0001f600\U0001f601\U0001f602 end", "the end", "Ünder the BRIDGE"]


@pytest.fixture(scope="module")
def indexed(spark, tmp_path_factory):
    pick = random.Random(5)
    texts = TEXTS + ["".join(pick.choice("abcé ") for _ in range(pick.randrange(40))) for _ in range(300)] + ["abc"]
    docs = spark.createDataFrame([(k % 305, t) for k, t in enumerate(texts)], "k long, t string").repartition(3).cache()
    path = str(tmp_path_factory.mktemp("index") / "out")
    write_index(docs, path, id_col="k", text_col="t")
    return docs, path


@pytest.mark.parametrize("pattern", ["abc", "BAHIA", "bahía", "a", "", "e ", "cab", "abcabc", "zzz", "\U0001f601\U0001f602", "\ny z", "aaaa", "nder the b", "%", "a.c"])
def test_search_like_a_plain_one(spark, indexed, pattern):
    import unicodedata

    docs, path = indexed
    fold = lambda s: "".join(c for c in unicodedata.normalize("NFD", s.lower()) if not unicodedata.combining(c))
    want = sorted((r.k, r.t) for r in docs.collect() if r.t is not None and fold(pattern) in fold(r.t))
    assert sorted((r.k, r.t) for r in search(spark, path, docs, pattern, id_col="k", text_col="t").collect()) == want


def test_several_patterns_like_each_alone(spark, indexed):
    docs, path = indexed
    patterns = ["abc", "a", "zzz", "BAHIA", "abc", "the"]
    got = sorted((r.pattern, r.k, r.t) for r in search_all(spark, path, docs, patterns, id_col="k", text_col="t").collect())
    assert got == sorted((p, r.k, r.t) for p in set(patterns) for r in search(spark, path, docs, p, id_col="k", text_col="t").collect())
    assert search_all(spark, path, docs, ["zzz"], id_col="k", text_col="t").columns == ["pattern", "k", "t"]


def test_a_block_has_one_row_a_trigram(spark, indexed, monkeypatch):
    docs, path = indexed
    rows = spark.read.parquet(f"{path}/postings")
    assert rows.count() == rows.select("gram", "block").distinct().count() < docs.select(F.explode(trigrams(folded(F.col("t"))))).count() / 3
    texts = ["abc", "", "xabc\U0001f600", "ab"] * 30 + ["rare"]
    grams, many, packed = block_postings(texts)
    for gram, n, p in zip(grams, many, packed, strict=True):
        has = [gram in t for t in texts]
        assert _bits(p, n, len(texts)).tolist() == has and sum(has) == n
    assert set(grams) == {t[k : k + 3] for t in texts for k in range(len(t) - 2)} and block_postings([""]) == ([], [], [])
    monkeypatch.setattr(text, "DENSE_LETTERS", 3)
    assert block_postings(texts) == (grams, many, packed)


def test_only_the_patterns_postings_are_read(spark, indexed):
    docs, path = indexed
    plan = search(spark, path, docs, "abca", id_col="k", text_col="t")._jdf.queryExecution().toString()
    assert "PushedFilters: [In(gram" in plan


def test_trigrams_of_long_texts_take_one_pass(spark):
    n = spark.range(1).select(F.size(trigrams(F.concat_ws(" ", F.sequence(F.lit(1), F.lit(200_000)).cast("array<string>")))).alias("n")).first().n
    assert 1000 < n < 2000


def test_a_view_meets_few_files_of_a_layer_on_a_curve(spark, tmp_path):
    rows = spark.range(20_000).select((F.col("id") * 37 % 1201 / 10).alias("x"), (F.col("id") * 53 % 997 / 10).alias("y"), "id")
    points = rows.select(
        F.lit("l").alias("layer"), F.col("id").cast("string").alias("feature_id"), F.create_map().cast("map<string,string>").alias("props"), F.lit("Point").alias("geom_type"),
        F.lit("[]").alias("coords_json"), F.col("x").alias("xmin"), F.col("y").alias("ymin"), F.col("x").alias("xmax"), F.col("y").alias("ymax"),
    )
    ingest(points, str(tmp_path / "z"), parts=64)
    back = open_layers(spark, str(tmp_path / "z"))
    files = back.groupBy(F.input_file_name().alias("f")).agg(F.min("xmin").alias("xmin"), F.min("ymin").alias("ymin"), F.max("xmax").alias("xmax"), F.max("ymax").alias("ymax"))
    # A tenth of the height and a fifth of the width: by strips along one axis a fifth of the files at least.
    met, total = in_view(files, 30.0, 40.0, 54.0, 50.0).count(), files.count()
    assert total >= 60 and met < total / 4
    adaptive = spark.conf.get("spark.sql.adaptive.enabled")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        seen = in_view(back, 30.0, 40.0, 54.0, 50.0)
        found = len(seen.collect())
        scan = seen._jdf.queryExecution().executedPlan().collectLeaves().head()
        assert found == in_view(points, 30.0, 40.0, 54.0, 50.0).count() and scan.metrics().apply("numOutputRows").value() < 20_000 / 4
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", adaptive)
    ingest(points.where("false"), str(tmp_path / "none"))


def test_places_on_the_curve(spark):
    rows = spark.createDataFrame([(0.0, 0.0), (1.0, 0.0), (0.0, 1.0), (1.0, 1.0), (None, None)], "xmin double, ymin double").selectExpr("*", "xmin as xmax", "ymin as ymax")
    places = {(r.xmin, r.ymin): r.p for r in rows.withColumn("p", on_curve(rows)).collect()}
    assert places == {(0.0, 0.0): 0, (1.0, 0.0): 0x55555555, (0.0, 1.0): 0xAAAAAAAA, (1.0, 1.0): 0xFFFFFFFF, (None, None): None}
