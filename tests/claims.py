"""Two small synthetic layers, as GeoJSON text: claims, and a land unit stored as a fragment."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession

from lithospark.functions.geometry import with_bounds
from lithospark.operators.layers import AREA, CLASSES, CONFLICTS, GRANTED, HOLDER, NAME, PLACE, POLICY, POPULATION, SUBSTANCES, TITLE, UNIT, UNIT_AREA
from lithospark.sources.geojson import parse_layers

#: Number, name, area, holder, substances, grant, ring.
CLAIMS = (
    (1, "ALPHA", "100.50000000000", "HOLDER ONE", ("Fe", "Mn"), "2004/03/05", ((0, 0), (4, 0), (4, 4), (0, 4), (0, 0))),
    (2, "BETA", "50.25000000000", "HOLDER ONE", ("Ni", "Zn"), "2004/11/17", ((4, 0), (8, 0), (8, 4), (4, 4), (4, 0))),
    (3, "GAMMA", "10.00000000000", "HOLDER TWO", ("Fe", "Mn", "Ti"), "2006/07/21", ((0, 4), (6, 4), (6, 6), (2, 6), (2, 8), (0, 8), (0, 4))),
    (4, "DELTA", "7.12345678901", "HOLDER THREE", ("Fe", "Mn", "Sn", "Ti", "Zn"), "2009/01/30", ((3, 3), (5, 3), (5, 5), (3, 5), (3, 3))),
)


def unit_fragment() -> str:
    """A land unit's layer without its outer braces and with a comma too many."""
    properties = {
        UNIT: "UNIT-1", PLACE: "Norte", UNIT_AREA: 12.5, POPULATION: 1, CLASSES: "Faro, Muelle y Bahía", POLICY: "Protección ",
        CONFLICTS: "Ruido y polvo, Basura ",
    }
    ring = [[10, 10], [12, 10], [12, 12], [10, 12], [10, 10]]
    feature = {"type": "Feature", "properties": properties, "geometry": {"coordinates": [ring], "type": "Polygon"}, "id": "a1"}
    return f'\n"features": [\n  {json.dumps(feature, ensure_ascii=False)}\n],\n'


def claims_json() -> str:
    """The claims layer; unused substance keys are left out."""
    features = []
    for number, name, area, holder, substances, granted, ring in CLAIMS:
        properties = {TITLE: number, NAME: name, AREA: area, HOLDER: holder, GRANTED: granted} | dict(zip(SUBSTANCES, substances))
        features.append({"type": "Feature", "geometry": {"type": "Polygon", "coordinates": [ring]}, "properties": properties})
    return json.dumps({"type": "FeatureCollection", "features": features})


def claims_layer(spark: SparkSession) -> DataFrame:
    return with_bounds(parse_layers(spark.createDataFrame([("claims", claims_json())], "layer string, text string")))


def write_texts(spark: SparkSession, folder: str) -> None:
    """Both layers as files of a folder, one each."""
    for layer, text in (("claims", claims_json()), ("units", unit_fragment())):
        spark.createDataFrame([(text,)], "value string").coalesce(1).write.text(f"{folder}/{layer}.geojson")
