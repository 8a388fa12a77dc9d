"""Layer selection, attribute filters and category aggregates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.attributes import as_date, as_decimal, listed, numbered, prop

# The attribute keys of the two kinds of layers.
TITLE, NAME, HOLDER, AREA, GRANTED = "TITULO", "NOMBRELOTE", "TITULAR", "SUPERFICIE", "EXPEDICION"
SUBSTANCES = ("SUST1", "SUST2", "SUST3", "SUST4", "SUST5")
UNIT, PLACE, UNIT_AREA, POPULATION = "nombre", "localidad", "superficie_total", "poblacion"
POLICY, CLASSES, CONFLICTS = "politica_ambiental", "clasificacion", "conflictos_potenciales"
LAST_ITEM = "y"


def where(layer: DataFrame, condition: Column | str) -> DataFrame:
    """Features that meet a condition; one that is unknown does not count as met."""
    return layer.where(condition)


def layers(features: DataFrame, *names: str) -> DataFrame:
    """The features of these layers. On ingested layers this prunes folders, or parts of files where layers are many."""
    return features.where(F.col("layer").isin(*names))


def in_view(features: DataFrame, xmin: float, ymin: float, xmax: float, ymax: float) -> DataFrame:
    """Features whose bounds meet a rectangle, edges included; pushed down to ingested layers."""
    return features.where((F.col("xmin") <= xmax) & (F.col("xmax") >= xmin) & (F.col("ymin") <= ymax) & (F.col("ymax") >= ymin))


def concessions(features: DataFrame) -> DataFrame:
    """The typed view of a concession layer; the raw attributes stay in ``props``."""
    return features.select(
        "*",
        prop(TITLE).cast("long").alias("title"),
        F.trim(prop(NAME)).alias("name"),
        F.trim(prop(HOLDER)).alias("holder"),
        as_decimal(prop(AREA)).alias("area_ha"),
        as_date(prop(GRANTED)).alias("granted"),
        numbered(*SUBSTANCES).alias("substances"),
    )


def land_units(features: DataFrame) -> DataFrame:
    """The typed view of a land-unit layer."""
    return features.select(
        "*",
        F.trim(prop(UNIT)).alias("name"),
        F.trim(prop(PLACE)).alias("place"),
        prop(UNIT_AREA).cast("double").alias("area_total"),
        prop(POPULATION).cast("int").alias("population"),
        F.trim(prop(POLICY)).alias("policy"),
        listed(prop(CLASSES), last=LAST_ITEM).alias("classes"),
        listed(prop(CONFLICTS)).alias("conflicts"),
    )


def with_policy(units: DataFrame, policy: str) -> DataFrame:
    return units.where(F.trim(prop(POLICY)) == policy)


def with_substance(claims: DataFrame, substance: str) -> DataFrame:
    return claims.where(F.array_contains("substances", substance))


def by_key(claims: DataFrame, *keys: Column | str) -> DataFrame:
    """Count and area by any keys: holder, year of grant."""
    return claims.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.sum("area_ha").alias("area_ha"))


def by_substance(claims: DataFrame) -> DataFrame:
    """Count and area by substance; a claim counts once for each of its own."""
    return by_key(claims.select("area_ha", F.explode("substances").alias("substance")), "substance")


def categories(features: DataFrame, key: str) -> DataFrame:
    """The distinct values of an attribute, by layer."""
    return features.select("layer", F.trim(prop(key)).alias("value")).where("value is not null").distinct()


def repeats(features: DataFrame) -> DataFrame:
    """``(layer, feature_id, n)`` of names that several features of a layer share, so that their key does not tell them apart."""
    return features.groupBy("layer", "feature_id").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
