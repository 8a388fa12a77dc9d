"""Typed values from text attributes."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def prop(key: str) -> Column:
    """An attribute as it stands, or null where a feature leaves it out."""
    return F.col("props")[key]


def has_prop(key: str) -> Column:
    """Whether a feature has the key at all, be its value null."""
    return F.map_contains_key("props", key)


def as_decimal(text: Column) -> Column:
    """A decimal number with up to 11 fraction digits, exactly."""
    return text.cast("decimal(20,11)")


def as_date(text: Column) -> Column:
    """A date written yyyy/MM/dd."""
    return F.to_date(text, "yyyy/MM/dd")


def numbered(*keys: str) -> Column:
    """Numbered attributes as one array, without those left out."""
    return F.filter(F.array(*[prop(k) for k in keys]), lambda x: x.isNotNull())


def listed(text: Column, *, last: str | None = None) -> Column:
    """A comma-separated list as an array of trimmed items; ``last`` also separates, as a word before the last item."""
    pattern = r"\s*,\s*" + (rf"|\s+{last}\s+" if last else "")
    return F.filter(F.transform(F.split(F.trim(text), pattern), F.trim), lambda x: x != "")


def matches_text(text: Column, wanted: str) -> Column:
    """Whether a text holds another, whatever the case and accents."""
    return F.contains(F.collate(text, "UNICODE_CI_AI"), F.collate(F.lit(wanted), "UNICODE_CI_AI"))
