"""Small tables with the cases that every operator must stand."""

from __future__ import annotations

import random

import pytest

COLUMNS = "doc_id long, text string, lang string, source string, n_chars long"
#: Extra columns whose names operators use for their own.
CLASHES = "shard string, slot string, size string, target string, taken string, id string, h string, key string, block string, place string, removed string, kept string, quality string, score string, lang_pred string, host string, rule string, gram string, component string"
WORDS = {"en": "the house and river with a green stone under morning", "fr": "une maison avec des rivières et la pierre verte sous matin"}


def prose(lang: str, n: int, seed: int) -> str:
    pick = random.Random(seed)
    words = WORDS[lang].split()
    return " ".join(pick.choice(words) + pick.choice(["", "s", "er", "ing"]) for _ in range(n)) + "."


@pytest.fixture(scope="session")
def rows():
    made = []
    for i in range(60):
        lang = "en" if i % 2 else "fr"
        made.append((i, prose(lang, 30 + 7 * i % 90, i), lang, f"s{i % 4}" if i % 7 else None, 10))
    made.append((60, None, "en", "s1", None))
    made.append((61, "", "fr", None, 0))
    made.append((62, " \n\t ", None, "s2", 4))
    made.append((None, "no id here, only words and nothing more.", "en", "s0", 40))
    made.append((63, made[5][1], "en", "s3", 10))
    made += [(64, "twice the same row.", "en", "s1", 19)] * 2
    made.append((65, "word " * 30_000, "en", "s1", 150_000))
    made.append((66, "é😀 \x00 日本 !!! 12", "fr", "s9", 15))
    return made


@pytest.fixture(scope="session")
def docs(spark, rows):
    """All cases, with clashing extra columns."""
    from pyspark.sql import functions as F

    made = spark.createDataFrame(rows, COLUMNS).repartition(3)
    return made.select("*", *[F.lit("extra").alias(c.split()[0]) for c in CLASHES.split(", ")]).cache()


@pytest.fixture(scope="session")
def none(docs):
    return docs.where("false")


@pytest.fixture
def folder(spark, rows, tmp_path):
    """The cases as a table on disk, without extra columns."""
    spark.createDataFrame(rows, COLUMNS).write.parquet(str(tmp_path / "documents.parquet"))
    return str(tmp_path)
