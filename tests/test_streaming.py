"""Streams give what the same aggregate gives on the table."""

from __future__ import annotations

import os

import pytest
from pyspark.sql import functions as F

from lithospark.streaming.events import event_stream, sessions, to_table, tumbling

FOLDER = "/root/testdata/sf0.001"


@pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no test tables")
@pytest.mark.parametrize("made", [tumbling, sessions])
def test_stream_equals_table(spark, tmp_path, made):
    to_table(made(event_stream(spark, FOLDER)), str(tmp_path / "out"), str(tmp_path / "state"))
    table = spark.read.parquet(f"{FOLDER}/events.parquet").withColumn("ts", F.col("ts").cast("timestamp"))
    streamed = spark.read.parquet(str(tmp_path / "out"))
    whole = made(table)
    # A watermark holds back only windows that could still grow.
    end = table.agg(F.max("ts") - F.expr("interval 2 day")).first()[0]
    closed = lambda df: df.where(F.col("start") < F.lit(end)).drop("value")
    assert closed(streamed).exceptAll(closed(whole)).isEmpty()
    assert closed(whole).exceptAll(closed(streamed)).isEmpty()
