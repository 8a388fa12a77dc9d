"""Windowed aggregates over an event stream, with watermarks for late data."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def event_stream(spark: SparkSession, folder: str, glob: str = "events.parquet") -> DataFrame:
    """The events of a folder as a stream; ``ts`` becomes a timestamp, as watermarks need."""
    path = f"{folder}/{glob}"
    schema = spark.read.parquet(path).schema
    stream = spark.readStream.schema(schema).option("pathGlobFilter", glob).parquet(folder)
    return stream.withColumn("ts", F.col("ts").cast("timestamp"))


def tumbling(events: DataFrame, size: str = "1 day", late: str = "1 day") -> DataFrame:
    """Count and value by window and type; works on streams and on tables."""
    return (
        events.withWatermark("ts", late)
        .groupBy(F.window("ts", size), "event_type")
        .agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("value"))
        .select(F.col("window.start").alias("start"), "event_type", "n", "value")
    )


def sessions(events: DataFrame, gap: str = "30 minutes", late: str = "1 day") -> DataFrame:
    """A row for each run of a user's events with no pause of ``gap``."""
    return (
        events.withWatermark("ts", late)
        .groupBy(F.session_window("ts", gap), "user_id")
        .agg(F.count(F.lit(1)).alias("n"))
        .select("user_id", F.col("session_window.start").alias("start"), F.col("session_window.end").alias("end"), "n")
    )


def to_table(stream: DataFrame, path: str, checkpoint: str, mode: str = "append") -> None:
    """Runs a stream over what is there now and writes Parquet, exactly once."""
    stream.writeStream.outputMode(mode).trigger(availableNow=True).option("checkpointLocation", checkpoint).format("parquet").start(path).awaitTermination()


def to_latest(stream: DataFrame, path: str, checkpoint: str) -> None:
    """Runs an aggregate over what is there now and leaves its whole latest result as Parquet, windows that may still grow included."""
    replace = lambda rows, _: rows.write.mode("overwrite").parquet(path)
    stream.writeStream.outputMode("complete").trigger(availableNow=True).option("checkpointLocation", checkpoint).foreachBatch(replace).start().awaitTermination()
