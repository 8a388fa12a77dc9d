"""Tables replayed as streams, in batches as their rows arrive."""

from __future__ import annotations

from collections.abc import Callable
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.query import StreamingQuery

#: The state store that keyed state with timers needs; any other operator works on it too.
STORE = "spark.sql.streaming.stateStore.providerClass"
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class Arrival(NamedTuple):
    """What a stream did with one batch: rows that came too late, and rows of state that it held afterwards and wrote at most."""

    batch: int
    late: int
    held: int
    most: int


def in_periods(rows: DataFrame, ts: str, periods: int) -> Column:
    """The period of each row: so many equal spans of time, from the first row's to the last one's."""
    us = lambda c: F.unix_micros(c)
    first, last = rows.agg(us(F.min(F.col(ts).cast("timestamp"))), us(F.max(F.col(ts).cast("timestamp")))).first()
    width = ((last or 0) - (first or 0)) // periods + 1
    return F.floor((us(F.col(ts).cast("timestamp")) - F.lit(first or 0)) / width).cast("int")


def replay(rows: DataFrame, batch: str, folder: str, made: Callable[[DataFrame], DataFrame], *, out: str, state: str | None = None) -> list[Arrival]:
    """Runs the stream that ``made`` makes of rows which arrive batch by batch, and appends what it gives to ``out``.

    The rows of each number in ``batch`` are written to ``folder`` in turn, and
    the same stream goes on with what is new there; so watermarks move between
    batches, and a row is late or not by the batch that brings it.
    """
    spark = rows.sparkSession
    numbers = sorted(r[0] for r in rows.select(batch).distinct().collect())
    kept = spark.conf.get(STORE)
    spark.conf.set(STORE, state or kept)
    told = []
    try:
        for number in numbers:
            rows.where(F.col(batch) == number).write.mode("append").parquet(f"{folder}/in")
            query = made(spark.readStream.schema(rows.schema).parquet(f"{folder}/in")).writeStream
            query = query.trigger(availableNow=True).option("checkpointLocation", f"{folder}/state").format("parquet").start(out)
            query.awaitTermination()
            told.append(_told(number, query))
    finally:
        spark.conf.set(STORE, kept)
    return told


def _told(number: int, query: StreamingQuery) -> Arrival:
    steps = [[op.asDict() if hasattr(op, "asDict") else op for op in p["stateOperators"]] for p in query.recentProgress]
    total = lambda ops, name: sum(op[name] for op in ops)
    held = [total(ops, "numRowsTotal") for ops in steps]
    return Arrival(number, sum(total(ops, "numRowsDroppedByWatermark") for ops in steps), held[-1] if held else 0, max(held, default=0))


def arrivals(spark: SparkSession, told: list[Arrival]) -> DataFrame:
    """``(batch, late)`` of a replay."""
    return spark.createDataFrame([(a.batch, a.late) for a in told], "batch int, late long")
