"""Streams over the driver's events: an extension, not part of the layers.

The events arrive in five batches by their time, some of them one or two batches
later. A row is late if its time is not after the watermark that the batches
before have set; the SQL says the same of the table.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import temporary_folder
from ..streaming.replay import ROCKS, arrivals, in_periods, replay
from ..streaming.state import deduplicated, interval_join, outcomes

PERIODS = 5
#: How far watermarks stay behind, and the time from a view to a purchase.
DAY_MS = 24 * 3600 * 1000
WITHIN_MS = 6 * 3600 * 1000


def _events(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir}/events.parquet")
    rows = rows.withColumn("ts", F.col("ts").cast("timestamp"))
    return rows.withColumn("period", in_periods(rows, "ts", PERIODS))


def _delayed(rows: DataFrame) -> DataFrame:
    """Every eleventh event comes a batch later, every thirty-seventh two."""
    k = F.col("event_id")
    delay = F.when(k % 11 == 3, 1).when(k % 37 == 5, 2).otherwise(0)
    return rows.withColumn("batch", F.least(F.col("period") + delay, F.lit(PERIODS - 1)))


def _sent(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as they arrive, every fifth one once more in the next batch."""
    rows = _delayed(_events(spark, sf_dir))
    again = rows.where(F.col("event_id") % 5 == 0).withColumn("batch", F.least(F.col("batch") + 1, F.lit(PERIODS - 1)))
    return rows.unionByName(again).select("event_id", "ts", "batch")


def stream_deduplicated(spark: SparkSession, sf_dir: str) -> DataFrame:
    """By arrival batch: rows that came, came too late, and were the first of their event."""
    folder = temporary_folder(spark, "stream")
    rows = _sent(spark, sf_dir)
    told = replay(rows, "batch", folder, lambda s: deduplicated(s, "event_id"), out=f"{folder}/out")
    came = rows.groupBy("batch").agg(F.count(F.lit(1)).alias("came"))
    kept = spark.read.parquet(f"{folder}/out").groupBy("batch").agg(F.count(F.lit(1)).alias("kept"), F.sum("event_id").alias("ids"))
    found = came.join(arrivals(spark, told), "batch").join(kept, "batch", "left")
    return found.select("batch", "came", "late", F.coalesce("kept", F.lit(0)).alias("kept"), "ids")


def stream_outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each view that a timer has decided: the user's first purchase within six hours, or none."""
    folder = temporary_folder(spark, "stream")
    rows = _delayed(_events(spark, sf_dir)).select("event_id", "user_id", "event_type", "ts", "batch")
    replay(rows, "batch", folder, lambda s: outcomes(s, within_ms=WITHIN_MS), out=f"{folder}/out", state=ROCKS)
    return spark.read.parquet(f"{folder}/out")


def stream_join_interval(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A user's clicks and the purchases within an hour of each, as a join of two streams."""
    folder = temporary_folder(spark, "stream")

    def made(events: DataFrame) -> DataFrame:
        clicks = events.where("event_type = 'click'").select("user_id", F.col("event_id").alias("a"), F.col("ts").alias("ta"))
        bought = events.where("event_type = 'purchase'").select("user_id", F.col("event_id").alias("b"), F.col("ts").alias("tb"))
        return interval_join(clicks, bought, "user_id", left_ts="ta", right_ts="tb", within="1 hour", late="2 hours").select("user_id", "a", "b")

    replay(_events(spark, sf_dir).select("event_id", "user_id", "event_type", "ts", "period"), "period", folder, made, out=f"{folder}/out")
    return spark.read.parquet(f"{folder}/out")


_ALL = (stream_deduplicated, stream_outcomes, stream_join_interval)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f"x_{f.__name__}": f for f in _ALL}


_ROWS = (
    f"WITH span AS (SELECT min(epoch_us(ts)) AS first, (max(epoch_us(ts)) - min(epoch_us(ts))) // {PERIODS} + 1 AS width FROM events), "
    f"rows AS (SELECT event_id, user_id, event_type, epoch_us(ts) AS us, least(CAST((epoch_us(ts) - first) // width AS INTEGER) + "
    f"CASE WHEN event_id % 11 = 3 THEN 1 WHEN event_id % 37 = 5 THEN 2 ELSE 0 END, {PERIODS - 1}) AS batch FROM events, span), "
)
_MARKS = f"marks AS (SELECT batch, max(m) OVER (ORDER BY batch ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) - {DAY_MS} AS mark FROM (SELECT batch, max(us // 1000) AS m FROM {{}} GROUP BY batch)), "


def oracle_sql() -> dict[str, str]:
    made = {
        "stream_deduplicated": _ROWS
        + f"sent AS (SELECT event_id, us, batch FROM rows UNION ALL SELECT event_id, us, least(batch + 1, {PERIODS - 1}) FROM rows WHERE event_id % 5 = 0), "
        + _MARKS.format("sent")
        + "judged AS (SELECT *, coalesce(us <= mark * 1000, false) AS late FROM sent JOIN marks USING (batch)), "
        "firsts AS (SELECT event_id, min(batch) AS batch FROM judged WHERE NOT late GROUP BY event_id), "
        "kept AS (SELECT batch, count(*) AS kept, CAST(sum(event_id) AS BIGINT) AS ids FROM firsts GROUP BY batch) "
        "SELECT batch, count(*) AS came, count(*) FILTER (late) AS late, coalesce(any_value(kept), 0) AS kept, any_value(ids) AS ids FROM judged LEFT JOIN kept USING (batch) GROUP BY batch",
        "stream_outcomes": _ROWS
        + _MARKS.format("rows")
        + "timely AS (SELECT * FROM rows JOIN marks USING (batch) WHERE mark IS NULL OR us > mark * 1000), "
        f"done AS (SELECT * FROM timely WHERE event_type = 'view' AND us // 1000 + {WITHIN_MS} <= (SELECT max(us // 1000) - {DAY_MS} FROM rows)), "
        "met AS (SELECT v.user_id, v.event_id, min(struct_pack(us := p.us, id := p.event_id)) AS p FROM done v LEFT JOIN timely p ON p.user_id = v.user_id AND p.event_type = 'purchase' "
        f"AND p.us > v.us AND p.us // 1000 < v.us // 1000 + {WITHIN_MS} GROUP BY ALL) "
        "SELECT user_id, event_id, CASE WHEN p.id IS NULL THEN 'abandoned' ELSE 'bought' END AS outcome, p.id AS purchase_id FROM met",
        "stream_join_interval": "SELECT a.user_id, a.event_id AS a, b.event_id AS b FROM events a JOIN events b ON a.user_id = b.user_id AND b.ts >= a.ts AND b.ts <= a.ts + INTERVAL 1 HOUR WHERE a.event_type = 'click' AND b.event_type = 'purchase'",
    }
    return {f"x_{k}": v for k, v in made.items()}
