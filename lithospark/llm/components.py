"""Connected components by alternating large-star and small-star steps.

Every step is a grouping and a join on the links that are left; nothing is
collected, and a hub's links are joined like any others, so a skewed join can
be split.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import checkpointed


def components(links: DataFrame) -> DataFrame:
    """``(node, component)`` for each node of ``links`` ``(a, b)``: the least node it reaches.

    Links of a node with itself and repeated ones do no harm; no links give no
    rows.
    """
    links = checkpointed(
        links.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    )
    state = None
    while True:
        both = links.union(links.select("b", "a"))
        least = both.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("least"))
        large = both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("least").alias("b"))
        lower = large.groupBy("a").agg(F.min("b").alias("least"))
        small = (
            large.join(lower, "a")
            .select(F.explode(F.array(F.struct("a", "least"), F.struct(F.col("b").alias("a"), "least"))).alias("x"))
            .select("x.a", F.col("x.least").alias("b"))
            .where("a <> b")
        )
        links = checkpointed(small.distinct())
        now = links.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if now == state:
            break
        state = now
    return links.select(F.col("a").alias("node"), F.col("b").alias("component")).union(
        links.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct()
    )
