"""Sharding by a two-pass external shuffle.

Pass 1 scatters rows uniformly over memory-sized buckets by a seeded hash of
their id and text; pass 2 puts each bucket in the order of a Fisher-Yates
permutation (Spark's ``shuffle``) of its places. The buckets laid end to end
are one random order of the whole table, which is cut into shards of equal
counts. DataFrame functions only.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import checkpointed, column, table, without

#: Bytes that a row counts for besides its text: a bucket of very short texts would have too many rows to permute.
ROW_BYTES = 64
#: Buckets that share a partition of the shuffle, and the most partitions. Beyond those (5 TB of text with the usual size)
#: partitions get more buckets, no larger ones: rows are sorted on disk, and only a bucket's permutation is held in memory.
BUCKETS_EACH, MAX_PARTITIONS = 4, 20_000
#: A row with more copies than this that make more than this share of a table is spread over buckets copy by copy.
COPIES, FREQUENT = 10_000, 1e-4

def text_bytes(text: Column) -> Column:
    """UTF-8 bytes of the text (null: none) plus 1."""
    return (F.coalesce(F.octet_length(text), F.lit(0)) + 1).cast("long")


def _spread(docs: DataFrame, order: Column, rows: int) -> DataFrame:
    """``docs`` with ``__order``: ``order`` for most rows, another value for each copy of a row that is frequent.

    One pass keeps count of ``1 / FREQUENT`` candidates, none of the frequent
    ones missing; a second one counts those exactly. Copies are told apart by
    their place in the scan, so where there are any the table is written with
    their values: computed anew in another order, they would differ.
    """
    plain = docs.select("*", order.alias("__order"))
    if rows <= COPIES:
        return plain
    hashed = docs.select(order.alias("order"))
    likely = hashed.freqItems(["order"], FREQUENT).first()[0]
    counted = hashed.where(F.col("order").isin(likely)).groupBy("order").agg(F.count(F.lit(1)).alias("n"))
    often = [r.order for r in counted.where(F.col("n") > max(COPIES, FREQUENT * rows)).collect()]
    if not often:
        return plain
    apart = F.when(order.isin(often), F.xxhash64(order, F.monotonically_increasing_id())).otherwise(order)
    return checkpointed(docs.select("*", apart.alias("__order")))


def shard(
    docs: DataFrame,
    *,
    shards: int = 16,
    bucket_bytes: int = 64 << 20,
    seed: int = 20240607,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """``docs`` with ``shard`` (0 to ``shards`` - 1) and ``slot`` (gapless from 0).

    The law is ``rows``: the counts of any two shards differ by one at most.
    A row's place depends on the seed and on the ids and texts of the table,
    not on its files. Rows equal in id and text are interchangeable; very many
    of them (``COPIES``, ``FREQUENT``) are told apart by their place in the
    scan, so that no bucket gets them all. Null ids, null and empty texts and
    texts of any length are rows like others; an empty table gives no rows.
    Input columns named ``shard`` or ``slot`` give way to the new ones; all
    others are kept.
    """
    docs = without(docs, "shard", "slot")
    total, rows = docs.agg(F.sum(text_bytes(column(text_col))), F.count(F.lit(1))).first()
    buckets = max(16 * shards, math.ceil(((total or 0) + ROW_BYTES * rows) / bucket_bytes))
    partitions = min(math.ceil(buckets / BUCKETS_EACH), MAX_PARTITIONS)

    keyed = _spread(docs, F.xxhash64(F.lit(seed), column(id_col), column(text_col)), rows)
    bucket = F.pmod(F.xxhash64(F.lit(seed + 1), F.col("__order")), F.lit(buckets)).cast("int")
    part = F.pmod(F.col("__bucket"), F.lit(partitions)).cast("int")
    keyed = keyed.withColumn("__bucket", bucket).withColumn("__part", part)
    sizes = checkpointed(keyed.groupBy("__part", "__bucket").agg(F.count(F.lit(1)).alias("__n")))

    # Where a bucket begins: rows of the parts before its own, then of the buckets before it in its part.
    earlier = lambda w: w.rowsBetween(Window.unboundedPreceding, -1)
    parts = sizes.groupBy("__part").agg(F.sum("__n").alias("__rows"))
    before = F.coalesce(F.sum("__rows").over(earlier(Window.orderBy("__part"))), F.lit(0))
    parts = parts.select("__part", before.alias("__before"), F.sum("__rows").over(Window.partitionBy()).alias("__all"))
    inside = F.coalesce(F.sum("__n").over(earlier(Window.partitionBy("__part").orderBy("__bucket"))), F.lit(0))
    starts = sizes.join(F.broadcast(parts), "__part").select(
        "__part", "__bucket", "__n", (F.col("__before") + inside).alias("__start"), "__all"
    )

    # ``shuffle`` draws from one stream a partition, so partitions and the order in them are fixed.
    permuted = starts.repartitionById(partitions, "__part").sortWithinPartitions("__part", "__bucket")
    permuted = permuted.withColumn("__places", F.shuffle(F.sequence(F.lit(1), F.col("__n").cast("int")), seed))
    scattered = keyed.repartitionById(partitions, "__part")
    within = Window.partitionBy("__part", "__bucket").orderBy("__order", column(id_col), F.crc32(column(text_col)))
    placed = (
        scattered.withColumn("__row", F.row_number().over(within))
        .join(permuted.hint("merge"), ["__part", "__bucket"])
        .withColumn("__at", F.col("__start") + F.element_at("__places", F.col("__row")) - 1)
    )

    few, extra = F.expr(f"__all div {shards}"), F.col("__all") % shards
    wide = extra * (few + 1)  # rows in the shards that hold one row more
    number = F.when(F.col("__at") < wide, F.expr(f"__at div (__all div {shards} + 1)")).otherwise(
        extra + F.floor((F.col("__at") - wide) / F.greatest(few, F.lit(1)))
    )
    first = number * few + F.least(number, extra)
    return placed.select(
        *[column(c) for c in docs.columns], number.cast("int").alias("shard"), (F.col("__at") - first).cast("long").alias("slot")
    )


def write_shards(sharded: DataFrame, path: str) -> None:
    """One folder a shard, rows in slot order within each file."""
    sharded.sortWithinPartitions("shard", "slot").write.partitionBy("shard").parquet(path)


def op1_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in 16 shards under the law ``rows``; ``text_crc32`` is null for a null text."""
    return shard(table(spark, sf_dir, "documents"), shards=16).select(
        "doc_id",
        text_bytes(F.col("text")).alias("size"),
        F.crc32(F.col("text")).alias("text_crc32"),
        F.lit("rows").alias("law"),
        "shard",
        "slot",
        F.lit(None).cast("int").alias("grown_shard"),
    )
