"""Mixing sources to target weights.

Each document gets a hash-random key. Keys are cut into ranges of about as many
rows within each source; sums by range, added up over the ranges, and a running sum inside
each range give every document the exact count of tokens before it in its
source's order. The cut falls at the source's exact budget, after as many whole
epochs as the budget holds.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import WORD, checkpointed, column, table, without, word_count

#: Rows of a key range, about, were all rows of one source; each range is sorted by one task.
RANGE_ROWS = 20_000
#: Key ranges within a source, at least.
LEAST_RANGES = 64
#: Rows of a table of sources that may be broadcast (under 100 bytes each).
BROADCAST_SOURCES = 10_000

ADDED = ("size", "source_size", "target", "taken")


def mix(
    docs: DataFrame,
    *,
    weights: Sequence[int] = (5, 2, 1),
    share: float = 1.0,
    most_epochs: int = 3,
    seed: str = "mix-1",
    source_col: str = "source",
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """``docs`` with ``size`` (words), ``source_size``, ``target`` and ``taken`` words.

    Sources in code point order, null last, take ``weights`` in turn. Targets
    share ``share`` of all words; none passes ``most_epochs`` times its source,
    the excess going to the others by weight. ``taken`` counts a document's
    words in the mix, repeats included; the one document at a source's cut may
    be taken in part. Null and empty texts have size 0 and take nothing; texts
    are counted whole, however long. Rows equal in id, text and source are
    interchangeable, and fall in one range. An empty table gives no rows. Input
    columns named like an added one give way to it.
    """
    docs = without(docs, *ADDED)
    parts = max(LEAST_RANGES, -(-docs.count() // RANGE_ROWS))
    keyed = docs.select(
        *[column(c) for c in docs.columns],
        word_count(column(text_col)).alias("size"),
        F.conv(
            F.substring(F.md5(F.concat_ws(":", F.lit(seed), column(id_col).cast("string"), column(text_col))), 1, 15), 16, 10
        )
        .cast("long")
        .alias("__key"),
    )
    span = (1 << 60) // parts
    keyed = keyed.withColumn("__range", F.expr(f"__key div {span}").cast("int"))

    ranges = checkpointed(
        keyed.groupBy(column(source_col).alias("__source"), "__range").agg(F.sum("size").alias("__range_size"))
    )
    sources = checkpointed(_targets(ranges, weights, share, most_epochs))
    known = sources.count()
    sources = F.broadcast(sources) if known <= BROADCAST_SOURCES else sources

    earlier = Window.partitionBy("__rank").orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)
    starts = (
        ranges.join(sources.select("__source", "__rank"), ranges["__source"].eqNullSafe(sources["__source"]))
        .select("__rank", "__range", F.coalesce(F.sum("__range_size").over(earlier), F.lit(0)).alias("__start"))
    )
    ordered = Window.partitionBy("__rank", "__range").orderBy("__key", column(id_col), "size")
    whole = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0)
    return (
        keyed.join(sources, column(source_col).eqNullSafe(F.col("__source")))
        .drop("__source")
        .join(starts, ["__rank", "__range"])
        .withColumn(
            "__before",
            F.col("__start")
            + F.coalesce(F.sum("size").over(ordered.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)),
        )
        .withColumn("__whole", whole.cast("long"))
        .withColumn(
            "__rest", F.floor(F.greatest(F.col("target") - F.col("__whole") * F.col("source_size"), F.lit(0.0))).cast("long")
        )
        .withColumn(
            "taken",
            F.col("__whole") * F.col("size")
            + F.least(F.greatest(F.col("__rest") - F.col("__before"), F.lit(0)), F.col("size")),
        )
        .select(*[column(c) for c in docs.columns], *ADDED)
    )


def _targets(ranges: DataFrame, weights: Sequence[int], share: float, most_epochs: int) -> DataFrame:
    """A row for each source: its rank, size and target. One task ranks them: they are as many as sources, not as rows.

    The level is what a unit of weight gets once all capped sources are set
    aside. Ordered by cap over weight, the capped ones come first, and the
    level reckoned at each source is greatest at the first uncapped one.
    """
    taken = F.array(*[F.lit(w) for w in weights])
    by_ratio = Window.orderBy(F.col("__cap") / F.col("__weight"), "__rank")
    before = by_ratio.rowsBetween(Window.unboundedPreceding, -1)
    after = by_ratio.rowsBetween(0, Window.unboundedFollowing)
    level = (F.col("__all") - F.coalesce(F.sum("__cap").over(before), F.lit(0))) / F.sum("__weight").over(after)
    return (
        ranges.groupBy("__source")
        .agg(F.sum("__range_size").alias("source_size"))
        .withColumn("__rank", F.row_number().over(Window.orderBy(F.col("__source").asc_nulls_last())))
        .withColumn("__weight", F.element_at(taken, ((F.col("__rank") - 1) % len(weights) + 1).cast("int")))
        .withColumn("__cap", F.col("source_size") * most_epochs)
        .withColumn("__all", F.sum("source_size").over(Window.partitionBy()) * F.lit(float(share)))
        .withColumn("__level", level)
        .withColumn("__level", F.max("__level").over(Window.partitionBy()))
        .select(
            "__source",
            "__rank",
            "source_size",
            F.least(F.col("__cap").cast("double"), F.col("__level") * F.col("__weight")).alias("target"),
        )
    )


def materialise(mixed: DataFrame, *, text_col: str = "text") -> DataFrame:
    """The mix itself: each document as often as taken, the one at a cut shortened.

    ``n_chars``, if there, follows a shortened text.
    """
    kept = [c for c in mixed.columns if c not in ADDED]
    words = F.regexp_extract_all(column(text_col), F.lit(r"[\x20\x09-\x0D]*" + WORD), F.lit(0))
    cut = F.col("__words") < F.col("size")
    rows = (
        mixed.where(F.col("taken") > 0)
        .withColumn("__words", F.explode(F.expr("transform(sequence(1, cast(ceil(taken / size) as int)), i -> least(size, taken - (i - 1) * size))")))
        .withColumn(
            text_col,
            F.when(cut, F.array_join(F.slice(words, 1, F.col("__words").cast("int")), "")).otherwise(column(text_col)),
        )
    )
    if "n_chars" in kept:
        rows = rows.withColumn("n_chars", F.when(cut, F.char_length(column(text_col)).cast("long")).otherwise(F.col("n_chars")))
    return rows.select(*[column(c) for c in kept])


def op3_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents mixed with weights 5, 2, 1 to all their words, three epochs at most."""
    return mix(table(spark, sf_dir, "documents")).select("doc_id", *ADDED)


OP3_SQL = r"""
WITH d AS (
  SELECT doc_id, source,
         CAST(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS BIGINT) AS size,
         CAST('0x' || substr(md5(concat_ws(':', 'mix-1', CAST(doc_id AS VARCHAR), text)), 1, 15) AS BIGINT) AS k
  FROM documents),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size,
             row_number() OVER (ORDER BY source NULLS LAST) AS rnk
      FROM d GROUP BY source),
w AS (SELECT *, CASE (rnk - 1) % 3 WHEN 0 THEN 5 WHEN 1 THEN 2 ELSE 1 END AS weight,
             source_size * 3 AS cap, CAST(sum(source_size) OVER () AS DOUBLE) AS total FROM s),
l AS (SELECT *, (total - coalesce(sum(cap) OVER (ORDER BY cap / weight, rnk ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
             / sum(weight) OVER (ORDER BY cap / weight, rnk ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS lv FROM w),
t AS (SELECT source, source_size, least(CAST(cap AS DOUBLE), max(lv) OVER () * weight) AS target FROM l),
p AS (SELECT d.doc_id, d.size, t.source_size, t.target,
             CASE WHEN t.source_size > 0 THEN CAST(floor(t.target / t.source_size) AS BIGINT) ELSE 0 END AS whole,
             coalesce(sum(d.size) OVER (PARTITION BY t.source ORDER BY k, doc_id, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS bef
      FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, size, source_size, target,
       CAST(whole * size + least(greatest(CAST(floor(greatest(target - whole * source_size, 0)) AS BIGINT) - bef, 0), size) AS BIGINT) AS taken
FROM p
"""
