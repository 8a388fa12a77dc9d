"""Joins of intervals with intervals or points, and as-of joins, without nested loops or whole keys in one task."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _level(low: str, high: str) -> Column:
    """The power of two that an interval's length needs."""
    return F.ceil(F.log2((F.col(high) - F.col(low)).cast("double") + 1)).cast("int")


def _cells(rows: DataFrame, low: str, high: str, levels: Column) -> DataFrame:
    """A row for each level given and cell of it that the interval meets: two at most, as the level fits its length."""
    rows = rows.withColumn("__level", F.explode(levels))
    at = lambda c: F.expr(f"shiftright(`{c}`, __level)")
    return rows.withColumn("__cell", F.explode(F.sequence(at(low), at(high))))


def overlap_join(left: DataFrame, right: DataFrame, spans: tuple[str, str, str, str], keys: Sequence[str] = ()) -> DataFrame:
    """Pairs of rows whose intervals meet, ends included; ``keys`` must be equal besides.

    ``spans`` names the low and high column of each side, whole numbers such as
    days or microseconds; for points both are the same column. An interval lives
    in the one or two cells of the size that fits its length, and visits the
    cells of every larger size that the other side uses; so long and short ones
    meet by equal cells, and a row becomes a few, whatever its length. A pair
    that shares two cells counts where its overlap begins. Rows without a bound,
    or whose high is below their low, meet nothing. The sides share no column
    names but ``keys``.
    """
    a, b, c, d = spans
    left, right = left.where(F.col(a) <= F.col(b)), right.where(F.col(c) <= F.col(d))
    # As many sizes as a number has bits at most.
    of = lambda df, lo, hi: sorted(r[0] for r in df.select(_level(lo, hi)).distinct().collect())
    lefts, rights = of(left, a, b), of(right, c, d)
    wide = lambda found: F.array(*[F.lit(k) for k in found]).cast("array<int>")
    own_a, own_b = _level(a, b), _level(c, d)
    # The longer one is at home; of two as long, the right one.
    visits = _cells(left, a, b, F.filter(wide(rights), lambda k: k >= own_a)).withColumn("__home", F.lit(1))
    homes = _cells(right, c, d, F.array(own_b)).withColumn("__home", F.lit(1))
    hosts = _cells(left, a, b, F.array(own_a)).withColumn("__home", F.lit(0))
    guests = _cells(right, c, d, F.filter(wide(lefts), lambda k: k > own_b)).withColumn("__home", F.lit(0))
    met = visits.unionByName(hosts).join(homes.unionByName(guests), [*keys, "__home", "__level", "__cell"])
    begins = F.greatest(F.col(a), F.col(c))
    met = met.where((begins <= F.least(F.col(b), F.col(d))) & (F.expr("shiftright(greatest({0}, {1}), __level)".format(f"`{a}`", f"`{c}`")) == F.col("__cell")))
    return met.drop("__home", "__level", "__cell")


def as_of_join(rows: DataFrame, key: str, order: Sequence[str], value: Column, *, bucket: Column, name: str) -> DataFrame:
    """``rows`` with ``name``: the last value that is not null of the rows before each, by ``order`` within ``key``.

    ``bucket`` cuts a key's rows into parts in the same order, such as days: each
    part is a task's work, however many rows the key has. A part's last value is
    all that the later ones need of it; these are carried over parts that have
    none by a scan of one row a part.
    """
    parted = rows.withColumns({"__bucket": bucket, "__value": value})
    before = Window.partitionBy(key, "__bucket").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    inside = parted.withColumn("__inside", F.last("__value", ignorenulls=True).over(before))
    known = F.when(F.col("__value").isNotNull(), F.struct(*order))
    heads = parted.groupBy(key, "__bucket").agg(F.max_by("__value", known).alias("__end"))
    earlier = Window.partitionBy(key).orderBy("__bucket").rowsBetween(Window.unboundedPreceding, -1)
    carried = heads.select(key, "__bucket", F.last("__end", ignorenulls=True).over(earlier).alias("__carried"))
    joined = inside.join(carried, (inside[key].eqNullSafe(carried[key])) & (inside["__bucket"].eqNullSafe(carried["__bucket"])), "left")
    return joined.select(*[inside[c] for c in rows.columns], F.coalesce("__inside", "__carried").alias(name))
