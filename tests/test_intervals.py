"""Interval and as-of joins and aggregates of our own, against plain versions."""

from __future__ import annotations

import random

import numpy as np
import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from lithospark.operators.aggregates import Covered, aggregated
from lithospark.operators.intervals import as_of_join, overlap_join


def spans(pick, n, longest):
    out = []
    for i in range(n):
        low = pick.randrange(-500, 500)
        out.append((i, pick.randrange(3), low, low + pick.choice([0, 0, 1, 3, 17, longest])))
    return [*out, (n, 0, None, 5), (n + 1, 0, 5, None), (n + 2, 0, 9, 3), (n + 3, None, 0, 0)]


@pytest.mark.parametrize("keys", [[], ["k"]])
@pytest.mark.parametrize("seed", range(3))
def test_overlaps_like_a_nested_loop(spark, seed, keys):
    pick = random.Random(seed)
    a, b = spans(pick, 150, 400), spans(pick, 200, 1 + 900 * seed)
    left = spark.createDataFrame(a, "a long, k long, la long, ha long")
    right = spark.createDataFrame(b, f"b long, {'k' if keys else 'kb'} long, lb long, hb long")
    got = sorted((r.a, r.b) for r in overlap_join(left, right, ("la", "ha", "lb", "hb"), keys).collect())
    good = lambda r: None not in r[2:] and r[2] <= r[3]
    same = lambda x, y: not keys or (x[1] is not None and x[1] == y[1])
    want = [(x[0], y[0]) for x in a for y in b if good(x) and good(y) and same(x, y) and x[2] <= y[3] and y[2] <= x[3]]
    assert got == sorted(want)


def test_points_meet_spans_without_a_nested_loop(spark):
    points = spark.range(1000).select(F.col("id").alias("p"), (F.col("id") * 7 % 997).alias("v"))
    wide = spark.createDataFrame([(0, -(10**15), 10**15), (1, 5, 5), (2, 100, 400)], "s long, lo long, hi long")
    met = overlap_join(points, wide, ("v", "v", "lo", "hi"))
    assert "NestedLoop" not in met._jdf.queryExecution().toString() and "Cartesian" not in met._jdf.queryExecution().toString()
    got = {r.s: r.n for r in met.groupBy("s").agg(F.count("p").alias("n")).collect()}
    assert got == {0: 1000, 1: sum(k * 7 % 997 == 5 for k in range(1000)), 2: sum(100 <= k * 7 % 997 <= 400 for k in range(1000))}
    assert overlap_join(points.where("false"), wide, ("v", "v", "lo", "hi")).count() == 0


def test_as_of_in_parts_like_one_sort(spark):
    pick = random.Random(2)
    rows = [(pick.choice([1, 1, 1, 1, 2, None]), pick.randrange(300), i, pick.choice([None, None, i])) for i in range(400)] + [(3, 5, 1000, None)]
    df = spark.createDataFrame(rows, "u long, t long, i long, v long").repartition(4)
    got = as_of_join(df, "u", ["t", "i"], F.col("v"), bucket=F.expr("t div 10"), name="seen")
    before = Window.partitionBy("u").orderBy("t", "i").rowsBetween(Window.unboundedPreceding, -1)
    want = df.withColumn("seen", F.last("v", ignorenulls=True).over(before))
    assert got.columns == want.columns and got.exceptAll(want).isEmpty() and want.exceptAll(got).isEmpty()


@pytest.mark.parametrize("held", [1, 100_000])
def test_covered_like_a_set(spark, held):
    pick = random.Random(4)
    rows = [(pick.choice(["a", "b", None]), k := pick.randrange(200), k + pick.choice([-1, 0, 5, 60])) for _ in range(300)] + [("a", None, 3), ("c", 9, 3)]
    df = spark.createDataFrame(rows, "k string, low int, high int").repartition(5)
    made = aggregated(df, ["k"], ["low", "high"], Covered(), "n", held=held)
    plan = made._jdf.queryExecution().toString()
    assert plan.index("FlatMapGroupsInArrow") < plan.index("MapInArrow")
    want = {}
    for k, low, high in rows:
        if low is not None:
            want.setdefault(k, set()).update(range(low, high + 1))
    assert {r.k: r.n for r in made.collect()} == {k: len(v) for k, v in want.items()}
    assert aggregated(df.where("false"), ["k"], ["low", "high"], Covered(), "n").count() == 0


def test_merging_is_the_same_in_any_order():
    pick, own = np.random.default_rng(1), Covered()
    low = pick.integers(0, 300, 60)
    high = low + pick.integers(-2, 30, 60)
    whole = own.partial(low, high)
    for cut in (1, 20, 59):
        parts = [own.partial(low[:cut], high[:cut]), own.partial(low[cut:], high[cut:])]
        assert own.merge(parts).tolist() == own.merge(parts[::-1]).tolist() == whole.tolist()
    assert own.finish(whole) == len({d for a, b in zip(low.tolist(), high.tolist(), strict=True) for d in range(a, b + 1)})
