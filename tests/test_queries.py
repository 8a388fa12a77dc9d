"""Every query against its SQL in DuckDB, on the smallest tables."""

from __future__ import annotations

import datetime
import os

import duckdb
import pytest

import __spark_entry__ as entry

FOLDER = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
OWN = sorted(k for k in entry.queries() if k.startswith(("geo_", "x_")))


@pytest.fixture(scope="module")
def duck():
    if not os.path.isdir(FOLDER):
        pytest.skip("no test tables")
    made = duckdb.connect()
    for t in TABLES:
        made.execute(f"CREATE VIEW {t} AS SELECT * FROM '{FOLDER}/{t}.parquet'")
    return made


def plain(value):
    if isinstance(value, float):
        return float(f"{value:.9g}")
    return str(value) if isinstance(value, datetime.date) else value


def rows(columns, found):
    order = sorted(range(len(columns)), key=lambda k: columns[k])
    return sorted((tuple(plain(r[k]) for k in order) for r in found), key=repr)


def agrees(spark, duck, name):
    got = entry.queries()[name](spark, FOLDER)
    want = duck.execute(entry.oracle_sql()[name])
    columns = [c[0] for c in want.description]
    assert sorted(columns) == sorted(got.columns)
    assert rows(got.columns, got.collect()) == rows(columns, want.fetchall())


@pytest.mark.parametrize("name", [n for n in OWN if n in entry.oracle_sql()])
def test_agrees(spark, duck, name):
    agrees(spark, duck, name)


def test_entry(spark, duck):
    assert entry.entry(spark).count() > 0


def test_points_of_orders_are_not_broadcast(spark):
    made = entry.queries()["geo_orders_in_claims"](spark, FOLDER)
    assert "Broadcast" not in made._jdf.queryExecution().executedPlan().toString()


def test_users_of_many_days_are_exact(spark, duck, tmp_path):
    """More users than a sketch counts exactly, numbers on both sides of zero and at the ends of bitmaps."""
    duck.execute(f"COPY (SELECT k AS event_id, k * 13 % 70001 - 3 AS user_id, TIMESTAMP '2024-01-01' + INTERVAL (k % 11) DAY AS ts FROM range(150000) r(k)) TO '{tmp_path}/events.parquet'")
    got = {(r.day, r.users, r.week) for r in entry.queries()["x_distinct_sketches"](spark, str(tmp_path)).collect()}
    own = duck.cursor()
    own.execute(f"CREATE OR REPLACE TEMP VIEW events AS SELECT * FROM '{tmp_path}/events.parquet'")
    names, want = ["day", "users", "week"], own.execute(entry.oracle_sql()["x_distinct_sketches"])
    columns = [c[0] for c in want.description]
    assert got == {tuple(r[columns.index(n)] for n in names) for r in want.fetchall()}
