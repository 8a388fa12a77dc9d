"""Streams with state of their own: repeated rows, timers by key, and joins of two streams."""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..session import ship_package

OUTCOMES = "user_id long, event_id long, outcome string, purchase_id long"


def deduplicated(events: DataFrame, *keys: str, ts: str = "ts", late: str = "1 day") -> DataFrame:
    """Rows of a stream, the first of each key; its state goes once the watermark, ``late`` behind, has passed."""
    return events.withWatermark(ts, late).dropDuplicatesWithinWatermark(list(keys))


class Outcomes(StatefulProcessor):
    """Says of each view of a user, once its time has passed, which purchase came first within it, or that none did.

    Rows come in any order: views and purchases wait in the user's state. One
    timer, at the end of the earliest view of a batch, decides all views whose
    time has passed by then and is set anew for the others; purchases that no
    view to come can mean are dropped then. So the store is called a few times a
    user and batch, not for each row.
    """

    def __init__(self, within_ms: int) -> None:
        self.within = within_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.views = handle.getListState("views", "event_id long, us long")
        self.purchases = handle.getListState("purchases", "event_id long, us long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        new = {"view": [], "purchase": []}
        for batch in rows:
            for event_id, kind, us in zip(batch["event_id"].tolist(), batch["event_type"], batch["us"].tolist(), strict=True):
                new[kind].append((event_id, us))
        if new["view"]:
            self.views.appendList(new["view"])
            self.handle.registerTimer(self._first_end(new["view"]))
        if new["purchase"]:
            self.purchases.appendList(new["purchase"])
        yield pd.DataFrame()

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        # A row that came twice is one.
        views, end = dict(self.views.get()), timerValues.getCurrentWatermarkInMs()
        due = {event_id: us for event_id, us in views.items() if us // 1000 + self.within <= end}
        out = []
        if due:
            bought = sorted((us, event_id) for event_id, us in dict(self.purchases.get()).items())
            times = [us for us, _ in bought]
            for event_id, us in due.items():
                k = bisect_right(times, us)
                first = bought[k][1] if k < len(bought) and times[k] // 1000 < us // 1000 + self.within else None
                out.append((key[0], event_id, "abandoned" if first is None else "bought", first))
            left = [(event_id, us) for event_id, us in views.items() if event_id not in due]
            self._keep(self.views, left)
            self._keep(self.purchases, [(event_id, us) for us, event_id in bought if us // 1000 > end - self.within])
            if left:
                self.handle.registerTimer(self._first_end(left))
        made = pd.DataFrame(out, columns=["user_id", "event_id", "outcome", "purchase_id"])
        yield made.astype({"purchase_id": "Int64"})

    def _first_end(self, views: list[tuple[int, int]]) -> int:
        return min(us for _, us in views) // 1000 + self.within

    @staticmethod
    def _keep(state, rows: list[tuple[int, int]]) -> None:
        if rows:
            state.put(rows)
        else:
            state.clear()


def outcomes(events: DataFrame, *, within_ms: int, late: str = "1 day") -> DataFrame:
    """``(user_id, event_id, outcome, purchase_id)`` of each view of a stream of events: bought or abandoned within a time."""
    ship_package(events.sparkSession)
    rows = events.withWatermark("ts", late).where(F.col("event_type").isin("view", "purchase"))
    rows = rows.select("user_id", "event_id", "event_type", "ts", F.unix_micros("ts").alias("us"))
    return rows.groupBy("user_id").transformWithStateInPandas(Outcomes(within_ms), OUTCOMES, "append", "EventTime")


def interval_join(left: DataFrame, right: DataFrame, *keys: str, left_ts: str, right_ts: str, within: str, late: str) -> DataFrame:
    """Pairs of two streams' rows with equal keys, the right one at the left one's time or up to ``within`` after it.

    Both sides wait in state; a watermark ``late`` behind each clears those that
    nothing to come can meet.
    """
    span = F.expr(f"interval {within}")
    a, b = left.withWatermark(left_ts, late).alias("a"), right.withWatermark(right_ts, late).alias("b")
    same = [F.col(f"a.{k}") == F.col(f"b.{k}") for k in keys]
    near = (F.col(f"b.{right_ts}") >= F.col(f"a.{left_ts}")) & (F.col(f"b.{right_ts}") <= F.col(f"a.{left_ts}") + span)
    met = same[0]
    for c in [*same[1:], near]:
        met = met & c
    others = [F.col(f"b.{c}") for c in right.columns if c not in keys]
    return a.join(b, met).select("a.*", *others)
