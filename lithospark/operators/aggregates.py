"""Aggregates that no built-in expresses, by partial states that merge."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from typing import Protocol

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import ship_package

#: Groups that a task holds states of at most; then it hands them on and starts again.
HELD = 100_000


class Aggregate(Protocol):
    """An aggregate whose partial states are arrays: made from rows, merged in any order, and finished."""

    #: The SQL type of the result.
    kind: str

    def partial(self, *values: np.ndarray) -> np.ndarray: ...

    def merge(self, states: list[np.ndarray]) -> np.ndarray: ...

    def finish(self, state: np.ndarray): ...


class Covered:
    """How many whole numbers, such as days, lie in any of the intervals ``low`` to ``high``, ends included.

    A state is the disjoint intervals so far, in order, as pairs.
    """

    kind = "long"

    def partial(self, low: np.ndarray, high: np.ndarray) -> np.ndarray:
        kept = low <= high
        return self._disjoint(low[kept], high[kept])

    def merge(self, states: list[np.ndarray]) -> np.ndarray:
        both = np.concatenate(states).reshape(-1, 2)
        return self._disjoint(both[:, 0], both[:, 1])

    def finish(self, state: np.ndarray) -> int:
        pairs = state.reshape(-1, 2)
        return int((pairs[:, 1] - pairs[:, 0] + 1).sum())

    @staticmethod
    def _disjoint(low: np.ndarray, high: np.ndarray) -> np.ndarray:
        order = np.argsort(low, kind="stable")
        low, reach = low[order], np.maximum.accumulate(high[order])
        first = np.ones(len(low), dtype=bool)
        first[1:] = low[1:] > reach[:-1] + 1
        last = np.roll(first, -1)
        return np.stack((low[first], reach[last]), axis=1).ravel() if len(low) else low


def aggregated(df: DataFrame, keys: Sequence[str], values: Sequence[str], aggregate: Aggregate, name: str, *, held: int = HELD) -> DataFrame:
    """``(keys, name)``: the aggregate of the values, whole numbers, of each group.

    Each task makes one state a group of its own rows, and only states are
    shuffled: a group has as many as tasks that saw it, however many rows. Rows
    with a null value don't count; a null key is a group.
    """
    ship_package(df.sparkSession)
    kinds = dict(df.dtypes)
    rows = df.select(*keys, *[F.col(v).cast("long").alias(f"__v{k}") for k, v in enumerate(values)])

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        states: dict[tuple, np.ndarray] = {}

        def handed() -> pa.RecordBatch:
            columns = [pa.array([k[i] for k in states], schema.field(i).type) for i in range(len(keys))]
            made = pa.RecordBatch.from_arrays([*columns, pa.array([s.tolist() for s in states.values()], pa.list_(pa.int64()))], [*keys, "state"])
            states.clear()
            return made

        schema = None
        for batch in batches:
            schema = batch.schema
            for key, own in _groups(batch, len(keys)):
                new = aggregate.partial(*own)
                states[key] = aggregate.merge([states[key], new]) if key in states else new
            if len(states) > held:
                yield handed()
        if states:
            yield handed()

    def merged(key: tuple[pa.Scalar, ...], part: pa.Table) -> pa.Table:
        states = [np.array(s, dtype=np.int64) for s in part.column("state").to_pylist()]
        value = aggregate.finish(aggregate.merge(states))
        return pa.table({**{k: pa.array([x.as_py()], x.type) for k, x in zip(keys, key, strict=True)}, name: [value]})

    typed = ", ".join(f"`{k}` {kinds[k]}" for k in keys)
    states = rows.dropna(subset=[f"__v{k}" for k in range(len(values))]).mapInArrow(partial, f"{typed}, state array<long>")
    return states.groupBy(*keys).applyInArrow(merged, f"{typed}, `{name}` {aggregate.kind}")


def _groups(batch: pa.RecordBatch, keys: int) -> Iterator[tuple[tuple, list[np.ndarray]]]:
    """The batch's groups: each key and its rows of every value."""
    columns = [batch.column(i) for i in range(batch.num_columns)]
    codes = np.zeros(batch.num_rows, dtype=np.int64)
    for c in columns[:keys]:
        coded = c.dictionary_encode(null_encoding="encode")
        codes = codes * (len(coded.dictionary) + 1) + coded.indices.to_numpy(zero_copy_only=False)
        codes = np.unique(codes, return_inverse=True)[1]
    order = np.argsort(codes, kind="stable")
    starts = np.flatnonzero(np.diff(codes[order], prepend=-1))
    values = [c.to_numpy(zero_copy_only=False)[order] for c in columns[keys:]]
    named = [c.take(pa.array(order[starts])).to_pylist() for c in columns[:keys]]
    for k, start in enumerate(starts.tolist()):
        end = int(starts[k + 1]) if k + 1 < len(starts) else batch.num_rows
        yield tuple(n[k] for n in named), [v[start:end] for v in values]
