"""Approximate nearest neighbours by robust-pruned directed graphs.

Rows are dealt over shards of bounded size by a hash. In each shard greedy
searches propose neighbours for every vector, pruning with relaxed distances
keeps diverse edges, and a beam search from the nearest of a sample answers each
query. The best of all shards are ranked by the exact cosine of the original
vectors.
"""

from __future__ import annotations

import io

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import column, ship_package, table

#: Vectors, and bytes of vectors and edges, in a shard, about. A table of fewer than ``SPREAD`` such shards has as many
#: smaller ones, of ``LEAST_ROWS`` at least, so that it is built in parallel.
SHARD_ROWS, SHARD_BYTES, SPREAD, LEAST_ROWS = 32_768, 128 << 20, 16, 4096
#: Queries that one task searches a shard for.
QUERY_ROWS = 16_384
#: Edges out of a vector; candidates that a search keeps while building; the beam of a query.
DEGREE, BUILD_BEAM, BEAM = 24, 48, 64
#: An edge is dropped if a kept one is nearer to its end by this factor (of squared distances).
RELAX = 1.44
#: Searches that advance together, and nodes that each opens at once.
TOGETHER, OPENED = 256, 4
#: One vector in so many, and so many of them at least, are looked at before a search, which begins at the nearest of them:
#: a walk along edges alone would not leave a large cluster for another.
ENTRY_SHARE, ENTRIES = 32, 256


class Graph:
    """Unit vectors, edges between them (padded by -1) and the vectors where searches begin."""

    def __init__(self, unit: np.ndarray, edges: np.ndarray, entries: np.ndarray) -> None:
        self.unit, self.edges, self.entries = unit, edges, entries

    @classmethod
    def build(cls, unit: np.ndarray, seed: int = 5) -> Graph:
        n = len(unit)
        rng = np.random.default_rng(seed)
        entries = np.sort(rng.permutation(n)[: max(ENTRIES, n // ENTRY_SHARE)]).astype(np.int32)
        degree = min(DEGREE, n - 1)
        edges = np.full((n, DEGREE), -1, dtype=np.int32)
        if degree:
            edges[:, :degree] = (np.arange(n)[:, None] + rng.integers(1, n, (n, degree))) % n
        graph = cls(unit, edges, entries)
        if n > 2:
            for _ in range(2):
                order = rng.permutation(n)
                for i in range(0, n, TOGETHER):
                    graph._improve(order[i : i + TOGETHER])
        return graph

    def _distances(self, at: np.ndarray, others: np.ndarray) -> np.ndarray:
        """Squared distances of each vector to its row of others; no other is infinitely far."""
        far = 2 - 2 * np.matmul(self.unit[others], at[:, :, None])[:, :, 0]
        far[others < 0] = np.inf
        return far

    def search(self, queries: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
        """The ``width`` nearest vectors that a beam search meets for each query, with distances; -1 where fewer."""
        n, rows = len(queries), np.arange(len(queries))
        beam = np.full((n, width), -1, dtype=np.int32)
        far = np.full((n, width), np.inf, dtype=np.float32)
        begun = min(len(self.entries), max(1, width // 2))
        apart = 2 - 2 * queries @ self.unit[self.entries].T
        nearest = np.argpartition(apart, begun - 1, axis=1)[:, :begun]
        beam[:, :begun] = self.entries[nearest]
        far[:, :begun] = np.take_along_axis(apart, nearest, axis=1)
        open_ = np.zeros((n, width), dtype=bool)
        open_[:, :begun] = True
        met = np.zeros((n, len(self.unit)), dtype=bool)
        met[rows[:, None], beam[:, :begun]] = True
        live = rows
        opened = min(OPENED, width)
        while len(live):
            waiting = np.where(open_[live], far[live], np.inf)
            first = np.argpartition(waiting, opened - 1, axis=1)[:, :opened]
            ready = np.take_along_axis(open_[live], first, axis=1)
            here = np.take_along_axis(beam[live], first, axis=1)
            open_[live[:, None], first] = False
            around = np.where(ready[:, :, None], self.edges[here], -1).reshape(len(live), -1)
            ahead = np.where(met[live[:, None], around], -1, around)
            there, which = np.nonzero(around >= 0)
            met[live[there], around[there, which]] = True
            ahead.sort(axis=1)
            ahead[:, 1:][ahead[:, 1:] == ahead[:, :-1]] = -1
            dist = self._distances(queries[live], ahead)
            all_far = np.concatenate((far[live], dist), axis=1)
            pick = np.argpartition(all_far, width - 1, axis=1)[:, :width]
            beam[live] = np.take_along_axis(np.concatenate((beam[live], ahead), axis=1), pick, axis=1)
            far[live] = np.take_along_axis(all_far, pick, axis=1)
            fresh = np.concatenate((open_[live], ahead >= 0), axis=1)
            open_[live] = np.take_along_axis(fresh, pick, axis=1)
            live = live[open_[live].any(axis=1)]
        order = np.argsort(far, axis=1, kind="stable")
        return np.take_along_axis(beam, order, axis=1), np.take_along_axis(far, order, axis=1)

    def _prune(self, at: np.ndarray, others: np.ndarray) -> np.ndarray:
        """Diverse edges of each vector among its row of candidates."""
        others = np.where(others == at[:, None], -1, others)
        far = self._distances(self.unit[at], others)
        near = self.unit[others]
        between = 2 - 2 * np.matmul(near, near.transpose(0, 2, 1))
        kept = np.full((len(at), DEGREE), -1, dtype=np.int32)
        rows = np.arange(len(at))
        for k in range(DEGREE):
            best = far.argmin(axis=1)
            good = np.isfinite(far[rows, best])
            if not good.any():
                break
            kept[good, k] = others[rows, best][good]
            far[(RELAX * between[rows, best] <= far) & good[:, None]] = np.inf
            far[rows[good], best[good]] = np.inf
        return kept

    def _improve(self, batch: np.ndarray) -> None:
        """New edges for a batch of vectors, and edges back to them."""
        met, _ = self.search(self.unit[batch], BUILD_BEAM)
        self.edges[batch] = self._prune(batch, np.concatenate((met, self.edges[batch]), axis=1))
        ends = self.edges[batch].ravel()
        starts = np.repeat(batch, DEGREE).astype(np.int32)[ends >= 0]
        ends = ends[ends >= 0]
        order = np.argsort(ends, kind="stable")
        ends, starts = ends[order], starts[order]
        to, first, count = np.unique(ends, return_index=True, return_counts=True)
        # Few vectors get many edges back at once; rounds keep the candidates of each narrow.
        for skip in range(0, int(count.max(initial=0)), DEGREE):
            some = count > skip
            more = np.full((int(some.sum()), DEGREE), -1, dtype=np.int32)
            lengths = np.minimum(count[some] - skip, DEGREE)
            places = np.arange(DEGREE)[None] < lengths[:, None]
            more[places] = np.concatenate(
                [starts[f + skip : f + skip + m] for f, m in zip(first[some].tolist(), lengths.tolist(), strict=True)]
            )
            have = self.edges[to[some]]
            more[(more[:, :, None] == have[:, None, :]).any(axis=2)] = -1
            both = np.concatenate((have, more), axis=1)
            both = np.take_along_axis(both, np.argsort(both < 0, axis=1, kind="stable"), axis=1)
            over = (both >= 0).sum(axis=1) > DEGREE
            new = both[:, :DEGREE]
            if over.any():
                new[over] = self._prune(to[some][over], both[over])
            self.edges[to[some]] = new


class Shard:
    """Different rows of one shard and how often each occurs; equal directions are one vector of the graph."""

    def __init__(self, ids: np.ndarray, counts: np.ndarray, vectors: np.ndarray, groups: np.ndarray, graph: Graph) -> None:
        self.ids, self.counts, self.vectors, self.groups, self.graph = ids, counts, vectors, groups, graph
        self.order = np.argsort(groups, kind="stable")
        self.starts = np.searchsorted(groups[self.order], np.arange(len(graph.unit) + 1))
        self.lengths = np.sqrt((vectors * vectors).sum(axis=1))

    @classmethod
    def build(cls, ids: np.ndarray, counts: np.ndarray, vectors: np.ndarray) -> Shard:
        unit = _unit(vectors)
        _, first, groups = np.unique(unit, axis=0, return_index=True, return_inverse=True)
        return cls(ids, counts, vectors, groups.ravel(), Graph.build(unit[first]))

    def dumps(self) -> bytes:
        out = io.BytesIO()
        np.savez(out, ids=self.ids, counts=self.counts, vectors=self.vectors, groups=self.groups, unit=self.graph.unit, edges=self.graph.edges, entries=self.graph.entries)
        return out.getvalue()

    @classmethod
    def loads(cls, data: bytes) -> Shard:
        read = np.load(io.BytesIO(data))
        return cls(read["ids"], read["counts"], read["vectors"], read["groups"], Graph(read["unit"], read["edges"], read["entries"]))

    def nearest(self, numbers: np.ndarray, ids: np.ndarray, queries: np.ndarray, k: int) -> pd.DataFrame:
        """The k nearest rows of all that the beam of each query holds, its own row left out, by exact cosine."""
        out = []
        width = min(max(BEAM, 2 * k), max(1, len(self.graph.unit)))
        for i in range(0, len(ids), TOGETHER):
            found, _ = self.graph.search(_unit(queries[i : i + TOGETHER]), width)
            for number, own, query, nodes in zip(numbers[i : i + TOGETHER].tolist(), ids[i : i + TOGETHER].tolist(), queries[i : i + TOGETHER], found, strict=True):
                rows = np.concatenate([self.order[self.starts[g] : self.starts[g + 1]] for g in nodes[nodes >= 0].tolist()])
                # One sum a row, added up alike, so that equal vectors have equal scores.
                score = (self.vectors[rows] * query).sum(axis=1) / (self.lengths[rows] * np.sqrt((query * query).sum()))
                best = np.lexsort((self.ids[rows], -score))[: k + 1]
                for b in best.tolist():
                    row = rows[b]
                    same = self.ids[row] == own and np.array_equal(self.vectors[row], query)
                    if left := int(self.counts[row]) - same:
                        out.append((number, own, int(self.ids[row]), float(score[b]), left))
        return pd.DataFrame(out, columns=["number", "query_id", "vec_id", "score", "copies"])


def _unit(vectors: np.ndarray) -> np.ndarray:
    return (vectors / np.linalg.norm(vectors, axis=1, keepdims=True)).astype(np.float32)


def usable(vector: Column) -> Column:
    """Whether a vector is there, not zero, and all of finite numbers."""
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.coalesce(finite & F.exists(vector, lambda x: x != 0), F.lit(False))


def shards_for(rows: int, shard_rows: int) -> int:
    """How many shards so many rows are dealt over: ``SPREAD`` at least, while they have ``LEAST_ROWS``."""
    return max(1, -(-rows // shard_rows), min(SPREAD, -(-rows // min(LEAST_ROWS, shard_rows))))


def nearest_neighbours(
    rows: DataFrame, queries: DataFrame, *, k: int = 5, id_col: str = "vec_id", vector_col: str = "embedding", shard_rows: int = SHARD_ROWS
) -> DataFrame:
    """``(query_id, rank, vec_id, score)``: the ``k`` nearest rows found for each query.

    Every usable row is indexed, each row that repeats an id too. A query's own
    row, one with its id and vector, is no candidate. Queries that repeat are
    answered each. Only vectors of one length are compared. Ties go to the
    smaller id. Null ids, and vectors that are null, zero or hold null or
    non-finite numbers, take no part. Nothing to search gives no rows; other
    columns are not looked at.
    """
    spark = rows.sparkSession
    ship_package(spark)

    def clean(df: DataFrame) -> DataFrame:
        df = df.select(column(id_col).cast("long").alias("id"), column(vector_col).cast("array<double>").alias("v"))
        # Equal rows are one, with a count.
        return df.where(usable(F.col("v")) & F.col("id").isNotNull()).groupBy("id", "v").agg(F.count(F.lit(1)).alias("n"))

    rows, queries = clean(rows), clean(queries)
    sizes = {r.size: r.n for r in rows.groupBy(F.size("v").alias("size")).agg(F.count(F.lit(1)).alias("n")).collect()}
    asked = queries.count()
    chunks = max(1, -(-asked // QUERY_ROWS))
    # Numbers are held as double and single precision, edges and ids besides.
    fit = lambda size: max(1, min(shard_rows, SHARD_BYTES // (12 * size + 4 * DEGREE + 32)))
    shards = max((shards_for(n, fit(size)) for size, n in sizes.items()), default=1)

    def build(key: tuple, part: pd.DataFrame) -> pd.DataFrame:
        vectors = np.stack(part["v"].to_numpy())
        order = np.lexsort((*vectors.T[::-1], part["id"].to_numpy()))
        shard = Shard.build(part["id"].to_numpy()[order], part["n"].to_numpy()[order], vectors[order])
        return pd.DataFrame({"size": [key[0]], "shard": [key[1]], "index": [shard.dumps()]})

    def search(part: pd.DataFrame, index: pd.DataFrame) -> pd.DataFrame:
        if not len(index) or not len(part):
            return pd.DataFrame({"number": [], "query_id": [], "vec_id": [], "score": [], "copies": []})
        return Shard.loads(index["index"].iloc[0]).nearest(part["number"].to_numpy(), part["id"].to_numpy(), np.stack(part["v"].to_numpy()), k)

    place = F.pmod(F.xxhash64("id", "v"), F.lit(shards)).cast("int").alias("shard")
    dealt = rows.select(F.size("v").alias("size"), place, "id", "v", "n").repartition(min(4 * shards, 10_000), "size", "shard")
    index = dealt.groupBy("size", "shard").applyInPandas(build, "size int, shard int, index binary")
    copies = index.select("*", F.explode(F.sequence(F.lit(0), F.lit(chunks - 1))).alias("chunk"))
    number = F.xxhash64("v").alias("number")
    sent = queries.select(
        F.size("v").alias("size"),
        F.explode(F.sequence(F.lit(0), F.lit(shards - 1))).alias("shard"),
        F.pmod(F.xxhash64("id", F.lit(1)), F.lit(chunks)).cast("int").alias("chunk"),
        "id",
        "v",
        number,
    )
    keys = ["size", "shard", "chunk"]
    found = sent.groupBy(*keys).cogroup(copies.groupBy(*keys)).applyInPandas(
        search, "number long, query_id long, vec_id long, score double, copies long"
    )
    best = Window.partitionBy("query_id", "number").orderBy(F.desc("score"), "vec_id")
    found = found.withColumn("place", F.row_number().over(best)).where(F.col("place") <= k)
    earlier = F.coalesce(F.sum("copies").over(best.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    ranked = found.withColumn("earlier", earlier).where(F.col("earlier") < k).select(
        "query_id", "number", "vec_id", "score",
        F.explode(F.sequence((F.col("earlier") + 1).cast("int"), F.least(F.col("earlier") + F.col("copies"), F.lit(k)).cast("int"))).alias("rank"),
    )
    several = queries.where("n > 1").select(F.col("id").alias("query_id"), number, "n")
    repeats = F.explode(F.sequence(F.lit(1), F.coalesce("n", F.lit(1)).cast("int")))
    return ranked.join(several, ["query_id", "number"], "left").select("query_id", "rank", "vec_id", "score", repeats.alias("copy")).drop("copy")


def op9_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five nearest of all embeddings for every one whose id is divisible by 50."""
    rows = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    return nearest_neighbours(rows, rows.where(F.col("vec_id") % 50 == 0), k=5)
