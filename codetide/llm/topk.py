"""Exact top-k by inner product: ball trees, branch and bound.

Components become floor(256 x) as integers. The vectors are dealt over shards by hash; each shard is a
ball tree. A node with centre c and radius r has no vector with a larger product with q than q.c + |q| r,
so a search visits nodes in the order of this bound and ends when the bound is below the k-th score.

The k-th score is shared between shards: a first pass searches one shard for each query, then waves of ever
more shards (`wave` times as many as all before) follow. Each wave starts from the k-th score that all earlier
ones have found together, which can only be too low, so later shards prune more; the number of waves is the
logarithm of the number of shards. Queries travel in packed
rows, `query_block` to a row, one row per shard; shards are bounded by `shard_rows`, so a task holds one
shard and one block of queries. What shards return is at most k rows per query and shard, cut to k by a
window that is limited per task before the shuffle. Products are exact: they are computed in doubles where
all sums are below 2^53, else in Python integers (cut to the range of a long).

Null vectors and vectors with a null or non-finite component take no part, nor do null ids. Rows that
share an id are one candidate, the smallest vector. Vectors of different length are not compared; vectors
without components score 0. Ties go to the smaller id. Extra columns are ignored.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from codetide.session import Stages

SCALE, K, SHARD_ROWS, QUERY_BLOCK, LEAF, WAVE = 256, 5, 8192, 512, 64, 8
LONG = (-(1 << 63), (1 << 63) - 1)


class BallTree:
    """Nodes halve their rows by the farthest-apart direction; arrays of rows are in leaf order."""

    def __init__(self, ids: np.ndarray, rows: np.ndarray, leaf: int = LEAF):
        self.order = np.arange(len(ids))
        self.ids, self.rows = ids, rows
        self.centres, self.radii, self.spans, self.children = [], [], [], []
        self._build(0, len(ids), leaf)
        self.ids, self.rows = ids[self.order], rows[self.order]

    def _build(self, a: int, b: int, leaf: int) -> int:
        part = self.rows[self.order[a:b]].astype(float)
        centre = part.mean(axis=0)
        distance = np.sqrt(((part - centre) ** 2).sum(axis=1))
        node = len(self.radii)
        self.centres.append(centre)
        # Rounding may not make a bound too small.
        self.radii.append(float(distance.max()) * (1 + 1e-9) + 1e-6)
        self.spans.append((a, b))
        self.children.append(None)
        if b - a > leaf and distance.max() > 0:
            pole = part[int(distance.argmax())]
            other = part[int((((part - pole) ** 2).sum(axis=1)).argmax())]
            side = np.argsort(part @ (other - pole), kind="stable")
            self.order[a:b] = self.order[a:b][side]
            middle = (a + b) // 2
            self.children[node] = (self._build(a, middle, leaf), self._build(middle, b, leaf))
        return node

    def arrays(self) -> None:
        self.centres = np.array(self.centres)
        self.radii = np.array(self.radii)

    def search(self, query_id: int, q: np.ndarray, k: int, bound: float, exact: bool) -> list[tuple[int, int]]:
        """The k best (score, id) among those of at least `bound`, other than the query's own."""
        length = float(np.sqrt((q.astype(float) ** 2).sum())) * (1 + 1e-9)
        limits = self.centres @ q.astype(float)
        limits = limits + length * self.radii + 1e-9 * np.abs(limits) + 1e-6
        best: list[tuple[int, int]] = []  # heap of (score, -id): the worst first
        queue = [(-limits[0], 0)]
        while queue:
            limit, node = heapq.heappop(queue)
            if -limit < (max(bound, best[0][0]) if len(best) == k else bound):
                break
            if self.children[node]:
                for child in self.children[node]:
                    heapq.heappush(queue, (-limits[child], child))
                continue
            a, b = self.spans[node]
            rows = self.rows[a:b]
            scores = (rows @ q).astype(np.int64).tolist() if exact else [min(max(sum(x * y for x, y in zip(map(int, r), map(int, q))), LONG[0]), LONG[1]) for r in rows]
            for score, vec in zip(scores, self.ids[a:b].tolist()):
                if vec != query_id and score >= bound:
                    if len(best) < k:
                        heapq.heappush(best, (score, -vec))
                    elif (score, -vec) > best[0]:
                        heapq.heapreplace(best, (score, -vec))
        return [(s, -v) for s, v in best]


def scaled(vectors: DataFrame, vec: str, embedding: str) -> DataFrame:
    """vec_id, dim, x: integer components (as doubles), one row per id."""
    x = F.col(embedding).cast("array<double>")
    fine = F.col(embedding).isNotNull() & F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < F.lit(float("inf"))))
    # Scaled by a power of two the product is exact; floor() of a double would be cut to a long.
    whole = F.transform(x, lambda v: F.when(F.abs(v * SCALE) < F.lit(2.0 ** 53), F.floor(v * SCALE).cast("double")).otherwise(v * SCALE))
    return vectors.where(F.col(vec).isNotNull() & F.coalesce(fine, F.lit(False))).select(F.col(vec).cast("long").alias("vec_id"), whole.alias("x")) \
        .groupBy("vec_id").agg(F.min("x").alias("x")).withColumn("dim", F.size("x"))


def _matrix(column: pa.ChunkedArray, dim: int) -> np.ndarray:
    return column.combine_chunks().flatten().to_numpy().reshape(-1, dim)


def nearest(vectors: DataFrame, is_query: Column, *, vec: str = "vec_id", embedding: str = "embedding", k: int = K,
            shard_rows: int = SHARD_ROWS, query_block: int = QUERY_BLOCK, wave: int = WAVE) -> DataFrame:
    """query_id, rank, vec_id, score: the k largest inner products of each query. `is_query`: expression over vec_id."""
    stages = Stages(vectors.sparkSession)
    rows = stages.keep(scaled(vectors, vec, embedding), "scaled")
    dims = {r["dim"]: r["n"] for r in rows.groupBy("dim").agg(F.count("*").alias("n")).collect()}  # as many as lengths
    shards = {d: -(-n // shard_rows) for d, n in dims.items()}
    count = F.coalesce(*[F.when(F.col("dim") == d, F.lit(s)) for d, s in shards.items()], F.lit(1))
    dealt = rows.withColumn("shard", F.pmod(F.xxhash64("vec_id"), count))
    queries = rows.where(is_query)
    asked = {r["dim"]: r["n"] for r in queries.groupBy("dim").agg(F.count("*").alias("n")).collect()}
    parts = F.coalesce(*[F.when(F.col("dim") == d, F.lit(-(-n // query_block))) for d, n in asked.items()], F.lit(1))
    packed = queries.withColumn("part", F.pmod(F.xxhash64(F.lit(1), "vec_id"), parts)).withColumn("shards", count)

    def search(table: pa.Table, ask: pa.Table) -> pa.Table:
        out: dict[str, list] = {"query_id": [], "vec_id": [], "score": []}
        if len(table) and len(ask):
            dim = table.column("dim")[0].as_py()
            matrix = _matrix(table.column("x"), dim) if dim else np.zeros((len(table), 0))
            tree = BallTree(table.column("vec_id").to_numpy(), matrix)
            tree.arrays()
            for ids, bounds, flat in zip(ask.column("ids").to_pylist(), ask.column("bounds").to_pylist(), ask.column("flat").to_pylist()):
                asking = np.array(flat, float).reshape(len(ids), dim)
                peak = np.abs(matrix).max(initial=0) * np.abs(asking).max(initial=0) * max(dim, 1)
                for query, bound, q in zip(ids, bounds, asking):
                    for score, vec_id in tree.search(query, q, k, -np.inf if bound is None else bound, peak < 2 ** 53):
                        out["query_id"].append(query)
                        out["vec_id"].append(vec_id)
                        out["score"].append(score)
        return pa.table({name: pa.array(values, pa.int64()) for name, values in out.items()})

    def searched(asking: DataFrame) -> DataFrame:
        """asking: dim, shard, part, vec_id, x, bound."""
        rows_of = F.array_sort(F.collect_list(F.struct("vec_id", "bound", "x")))  # at most about query_block
        blocks = asking.groupBy("dim", "shard", "part").agg(rows_of.alias("q")).select(
            F.col("dim").alias("q_dim"), F.col("shard").alias("q_shard"), F.col("q.vec_id").alias("ids"), F.col("q.bound").alias("bounds"), F.flatten("q.x").alias("flat"))
        return dealt.groupBy("dim", "shard").cogroup(blocks.groupBy("q_dim", "q_shard")).applyInArrow(search, "query_id long, vec_id long, score long")

    first = packed.withColumn("shard", F.pmod(F.xxhash64("vec_id"), F.col("shards"))).withColumn("bound", F.lit(None).cast("double"))
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    ranked = lambda rows: rows.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)
    found, done, most = stages.keep(searched(first), "home"), 1, max(shards.values(), default=1)
    while done < most:  # distances from the home shard, on a ring
        until = min(done * wave, most)
        bounds = found.groupBy("query_id").agg(F.count("*").alias("n"), F.min("score").alias("least"))
        known = first.drop("bound").join(bounds, first["vec_id"] == bounds["query_id"], "left") \
            .withColumn("bound", F.when(F.col("n") >= k, F.col("least").cast("double")))
        asking = known.withColumn("away", F.explode(F.sequence(F.lit(done), F.lit(until - 1)))).where(F.col("away") < F.col("shards")) \
            .withColumn("shard", F.pmod(F.col("shard") + F.col("away"), F.col("shards"))).select("dim", "shard", "part", "vec_id", "x", "bound")
        found = stages.keep(ranked(found.unionByName(searched(asking))).drop("rank"), f"wave-{done}")
        done = until
    return ranked(found).select("query_id", "rank", "vec_id", "score")
