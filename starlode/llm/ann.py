"""Operator 5: nearest neighbours by inner product with vantage-point trees, one per shard.

A largest inner product is made a smallest distance: with M the largest norm, a vector x gets one
more coordinate, sqrt(M^2 - |x|^2), and a query 0; then |q - x|^2 = |q|^2 + M^2 - 2 q.x. In that
space each shard has a vantage-point tree. A node's ball of radius r around its point p splits its
rows; a query at distance d from p whose k-th best distance so far is t must enter the inner side
only if d - r <= t and the outer one only if r - d <= t. These tests are relaxed by ``factor``: the
bound is factor * t. Factor 1 is exact; smaller factors skip more and may miss neighbours.

Shards. Vectors are assigned to the nearest of at most ``pivots`` pivots, a sample by hash of ids;
a pivot with many rows is split by hash into shards of about ``shard_rows`` rows, so a frequent
vector (or a third of all rows around one pivot) is spread over many shards. A query first searches
its own pivot's shards; the k-th best score found then prunes whole pivots by the same test on their
radius, and the query goes only to the rest. Blocks of at most about ``group`` queries meet shards as
groups of a shuffle; a task holds the rows of a shard and one such block. The pivot
table (at most ``pivots`` rows) is the only thing that every task holds.

Scores are computed on the vectors as stored, in double precision, in an order that depends on the
length alone, so equal vectors have equal scores and ties go to smaller ids. A matrix product, whose
order is the library's, only rules out what is worse than the k-th best by more than its rounding.

Work. How much is pruned depends on the data. Vectors that point anywhere, such as the 64 random
coordinates of the test tables, leave nothing to prune: the exact search meets nearly all shards, and its
work grows with queries times rows. Figures by ``factor`` are in the README.

Defined results: vectors that are null, zero, or hold a null or non-finite component take no part,
nor do rows without an id or vectors of another length than the most frequent one; a repeated id is
as many candidates as it has rows, and a query with several vectors gets the best of all of them; a
query with fewer candidates than k gets all; other columns are ignored; an empty table gives an empty
result.
"""

from __future__ import annotations

from collections.abc import Iterable

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import cut

LEAF = 256
ROUNDING = 1e-11  # of the product of two lengths: far above the error of a double inner product
NOBODY = np.iinfo(np.int64).max


def usable(vector: Column) -> Column:
    finite = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf"))
    return vector.isNotNull() & F.forall(vector, finite) & F.exists(vector, lambda x: x != 0)


def dots(q: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Inner products of the rows of both; each sum's order depends on the length alone."""
    out = np.empty(len(q))
    for at in range(0, len(q), 4096):
        np.multiply(q[at : at + 4096], x[at : at + 4096]).sum(axis=1, out=out[at : at + 4096])
    return out


class Best:
    """The k best of each query so far: higher scores, then smaller ids."""

    def __init__(self, n: int, k: int):
        self.k, self.scores, self.ids = k, np.full((n, k), -np.inf), np.full((n, k), NOBODY)

    def add(self, rows: np.ndarray, scores: np.ndarray, ids: np.ndarray) -> None:
        s = np.concatenate([self.scores[rows], scores], axis=1)
        i = np.concatenate([self.ids[rows], np.where(scores > -np.inf, ids, NOBODY)], axis=1)
        order = np.lexsort((i, -s), axis=1)[:, : self.k]
        self.scores[rows], self.ids[rows] = np.take_along_axis(s, order, 1), np.take_along_axis(i, order, 1)


class VantageTree:
    def __init__(self, ids: np.ndarray, vectors: np.ndarray, norm: float):
        self.ids, self.x, self.norm2 = ids, vectors, norm * norm
        self.lift = np.sqrt(np.maximum(0.0, self.norm2 - (vectors * vectors).sum(axis=1)))
        self.root = self._node(np.arange(len(ids)))

    def _node(self, rows: np.ndarray):
        if len(rows) <= LEAF:
            return rows
        p = rows[len(rows) // 2]
        gap = self.x[rows] - self.x[p]
        d = np.sqrt((gap * gap).sum(axis=1) + (self.lift[rows] - self.lift[p]) ** 2)
        radius = float(np.median(d))
        inner = d <= radius
        if inner.all():  # many at one distance, such as copies
            inner = d < radius
            if not inner.any():
                return rows
            radius = float(d[inner].max())
        return p, radius, self._node(rows[inner]), self._node(rows[~inner])

    def search(self, queries: np.ndarray, own: np.ndarray, best: Best, factor: float) -> None:
        """Adds the rows that ``queries`` may have among their best; ``own``: an id that each skips."""
        q2 = (queries * queries).sum(axis=1)

        def reach(active: np.ndarray) -> np.ndarray:
            return factor * np.sqrt(np.maximum(0.0, q2[active] + self.norm2 - 2 * best.scores[active, -1])) * (1 + 1e-12) + 1e-9

        def visit(node, active: np.ndarray) -> None:
            if not len(active):
                return
            if isinstance(node, np.ndarray):
                for at in range(0, len(node), 1024):
                    rows = node[at : at + 1024]
                    near = queries[active] @ self.x[rows].T
                    slack = ROUNDING * np.sqrt(q2[active] * self.norm2)
                    i, j = np.nonzero((near >= (best.scores[active, -1] - slack)[:, None]) & (own[active][:, None] != self.ids[rows][None, :]))
                    if not len(i):
                        continue
                    some, first, n = np.unique(i, return_index=True, return_counts=True)
                    scores, ids = np.full((len(some), n.max()), -np.inf), np.full((len(some), n.max()), NOBODY)
                    place = np.repeat(np.arange(len(some)), n), np.arange(len(i)) - np.repeat(first, n)
                    scores[place], ids[place] = dots(queries[active[i]], self.x[rows[j]]), self.ids[rows[j]]
                    best.add(active[some], scores, ids)
                return
            p, radius, inner, outer = node
            d = np.sqrt(np.maximum(0.0, q2[active] + self.norm2 - 2 * (queries[active] @ self.x[p])))
            near = d <= radius
            for first, second, some in ((inner, outer, near), (outer, inner, ~near)):
                visit(first, active[some])
                visit(second, active[some][np.abs(d[some] - radius) <= reach(active[some])])

        visit(self.root, np.arange(len(queries)))


def _matrix(column: pd.Series) -> np.ndarray:
    return np.stack(column.to_list()).astype(np.float64) if len(column) else np.empty((0, 1))


def search(
    df: DataFrame, queries: Column, key: str = "vec_id", vector: str = "embedding", k: int = 20, factor: float = 1.0,
    pivots: int = 256, shard_rows: int = 4_000, block: int = 1_000, group: int = 20_000,
) -> DataFrame:
    """query_id, rank (from 1), vec_id and score of each query's nearest rows. ``queries``: a condition
    on ``df`` that chooses the rows that are queries."""
    rows = df.select(F.col(key).cast("long").alias("id"), F.col(vector).alias("v"), F.coalesce(queries, F.lit(False)).alias("asks")).where(F.col("id").isNotNull() & usable(F.col("v")))
    square = F.aggregate("v", F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double"))
    common = rows.groupBy(F.size("v").alias("n")).agg(F.count("*").alias("c"), F.sqrt(F.max(square)).alias("norm")).orderBy(F.desc("c"), "n").limit(1).collect()
    if not common:
        return df.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    rows = rows.where(F.size("v") == common[0]["n"])
    total, norm = common[0]["c"], common[0]["norm"]
    want = min(pivots, max(1, total // shard_rows * 2))
    # ids' hashes choose: the least of each task meet, no vector moves otherwise; copies are one pivot
    sample = rows.select("v", F.xxhash64("id").alias("h"), "id").orderBy("h", "id").limit(4 * want).collect()
    centres = np.array(list(dict.fromkeys(tuple(r["v"]) for r in sample))[:want], dtype=np.float64)
    lifted = np.c_[centres, np.sqrt(np.maximum(0.0, norm * norm - (centres * centres).sum(axis=1)))]

    def assign(batches: Iterable[pa.RecordBatch]) -> Iterable[pa.RecordBatch]:
        for b in batches:
            x = np.stack(b.column(1).to_pylist()).astype(np.float64) if len(b) else np.empty((0, centres.shape[1]))
            up = np.c_[x, np.sqrt(np.maximum(0.0, norm * norm - (x * x).sum(axis=1)))]
            d2 = (up * up).sum(axis=1)[:, None] + (lifted * lifted).sum(axis=1)[None, :] - 2 * up @ lifted.T
            home = d2.argmin(axis=1)
            far = np.sqrt(((up - lifted[home]) ** 2).sum(axis=1))
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(home.astype(np.int32)), pa.array(far)], names=["id", "v", "asks", "pivot", "far"])

    assigned = cut(rows.mapInArrow(assign, f"id long, v {df.schema[vector].dataType.simpleString()}, asks boolean, pivot int, far double"))
    sizes = {r[0]: (r[1], r[2]) for r in assigned.groupBy("pivot").agg(F.count("*"), F.max("far")).collect()}  # at most `pivots` rows
    parts = [max(1, -(-sizes.get(p, (0, 0))[0] // shard_rows)) for p in range(len(centres))]
    radius = np.array([sizes.get(p, (0, -np.inf))[1] for p in range(len(centres))])
    n_parts = F.element_at(F.array(*map(F.lit, parts)), F.col("pivot") + 1)
    # ids repeat for copies only if the input repeats them; the shard depends on the id, not on the vector
    shards = assigned.select("pivot", F.pmod(F.xxhash64("id"), n_parts).cast("int").alias("part"), "id", "v")
    asking = assigned.where("asks").select("id", "v", "pivot").dropDuplicates(["id", "v"])

    def local(shard: pd.DataFrame, asked: pd.DataFrame) -> pd.DataFrame:
        none = pd.DataFrame({"query_id": pd.Series(dtype="int64"), "vec_id": pd.Series(dtype="int64"), "score": pd.Series(dtype="float64")})
        if not len(shard) or not len(asked):
            return none
        shard = shard.sort_values("id", kind="stable")
        tree, out = VantageTree(shard["id"].to_numpy(), _matrix(shard["v"]), norm), [none]
        for at in range(0, len(asked), block):
            some = asked.iloc[at : at + block]
            best, own = Best(len(some), k), some["id"].to_numpy()
            # k rows as good as the floor are known from other shards: what is worse can't be among the best
            best.scores[:] = some["floor"].to_numpy()[:, None]
            tree.search(_matrix(some["v"]), own, best, factor)
            q, j = np.nonzero(best.ids != NOBODY)
            out.append(pd.DataFrame({"query_id": own[q], "vec_id": best.ids[q, j], "score": best.scores[q, j]}))
        return pd.concat(out, ignore_index=True)

    found = "query_id long, vec_id long, score double"

    def met(targets: DataFrame) -> DataFrame:
        """Each shard of a target pivot with each block of the queries that go there."""
        targets = cut(targets.select("pivot", "id", "v", "floor"))
        asked = {r[0]: -(-r[1] // group) for r in targets.groupBy("pivot").agg(F.count("*")).collect()}  # at most `pivots` rows
        n_blocks = F.element_at(F.array(*(F.lit(asked.get(p, 0)) for p in range(len(centres)))), F.col("pivot") + 1)
        blocks = targets.select("pivot", F.explode(F.sequence(F.lit(0), n_parts - 1)).alias("part"), F.pmod(F.xxhash64("id", F.lit("block")), n_blocks).cast("int").alias("block"), "id", "v", "floor")
        copies = shards.where(n_blocks > 0).select("pivot", "part", F.explode(F.sequence(F.lit(0), n_blocks - 1)).alias("block"), "id", "v")
        return copies.groupBy("pivot", "part", "block").cogroup(blocks.groupBy("pivot", "part", "block")).applyInPandas(local, found)

    home = cut(met(asking.withColumn("floor", F.lit(float("-inf")))))
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    kth = home.withColumn("rank", F.row_number().over(order)).where(F.col("rank") == k).select(F.col("query_id").alias("id"), F.col("score").alias("floor"))
    known = asking.withColumnRenamed("pivot", "home").join(kth, "id", "left").select("id", "v", "home", F.coalesce("floor", F.lit(float("-inf"))).alias("floor"))

    def route(batches: Iterable[pa.RecordBatch]) -> Iterable[pa.RecordBatch]:
        for b in batches:
            q = np.stack(b.column(1).to_pylist()).astype(np.float64) if len(b) else np.empty((0, centres.shape[1]))
            floor, q2 = b.column(3).to_numpy(), (q * q).sum(axis=1)
            d = np.sqrt(np.maximum(0.0, q2[:, None] + (lifted * lifted).sum(axis=1)[None, :] - 2 * q @ centres.T))
            bound = factor * np.sqrt(np.maximum(0.0, q2 + norm * norm - 2 * floor)) * (1 + 1e-9) + 1e-7
            go = (d - radius[None, :] <= bound[:, None]) & (radius[None, :] >= 0)
            go[np.arange(len(q)), b.column(2).to_numpy()] = False
            i, p = np.nonzero(go)
            rows = pa.array(i)
            yield pa.RecordBatch.from_arrays([b.column(0).take(rows), b.column(1).take(rows), pa.array(p.astype(np.int32)), b.column(3).take(rows)], names=["id", "v", "pivot", "floor"])

    away = met(known.select("id", "v", "home", "floor").mapInArrow(route, f"id long, v {df.schema[vector].dataType.simpleString()}, pivot int, floor double"))
    best = home.unionByName(away).withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return best.select("query_id", "rank", "vec_id", "score")
