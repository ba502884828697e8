import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from starlode.llm import ann
from starlode.llm.queries import op5_neighbours


def brute(rows, k=20, every=20):
    """Exactly rounded inner products, all candidates."""
    good = [(i, v) for i, v in rows if i is not None and v and all(x is not None and math.isfinite(x) for x in v) and any(v)]
    out = set()
    for q, v in good:
        if q % every == 0:
            scored = sorted((-sum(np.float64(a) * np.float64(b) for a, b in zip(v, w)), i) for i, w in good if i != q)
            out |= {(q, r, i) for r, (_, i) in enumerate(scored[:k], 1)}
    return out


def same(got, want, rows):
    """Equal but where the order of sums decides between scores that differ in the last bits."""
    vectors = {i: np.array(v, dtype=np.float64) for i, v in rows if v}
    assert len(got) == len(want)
    best = {(q, r): i for q, r, i in want}
    for x in got:
        i = best[x.query_id, x.rank]
        dot = lambda j: float(vectors[x.query_id] @ vectors[j])
        assert x.vec_id == i or abs(dot(i) - dot(x.vec_id)) < 1e-9
        assert x.score == pytest.approx(dot(x.vec_id), abs=1e-9)


def test_query_equals_brute_force(spark, sf):
    rows = [(r.vec_id, list(r.embedding)) for r in spark.read.parquet(f"{sf}/embeddings.parquet").collect()]
    same(op5_neighbours(spark, sf).collect(), brute(rows), rows)


@pytest.mark.parametrize("shard_rows,pivots", [(50, 16), (10_000, 4)])
def test_clusters_copies_and_many_shards(spark, shard_rows, pivots):
    rng = np.random.default_rng(2)
    centres = rng.standard_normal((6, 8)) * 4
    v = np.concatenate([centres[rng.integers(0, 6, 700)] + rng.standard_normal((700, 8)) * 0.3, np.repeat(centres[:1], 350, axis=0)])
    rows = [(int(i), x) for i, x in zip(rng.permutation(len(v)), np.round(v * 4).tolist())]  # whole numbers: scores are exact, with many ties
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").repartition(4)
    got = ann.search(df, F.col("vec_id") % 20 == 0, shard_rows=shard_rows, pivots=pivots, block=7, group=20)
    assert {(x.query_id, x.rank, x.vec_id) for x in got.collect()} == brute(rows)


def test_factor_trades_recall_for_work(spark):
    rng = np.random.default_rng(4)
    x = rng.standard_normal((3000, 6))
    ids, norm = np.arange(len(x)), float(np.sqrt((x * x).sum(axis=1).max()))
    tree, queries = ann.VantageTree(ids, x, norm), x[:60]
    exact = np.argsort(-(queries @ x.T) + np.where(ids[None] == ids[:60, None], np.inf, 0), axis=1)[:, :20]
    recall = []
    for factor in (1.0, 0.6, 0.2):
        best = ann.Best(60, 20)
        tree.search(queries, ids[:60], best, factor)
        recall.append(np.mean([len(set(a) & set(b)) / 20 for a, b in zip(best.ids, exact)]))
    assert recall[0] == 1.0 and recall[0] >= recall[1] >= recall[2] and recall[1] > 0.5


def test_odd_rows(spark):
    rows = [(0, [1.0, 0.0]), (20, [1.0, 0.0]), (20, [0.0, 3.0]), (40, None), (60, [0.0, 0.0]), (80, [float("nan"), 1.0]), (100, [float("inf"), 1.0]), (120, [None, 1.0]), (140, [1.0]), (160, []), (None, [5.0, 5.0]), (1, [2.0, 0.0]), (2, [2.0, 0.0]), (3, [-1.0, 0.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").select("*", *(F.lit(7).alias(c) for c in ("id", "v", "asks", "pivot", "score", "rank", "query_id", "label")))
    got = [tuple(r) for r in ann.search(df, F.col("vec_id") % 20 == 0, k=4).orderBy("query_id", "rank").collect()]
    assert got == [(0, 1, 1, 2.0), (0, 2, 2, 2.0), (0, 3, 20, 1.0), (0, 4, 20, 0.0), (20, 1, 1, 2.0), (20, 2, 2, 2.0), (20, 3, 0, 1.0), (20, 4, 0, 0.0)]
    assert all(g[2] not in (g[0], 40, 60, 80, 100, 120, 140, 160) for g in got)
    assert ann.search(df.limit(0), F.lit(True)).columns == ["query_id", "rank", "vec_id", "score"]
    assert ann.search(df.limit(0), F.lit(True)).count() == 0
    assert ann.search(df.where("vec_id = 40"), F.lit(True)).count() == 0
    one = df.where("vec_id = 0")
    assert ann.search(one, F.lit(True)).count() == 0


def test_sums_depend_on_the_length_alone():
    rng = np.random.default_rng(1)
    x = rng.standard_normal((500, 33))
    q = np.repeat(np.arange(40), len(x))
    whole = ann.dots(x[q], x[np.tile(np.arange(len(x)), 40)]).reshape(40, -1)
    assert all(ann.dots(x[i : i + 1], x[j : j + 1])[0] == whole[i, j] for i in range(0, 40, 7) for j in range(0, 500, 31))
