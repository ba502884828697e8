"""Connected components of undirected edges between long ids, without collecting any of them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut


def connected_components(edges: DataFrame, a: str = "a", b: str = "b", rounds: int = 200) -> DataFrame:
    """(id, root) of every id in ``edges``; ``root`` is the smallest id of its component, itself
    included. Rows with a null end and loops count for nothing.

    Alternates large-star and small-star steps, each of which keeps the components and brings the
    edges nearer to stars around the smallest ids; the number of steps grows with the logarithm of
    the longest chain. A step is an aggregate with partial sums and a join that Spark may split, so
    an id with very many neighbours isn't held by one task. Each step's edges are written to the
    shared folder. Ids are compared as signed numbers."""
    e = edges.where(F.col(a) != F.col(b)).select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).distinct()
    e, before = cut(e), None
    for _ in range(rounds):
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        lowest = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.where("v > u").join(lowest, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u != v").distinct()
        # in large every u is above its v; a small-star step joins all of u's lower neighbours and u to the lowest
        lowest = large.groupBy("u").agg(F.min("v").alias("m"))
        pairs = large.join(lowest, "u")
        small = pairs.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(lowest.select("u", F.col("m").alias("v"))).where("u != v").distinct()
        e = cut(small)
        state = e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if state == before:
            break
        before = state
    else:
        raise RuntimeError(f"components didn't settle in {rounds} rounds")
    roots = e.groupBy(F.col("u").alias("id")).agg(F.min("v").alias("root"))
    return roots.unionByName(e.select(F.col("v").alias("id"), F.col("v").alias("root")).distinct())
