"""Connected components of an edge table by alternating minimum steps.

Each round every vertex learns the least vertex among itself and its
neighbours; edges move to the least one, first from the larger ends, then from
the smaller ends, until the edges are stars. Rounds grow with the logarithm of
the longest path. A hub's edges are summed map-side (`min`), and only vertices
that have edges take part. Each round is a written table, so a lost executor
costs one round.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from plumbline.session import written

MOST_ROUNDS = 60


def _large_star(edges: DataFrame) -> DataFrame:
    """Link each vertex's larger neighbours to the least vertex around it."""
    both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("m"))
    return both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where(
        "a <> b").distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    """Link each vertex's smaller neighbours, and itself, to the least of them."""
    down = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    least = down.groupBy("a").agg(F.min("b").alias("m"))
    moved = down.join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
    own = least.select("a", F.col("m").alias("b"))
    return moved.unionByName(own).where("a <> b").distinct()


def components(edges: DataFrame) -> DataFrame:
    """(vertex, component): the least vertex reachable, for every vertex with an edge."""
    now = written(edges.select("a", "b").where("a <> b").distinct())
    mark = None
    for _ in range(MOST_ROUNDS):
        now = written(_small_star(_large_star(now)))
        state = now.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if state == mark:
            break
        mark = state
    else:
        raise RuntimeError(f"components did not settle in {MOST_ROUNDS} rounds")
    leaves = now.select(F.col("a").alias("vertex"), F.col("b").alias("component"))
    return leaves.unionByName(now.select(F.col("b").alias("vertex"), F.col("b").alias("component")).distinct())
