"""Connected components over an edge table, by large-star and small-star rounds.

Each round is two grouped minima and two joins over the edges; the result of a
round is written to the shared folder, so lineage stays short and a lost
executor costs one round at most.  Minima are combined before the shuffle, and
joins on a hot node can be split by adaptive execution.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import saved


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """Rows (u, v): neighbours of u move to u's least neighbour (large: those above u; small: those below, and u)."""
    if large:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    else:
        both = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    moved = both.join(least, "u").filter(F.col("v") > F.col("u") if large else F.col("v") != F.col("m"))
    out = moved.select(F.col("v").alias("u"), F.col("m").alias("v"))
    if not large:
        out = out.unionByName(least.select("u", F.col("m").alias("v")))
    return out.filter("u != v").distinct()


def _state(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())


def components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """Edges (u, v), both long -> (node, root): root is the least node reachable; nodes without an edge are absent."""
    now = saved(edges.select(F.col("u").cast("long"), F.col("v").cast("long")).filter("u != v").distinct(), "edges")
    state = _state(now)
    for _ in range(max_rounds):
        now = saved(_star(_star(now, True), False), "edges")
        state, last = _state(now), state
        if state == last:
            break
    else:
        raise RuntimeError("components did not settle")
    return now.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(
        now.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
