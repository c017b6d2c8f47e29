"""Connected components by alternating large-star and small-star, as joins and aggregations.

Neighbour lists are never gathered: a star operation is the least neighbour of each node (an aggregation with partial
sums in each task) joined back to its edges. So a node with a third of all edges is neither one task nor one row.

Defined cases: links of a node with itself, repeated links and links with a null end change nothing; ties can't occur, as
ids are distinct; no links give no rows. Extra columns of the links are ignored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, drop_cut


#: Edges up to which a round is one task.
FEW_EDGES = 200_000


def _large_star(edges: DataFrame) -> DataFrame:
    """For each u with least neighbour m (u itself included): (v, m) for its neighbours v > u."""
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("x"), F.least("u", "m").alias("m"))
    return both.where("v > u").join(least, F.col("u") == F.col("x")).select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    """For each u with least smaller neighbour m: (v, m) for its smaller neighbours v and for u."""
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = down.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("x"), "m")
    near = down.join(least, F.col("u") == F.col("x")).select(F.col("v").alias("u"), F.col("m").alias("v"))
    return near.unionByName(least.select(F.col("x").alias("u"), F.col("m").alias("v"))).where("u <> v").distinct()


def _all_stars(edges: DataFrame) -> bool:
    """Whether every u has one v, and no v is a u: then both stars change nothing."""
    ends = edges.select(F.col("u").alias("x"), F.lit(1).alias("as_u"), F.lit(0).alias("as_v")).unionByName(edges.select(F.col("v").alias("x"), F.lit(0).alias("as_u"), F.lit(1).alias("as_v")))
    return ends.groupBy("x").agg(F.sum("as_u").alias("u"), F.max("as_v").alias("v")).where("u > 1 or (u > 0 and v > 0)").isEmpty()


def components(edges: DataFrame) -> DataFrame:
    """id, component (the least id reachable) for every node of edges(u, v) that isn't the least of its component."""
    now = cut(edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "cc")
    # up to so many edges, counted, one task does a round without a shuffle; the stars never have more edges
    few = now.count() <= FEW_EDGES
    near = lambda df: df.coalesce(1) if few else df
    while not _all_stars(near(now)):
        large = cut(_large_star(near(now)), "cc")
        after = cut(_small_star(near(large)), "cc")
        drop_cut(now)
        drop_cut(large)
        now = after
    return now.select(F.col("u").alias("id"), F.col("v").alias("component"))
