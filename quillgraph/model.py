"""Graphs as two DataFrames, vertices(id) and edges(src, dst), with LONG ids."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

VERTICES = T.StructType([T.StructField("id", T.LongType())])
EDGES = T.StructType([T.StructField("src", T.LongType()), T.StructField("dst", T.LongType())])


@dataclass(frozen=True)
class Graph:
    """Isolated vertices are in `vertices`; parallel edges and self-loops may be in `edges`. symmetric: every edge has its reverse."""

    vertices: DataFrame
    edges: DataFrame
    symmetric: bool = False

    @staticmethod
    def of(edges: DataFrame, vertices: DataFrame | None = None, symmetric: bool = False) -> Graph:
        edges = edges.select(F.col("src").cast("long").alias("src"), F.col("dst").cast("long").alias("dst"))
        if vertices is None:
            vertices = edges.select(F.col("src").alias("id")).union(edges.select("dst")).distinct()
        return Graph(vertices.select(F.col("id").cast("long").alias("id")), edges, symmetric)

    def where(self, predicate: Column) -> Graph:
        """The graph with the edges that meet a predicate on src and dst; Spark pushes it down to the scan where it can."""
        return Graph(self.vertices, self.edges.where(predicate), self.symmetric)

    def reach(self, sources: DataFrame, direction: str = "out") -> DataFrame:
        """id: what sources(id) reach."""
        from .operators import traverse

        return traverse.reach(self.edges, sources, direction)

    def bfs(self, sources: DataFrame, direction: str = "out") -> DataFrame:
        """id, dist from the nearest of sources(id)."""
        from .operators import traverse

        return traverse.bfs(self.edges, sources, direction)

    def multi_reach(self, sources: DataFrame, part: DataFrame | None = None, direction: str = "out") -> DataFrame:
        """id, label: the pairs of a vertex and each of sources(id) that reaches it."""
        from .operators import traverse

        return traverse.multi_reach(self.edges, sources, part, direction)

    def scc(self) -> DataFrame:
        """id, comp: strongly connected components."""
        from .operators import scc

        return scc.scc(self)

    def connected_components(self) -> DataFrame:
        """id, comp: components, edges taken in both directions."""
        from .operators import cc

        return cc.connected_components(self)

    def spanning_forest(self) -> DataFrame:
        """src, dst of a forest that spans each component."""
        from .operators import cc

        return cc.spanning_forest(self)

    def ldd(self, beta: float = 0.2) -> DataFrame:
        """id, center, parent: low-diameter decomposition; edges must be symmetric."""
        from .operators import decompose

        return decompose.ldd(self, beta)

    def le_lists(self) -> DataFrame:
        """target, source, dist: least-element lists; edges must be symmetric."""
        from .operators import decompose

        return decompose.le_lists(self)

    def validate(self) -> DataFrame:
        """dangling: edges with an end that is no vertex; asymmetric: edges without their reverse; duplicates: repeated ids; nulls: edges or ids with a null."""
        ids = self.vertices.select("id").distinct()
        e = self.edges
        lost = lambda c: e.join(ids, e[c] == ids["id"], "left_anti").agg(F.count("*").alias(f"dangling_{c}"))
        back = e.select(F.col("src").alias("b"), F.col("dst").alias("a")).distinct()
        one = e.join(back, (e["src"] == back["a"]) & (e["dst"] == back["b"]), "left_anti").agg(F.count("*").alias("asymmetric"))
        dup = self.vertices.agg((F.count("id") - F.count_distinct("id")).alias("duplicates"))
        nulls = e.where("src is null or dst is null").agg(F.count("*").alias("nulls"))
        out = lost("src")
        for x in (lost("dst"), one, dup, nulls):
            out = out.join(x, F.lit(True))
        return out


def densify_ids(keys: DataFrame, key: str) -> DataFrame:
    """key and id, 0 to n-1 in the order of the distinct keys. Numbered within range partitions, whose sizes are then added up, so no task sees all keys."""
    from pyspark.sql import Window as W

    parted = keys.select(key).distinct().repartitionByRange(key).select(key, F.spark_partition_id().alias("_p"))
    from .plans.loop import cut

    parted = cut(parted)
    local = F.row_number().over(W.partitionBy("_p").orderBy(key))
    sizes = parted.groupBy("_p").agg(F.count("*").alias("_n"))
    before = F.coalesce(F.sum("_n").over(W.orderBy("_p").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))  # one row for each partition
    offset = sizes.select(F.col("_p").alias("_q"), before.alias("_before"))
    return parted.withColumn("_i", local).join(F.broadcast(offset), F.col("_p") == F.col("_q")).select(key, (F.col("_before") + F.col("_i") - 1).cast("long").alias("id"))
