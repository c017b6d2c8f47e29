"""Building graphs: directions, degrees, trimming, subgraphs, CSR offsets."""

from __future__ import annotations

from contextlib import ExitStack

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..functions.priority import scramble
from ..model import Graph
from ..plans.loop import BROADCAST_ROWS, FAR, HOPS, by_source, counted, cut, observed


def transpose(edges: DataFrame) -> DataFrame:
    """Reversed edges; parallel ones and self-loops stay."""
    return edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"))


def symmetrize(edges: DataFrame) -> DataFrame:
    """Both directions of each edge once, without self-loops."""
    return edges.unionByName(transpose(edges)).where("src <> dst").distinct()


def out_degree(g: Graph) -> DataFrame:
    return _degree(g, "src")


def in_degree(g: Graph) -> DataFrame:
    return _degree(g, "dst")


def _degree(g: Graph, end: str) -> DataFrame:
    n = g.edges.groupBy(F.col(end).alias("v")).agg(F.count("*").alias("n"))
    return g.vertices.join(n, F.col("id") == F.col("v"), "left").select("id", F.coalesce("n", F.lit(0)).alias("degree"))


def core(g: Graph) -> DataFrame:
    """Vertices with edges in and out."""
    src, dst = g.edges.select(F.col("src").alias("s")).distinct(), g.edges.select(F.col("dst").alias("d")).distinct()
    return g.vertices.join(src, F.col("id") == F.col("s"), "left_semi").join(dst, F.col("id") == F.col("d"), "left_semi")


def trim(g: Graph, iterate: bool = False) -> tuple[DataFrame, Graph]:
    """Vertices without edges in or without edges out, and the graph of the others. With iterate, until there are none left to take."""
    edges = g.edges.where("src <> dst") if iterate else g.edges
    rest = Graph(g.vertices, edges, g.symmetric)
    if not iterate:
        keep = core(rest)
        return g.vertices.join(keep.withColumnRenamed("id", "k"), F.col("id") == F.col("k"), "left_anti"), subgraph(rest, keep)
    ids = g.vertices.select("id").distinct()
    inner, seen = counted(subgraph(Graph(ids, edges), ids).edges, n=F.count("*"))
    keep = endless(inner, seen["n"])
    gone = g.vertices.join(keep.withColumnRenamed("id", "k"), F.col("id") == F.col("k"), "left_anti")
    return gone, Graph(keep, cut(subgraph(Graph(keep, inner), keep).edges), g.symmetric)


def both_ways(edges: DataFrame) -> DataFrame:
    """src, dst, back: edges, and reversed ones as the other side."""
    return edges.select("src", "dst", F.lit(False).alias("back")).unionByName(transpose(edges).withColumn("back", F.lit(True)))


def endless(edges: DataFrame, rows: int) -> DataFrame:
    """id: the vertices at which walks of any length end and at which such walks begin, which is what iterated trimming leaves.

    What ends a walk of k + 1 edges also ends one of k, so these sets only shrink, and the first that a further edge leaves
    as it is stays so. A job goes 4, 8, then 16 edges on from all that is left, counts its last two sets, and does so along
    the edges and against them until each way is done. rows: how many edges there are; few aren't dealt by their source."""
    ways = {"out": edges, "in": transpose(edges)}
    left: dict[str, DataFrame] = {}
    with ExitStack() as stack:
        kept = {way: F.broadcast(e) if rows <= BROADCAST_ROWS else stack.enter_context(by_source(e)) for way, e in ways.items()}
        hops = HOPS
        ends = {way: kept[way].select(F.col("dst").alias("id")).distinct() for way in kept}
        while ends:
            before = {way: Observation() for way in ends}
            for way in ends:
                for k in range(hops):
                    if k == hops - 1:
                        ends[way] = ends[way].observe(before[way], F.count("*").alias("n"))
                    ends[way] = kept[way].join(ends[way], F.col("src") == F.col("id")).select(F.col("dst").alias("id")).distinct()
            tagged = [ends[way].withColumn("way", F.lit(way)) for way in ends]
            after, seen = counted(tagged[0].unionByName(tagged[1]) if len(tagged) == 2 else tagged[0], **{way: F.count_if(F.col("way") == way) for way in ends})
            ends = {way: after.where(F.col("way") == way).select("id") for way in ends}
            left |= {way: ends.pop(way) for way in list(ends) if observed(before[way]).get("n", 0) == seen[way]}
            hops = min(FAR, 2 * hops)
    return cut(left["out"].join(left["in"].withColumnRenamed("id", "k"), F.col("id") == F.col("k"), "left_semi"))


def subgraph(g: Graph, keep: DataFrame) -> Graph:
    """The edges with both ends in keep(id)."""
    a, b = keep.select(F.col("id").alias("a")), keep.select(F.col("id").alias("b"))
    return Graph(keep, g.edges.join(a, F.col("src") == F.col("a"), "left_semi").join(b, F.col("dst") == F.col("b"), "left_semi"), g.symmetric)


def restrict(edges: DataFrame, part: DataFrame) -> DataFrame:
    """The edges whose ends are in the same part(id, part), with the part."""
    a, b = part.select(F.col("id").alias("a"), "part"), part.select(F.col("id").alias("b"), F.col("part").alias("q"))
    return edges.join(a, F.col("src") == F.col("a")).join(b, (F.col("dst") == F.col("b")) & (F.col("part") == F.col("q"))).select("src", "dst", "part")


def crossing(edges: DataFrame, label: DataFrame) -> DataFrame:
    """The edges whose ends have different label(id, label), with both labels."""
    a, b = label.select(F.col("id").alias("a"), F.col("label").alias("src_label")), label.select(F.col("id").alias("b"), F.col("label").alias("dst_label"))
    return edges.join(a, F.col("src") == F.col("a")).join(b, F.col("dst") == F.col("b")).where("src_label <> dst_label").select("src", "dst", "src_label", "dst_label")


def csr_offsets(g: Graph) -> DataFrame:
    """id and begin: where a vertex's edges start among all edges by source. Summed by buckets of ids first, so no task sees all vertices."""
    d = out_degree(g).withColumn("bucket", F.floor(F.col("id") / 4096))
    sums = d.groupBy("bucket").agg(F.sum("degree").alias("n"))
    start = sums.select(F.col("bucket").alias("b"), F.coalesce(F.sum("n").over(W.orderBy("bucket").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("before"))
    inner = F.coalesce(F.sum("degree").over(W.partitionBy("bucket").orderBy("id").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    return d.withColumn("inner", inner).join(start, F.col("bucket") == F.col("b")).select("id", (F.col("before") + F.col("inner")).cast("long").alias("begin"))


def degree_sum(g: Graph, ids: DataFrame) -> DataFrame:
    """degrees: how many edges leave ids(id), which is what expanding them costs."""
    return g.edges.join(ids.select(F.col("id").alias("i")), F.col("src") == F.col("i"), "left_semi").agg(F.count("*").alias("degrees"))


def batch(prio: DataFrame, low: int, high: int) -> DataFrame:
    """The vertices of prio(id, prio) with low <= prio < high: a batch of a fixed order, which no sort or offset has to find."""
    return prio.where((F.col("prio") >= low) & (F.col("prio") < high))


def hash_sample(ids: DataFrame, keep: int, of: int) -> DataFrame:
    """About `keep` of each `of` of ids(id), by their hash: the same ones on every run and of every table that has them."""
    return ids.where(F.pmod(scramble(F.col("id")), F.lit(of)) < keep)


def with_key(pairs: DataFrame, keys: DataFrame) -> DataFrame:
    """The rows of pairs(k, v) whose key is among keys(k)."""
    return pairs.join(keys.select(F.col("k").alias("_k")), F.col("k") == F.col("_k"), "left_semi")


def with_pair(pairs: DataFrame, probes: DataFrame) -> DataFrame:
    """The rows of pairs(k, v) that are among probes(k, v)."""
    asked = probes.select(F.col("k").alias("_k"), F.col("v").alias("_v"))
    return pairs.join(asked, (F.col("k") == F.col("_k")) & (F.col("v") == F.col("_v")), "left_semi")
