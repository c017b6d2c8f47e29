"""Connected components by alternating large-star and small-star, and spanning forests by contraction.

Edges count in both directions, so on a directed graph these are its weak components. A star operation is the least
neighbour of each vertex, an aggregation with partial sums, joined back to its edges: no neighbour list is gathered.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.priority import priorities, scramble
from ..model import Graph, densify_ids
from ..plans.loop import Phases, counted, cut, drop
from .decompose import ldd


def _stars(edges: DataFrame) -> DataFrame:
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("x"), F.least("u", "m").alias("m"))
    large = both.where("v > u").join(least, F.col("u") == F.col("x")).select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
    down = large.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("x"), "m")
    near = large.join(down, F.col("u") == F.col("x")).select(F.col("v").alias("u"), F.col("m").alias("v"))
    return near.unionByName(down.select(F.col("x").alias("u"), F.col("m").alias("v"))).where("u <> v").distinct()


def _labels(edges: DataFrame) -> DataFrame:
    """id, label of every vertex of edges(u, v) that isn't the least of its component."""
    now, mark = cut(edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()), None
    while True:
        after, seen = counted(_stars(now), n=F.count("*"), h=F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")))
        drop(now)
        now, before, mark = after, mark, seen
        if mark == before:
            return now.select(F.col("u").alias("id"), F.col("v").alias("label"))


def connected_components(g: Graph) -> DataFrame:
    """id, comp: the least id of each vertex's component."""
    label = _labels(g.edges.select(F.col("src").alias("u"), F.col("dst").alias("v"))).withColumnRenamed("id", "i")
    return g.vertices.distinct().join(label, F.col("id") == F.col("i"), "left").select("id", F.coalesce("label", "id").alias("comp"))


def spanning_forest(g: Graph) -> DataFrame:
    """src, dst: n - c edges without a cycle. Each round every component takes its least edge to another one (by lesser end, then greater), and what these join is contracted; the least edges under a total order never form a cycle."""
    edges = g.edges.where("src <> dst").select(F.least("src", "dst").alias("src"), F.greatest("src", "dst").alias("dst")).distinct()
    edges = cut(edges.select("src", "dst", F.col("src").alias("a"), F.col("dst").alias("b")))
    taken = []
    while not edges.isEmpty():
        e = F.struct("src", "dst", "a", "b")
        ends = edges.select(F.col("a").alias("c"), e.alias("e")).unionByName(edges.select(F.col("b").alias("c"), e.alias("e")))
        least = cut(ends.groupBy("c").agg(F.min("e").alias("e")).select("e.*").distinct())
        taken.append(least.select("src", "dst"))
        label = _labels(least.select(F.col("a").alias("u"), F.col("b").alias("v")))
        la, lb = label.select(F.col("id").alias("i"), F.col("label").alias("la")), label.select(F.col("id").alias("j"), F.col("label").alias("lb"))
        edges = edges.join(la, F.col("a") == F.col("i"), "left").join(lb, F.col("b") == F.col("j"), "left")
        edges = cut(edges.select("src", "dst", F.coalesce("la", "a").alias("a"), F.coalesce("lb", "b").alias("b")).where("a <> b"))
    out = g.edges.select("src", "dst").limit(0)
    for x in taken:
        out = out.unionByName(x)
    return out.distinct()


def by_decomposition(g: Graph, beta: float = 0.5, phases: Phases | None = None) -> tuple[DataFrame, DataFrame]:
    """id, comp of connected_components(), and src, dst of a spanning forest, by low-diameter decompositions.

    A decomposition contracts each cluster to its centre; what is left are the edges between clusters, and they are
    decomposed again, in another random order, until there are none. So the rounds follow the logarithm of the vertices
    and not the diameter. beta is that of the first decomposition; the k-th takes beta / k, as fewer edges are left for its
    longer searches: each then cuts a smaller share of them, where one beta cuts the same share every time. Cluster trees are the forest: every edge between contracted vertices remembers the least edge of
    the graph that it stands for. phases gets a row for each contraction: the clusters' edges, and those left between them."""
    plain = g.edges.where("src <> dst").select("src", "dst").distinct()
    both = plain.unionByName(plain.select(F.col("dst").alias("src"), F.col("src").alias("dst")))
    witness = F.struct(F.least("src", "dst").alias("src"), F.greatest("src", "dst").alias("dst"))
    edges, seen = counted(both.select("src", "dst", witness.alias("w")).groupBy("src", "dst").agg(F.min("w").alias("w")), n=F.count("*"))
    at, taken, n, level = cut(g.vertices.distinct().select("id", F.col("id").alias("top"))), [], seen["n"], 0
    while n:
        level += 1
        ends = edges.select(F.col("src").alias("id")).distinct()
        clusters = cut(ldd(Graph(ends, edges.select("src", "dst"), True), beta / level, prio=priorities(ends, salt=level), simple=True))
        up = clusters.where("id <> parent").select(F.col("id").alias("below"), "parent")
        taken.append(cut(edges.join(up, (F.col("src") == F.col("parent")) & (F.col("dst") == F.col("below"))).select("w.src", "w.dst")))
        a, b = clusters.select(F.col("id").alias("i"), F.col("center").alias("a")), clusters.select(F.col("id").alias("j"), F.col("center").alias("b"))
        between = edges.join(a, F.col("src") == F.col("i")).join(b, F.col("dst") == F.col("j")).where("a <> b").groupBy(F.col("a").alias("src"), F.col("b").alias("dst")).agg(F.min("w").alias("w"))
        left, seen = counted(between, n=F.count("*"))
        moved = cut(at.join(a, F.col("top") == F.col("i"), "left").select("id", F.coalesce("a", "top").alias("top")))
        drop(edges, at)
        if phases:
            phases.note("contraction", n, seen["n"])
        edges, at, n = left, moved, seen["n"]
    least = at.groupBy(F.col("top").alias("t")).agg(F.min("id").alias("comp"))
    forest = g.edges.select("src", "dst").limit(0)
    for x in taken:
        forest = forest.unionByName(x)
    return at.join(least, F.col("top") == F.col("t")).select("id", "comp"), forest


def sampled_mode(labels: DataFrame, samples: int = 10_000) -> DataFrame:
    """label and share of the label that `samples` draws with replacement find most often; ties: the least.

    Draws are places by a hash, the same on every run, in the order of ids. A label's share is within e of its true share
    with a probability of 1 - 2 * exp(-2 * samples * e * e) or more (Hoeffding); for 10,000 draws, within 0.02 by 0.9993."""
    placed = densify_ids(labels.select(F.struct("id", "label").alias("row")), "row").select("row.label", F.col("id").alias("place"))
    placed = cut(placed)
    n = placed.count()
    if not n:
        return labels.select("label", F.lit(0.0).alias("share")).limit(0)
    draws = labels.sparkSession.range(samples).select((scramble(F.col("id")) % n).alias("drawn")).groupBy("drawn").agg(F.count("*").alias("times"))
    return placed.join(draws, F.col("place") == F.col("drawn")).groupBy("label").agg((F.sum("times") / samples).alias("share")).orderBy(F.desc("share"), "label").limit(1)


def dominant_label(labels: DataFrame) -> DataFrame:
    """label and n of the most frequent label; ties: the least."""
    return labels.groupBy("label").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "label").limit(1)
