"""Least-element lists and low-diameter decomposition, on symmetric graphs."""

from __future__ import annotations

import math
from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..functions.priority import priorities, scramble
from ..model import Graph, densify_ids
from ..plans.loop import BROADCAST_ROWS, HOPS, Phases, by_source, counted, cut, dealt, drop, free, small, together
from .construct import batch
from .traverse import least


def prefix_min(rows: DataFrame, by: str, order: str, value: str) -> DataFrame:
    """The rows whose value is less than that of every earlier row of the same group."""
    best = F.min(value).over(W.partitionBy(by).orderBy(order).rowsBetween(W.unboundedPreceding, -1))
    return rows.withColumn("_best", best).where(F.col("_best").isNull() | (F.col(value) < F.col("_best"))).drop("_best")


def le_lists(g: Graph, prio: DataFrame | None = None, hops: int = HOPS) -> DataFrame:
    """target, source, dist: source is nearer to target than every vertex of higher priority.

    Read by distance, the list of a vertex is the history of the least priority seen so far. So all vertices send their
    priority at once, hop by hop, and only an improvement is sent on: whatever doesn't improve a vertex can't improve
    what lies behind it. A job takes several hops, keeps of each hop what is less than all before it, and writes that."""
    prio = cut(prio if prio is not None else priorities(g.vertices))
    with by_source(g.edges.where("src <> dst").select("src", "dst").distinct()) as edges:
        first, seen = counted(prio.select("id", "prio", F.lit(0).alias("dist")), n=F.count("*"))
        parts, front, n, base = [first], first, seen["n"], 0
        while n:
            ahead = hops if n <= BROADCAST_ROWS else 1
            step, met = small(front.select("id", "prio"), n), together(parts).select("id", "prio", F.lit(0).alias("hop"))
            for k in range(1, ahead + 1):
                step = edges.join(step, F.col("src") == F.col("id")).groupBy(F.col("dst").alias("id")).agg(F.min("prio").alias("prio"))
                met = met.unionByName(step.withColumn("hop", F.lit(k)))
            # of each vertex the least priority before this job (0) and of each hop
            best = met.groupBy("id").agg(*[F.min(F.when(F.col("hop") == k, F.col("prio"))).alias(f"p{k}") for k in range(ahead + 1)])
            less = [F.when(F.col(f"p{k}") < (F.least(*[f"p{j}" for j in range(k)]) if k > 1 else F.col("p0")), F.struct(F.col(f"p{k}").alias("prio"), F.lit(base + k).alias("dist"))) for k in range(1, ahead + 1)]
            base += ahead
            rows = best.select("id", F.explode(F.array(*less)).alias("x")).where("x is not null").select("id", "x.prio", "x.dist")
            new, seen = counted(rows, n=F.count("*"), frontier=F.count_if(F.col("dist") == base))
            n = seen["frontier"]
            if seen["n"]:
                parts.append(new)
            else:
                drop(new)
            front = new.where(F.col("dist") == base)
    name = prio.select(F.col("prio").alias("p"), F.col("id").alias("source"))
    return together(parts).join(name, F.col("prio") == F.col("p")).select(F.col("id").alias("target"), "source", "dist")


def batches(n: int, beta: float) -> Iterator[tuple[int, int]]:
    """Ranges of 0 to n-1, each beta times as wide as the one before, the first of one."""
    low, step = 0, 1
    while low < n:
        yield low, min(n, low + step)
        low, step = low + step, max(step + 1, math.ceil(step * beta))


def le_lists_batched(g: Graph, prio: DataFrame | None = None, beta: float = 1.5, hops: int = HOPS, phases: Phases | None = None) -> DataFrame:
    """The rows of le_lists(), by searches from batches of priorities that grow by beta.

    Between batches a table has each vertex's distance from all sources so far. A batch lays it beside the edges' ends
    first, and edges whose end can't come nearer are left out; the others carry their end's limit, so that a hop drops
    what is too far before anything is shuffled. What sources of one batch find of each other's, the prefix minimum drops."""
    prio = cut(prio if prio is not None else priorities(g.vertices))
    plain = dealt(g.edges.where("src <> dst").select("src", "dst").distinct(), "dst")
    parts, total = [], prio.count()
    for low, high in batches(total, beta):
        own = batch(prio, low, high).select("id", "prio", F.lit(0).alias("dist"))
        if parts:
            known = together(parts).groupBy(F.col("id").alias("v")).agg(F.min("dist").alias("limit"))
            limited = plain.join(known, F.col("dst") == F.col("v"), "left").where("limit is null or limit > 1").select("src", "dst", "limit")
        else:
            limited = plain.select("src", "dst", F.lit(None).cast("int").alias("limit"))
        first, seen = counted(own, n=F.count("*"))
        found, front, n, base = [first], first, seen["n"], 0
        with by_source(limited, "limit") as edges:
            while n:
                step, some, ahead = small(front.select("id", "prio"), n), None, hops if n <= BROADCAST_ROWS else 1
                for k in range(1, ahead + 1):
                    near = edges.join(step, F.col("src") == F.col("id")).where(F.col("limit").isNull() | (F.col("limit") > base + k))
                    step = near.select(F.col("dst").alias("id"), "prio").distinct()
                    at = step.withColumn("dist", F.lit(base + k))
                    some = at if some is None else some.unionByName(at)
                base += ahead
                new = some.groupBy("id", "prio").agg(F.min("dist").alias("dist")).join(together(found).select(F.col("id").alias("i"), F.col("prio").alias("p")), (F.col("id") == F.col("i")) & (F.col("prio") == F.col("p")), "left_anti")
                new, seen = counted(new, n=F.count("*"), frontier=F.count_if(F.col("dist") == base))
                n = seen["frontier"]
                if seen["n"]:
                    found.append(new)
                else:
                    drop(new)
                front = new.where(F.col("dist") == base)
                if phases:
                    phases.note(f"batch {low}-{high - 1}", seen["n"], n, ahead)
        parts += found
    free(plain)
    if not parts:
        return prio.select(F.col("id").alias("target"), F.col("id").alias("source"), F.lit(0).alias("dist"))
    name = prio.select(F.col("prio").alias("p"), F.col("id").alias("source"))
    lists = prefix_min(together(parts), "id", "prio", "dist")
    return lists.join(name, F.col("prio") == F.col("p")).select(F.col("id").alias("target"), "source", "dist")


def certificate(g: Graph, lists: DataFrame, prio: DataFrame | None = None) -> DataFrame:
    """kind, violations: what keeps lists(target, source, dist) from being the least-element lists of a symmetric graph; all zero if and only if they are.

    own: vertices without the row (v, v, 0). unfounded: rows without a neighbour one hop nearer to the source that has it in
    its list, so a distance is none of a path. order: rows no nearer than one of a higher priority. missing: rows whose
    source, one hop farther, neither the neighbour's list has nor beats. Joins and a running minimum, no search."""
    prio = prio if prio is not None else priorities(g.vertices)
    edges = g.edges.where("src <> dst").select("src", "dst").distinct()
    rows = lists.join(prio.select(F.col("id").alias("s"), "prio"), F.col("source") == F.col("s")).select("target", "source", "dist", "prio")
    count = lambda kind, df: df.agg(F.lit(kind).alias("kind"), F.count("*").alias("violations"))
    selves = rows.where("target = source and dist = 0").select(F.col("target").alias("t"))
    own = g.vertices.join(selves, F.col("id") == F.col("t"), "left_anti")
    nearer = rows.select(F.col("target").alias("u"), F.col("source").alias("us"), (F.col("dist") + 1).alias("ud")).join(edges, F.col("u") == F.col("src")).select("dst", "us", "ud").distinct()
    unfounded = rows.where("not (target = source and dist = 0)").join(nearer, (F.col("target") == F.col("dst")) & (F.col("source") == F.col("us")) & (F.col("dist") == F.col("ud")), "left_anti")
    upto = W.partitionBy("target").orderBy("prio").rowsBetween(W.unboundedPreceding, -1)
    order = rows.withColumn("best", F.min("dist").over(upto)).where("best <= dist")
    sent = rows.join(edges, F.col("target") == F.col("src")).select(F.col("dst").alias("target"), "prio", (F.col("dist") + 1).alias("due"))
    sent = sent.groupBy("target", "prio").agg(F.min("due").alias("due")).withColumn("dist", F.lit(None).cast("int"))
    both = rows.select("target", "prio", F.lit(None).cast("int").alias("due"), "dist").unionByName(sent)
    within = W.partitionBy("target").orderBy("prio").rangeBetween(W.unboundedPreceding, W.currentRow)
    missing = both.withColumn("best", F.min("dist").over(within)).where("due is not null and (best is null or best > due)")
    return count("own", own).unionByName(count("unfounded", unfounded)).unionByName(count("order", order)).unionByName(count("missing", missing))


def ldd(g: Graph, beta: float = 0.2, hops: int = HOPS, prio: DataFrame | None = None, simple: bool = False) -> DataFrame:
    """id, center, parent: each vertex joins the centre whose start plus distance is least (ties: priority), and hangs below a neighbour that is one hop nearer to it.

    Vertices start in the order of their priority, exponentially many a round: the one of priority p at ceil(ln(p + 1) / beta).
    simple: g's edges are a written table without self-loops or parallel edges, which isn't written again."""
    prio = cut(prio if prio is not None else priorities(g.vertices))
    start = prio.select("id", F.struct(F.ceil(F.log(F.col("prio") + 1.0) / beta).cast("int").alias("arrival"), "prio").alias("key"))
    plain = g.edges if simple else cut(g.edges.where("src <> dst").select("src", "dst").distinct())
    later = lambda key: F.struct((key["arrival"] + 1).alias("arrival"), key["prio"].alias("prio"))
    now = cut(least(plain, start, "key", later, hops))
    at = now.select(F.col("id").alias("i"), F.col("key").alias("k"))
    below = plain.join(at, F.col("src") == F.col("i")).join(now, F.col("dst") == F.col("id")).where("key.prio = k.prio and key.arrival = k.arrival + 1").groupBy(F.col("dst").alias("d")).agg(F.min("src").alias("up"))
    name = prio.select(F.col("prio").alias("p"), F.col("id").alias("center"))
    return now.join(name, F.col("key.prio") == F.col("p")).join(below, F.col("id") == F.col("d"), "left").select("id", "center", F.when(F.col("id") == F.col("center"), F.col("id")).otherwise(F.col("up")).alias("parent"))


def centres(n: int, samples: int = 1024) -> list[int]:
    """Ids of `samples` vertices of 0..n-1, by a hash of 1024 and on: the same on every run."""
    return [(k * 2654435761 + 12345) % 2**32 % n for k in range(1024, 1024 + samples)] if n else []


def sampled_centres(vertices: DataFrame, samples: int = 1024) -> DataFrame:
    """id: the vertices that `samples` draws with replacement hit, by their places in the order of ids; centres() on a table, for any number of draws."""
    placed = cut(densify_ids(vertices.select(F.col("id").alias("v")), "v"))
    n = placed.count()
    if not n:
        return vertices.select("id").limit(0)
    draws = vertices.sparkSession.range(1024, 1024 + samples).select((scramble(F.col("id")) % n).alias("drawn")).distinct()
    return placed.join(draws, F.col("id") == F.col("drawn"), "left_semi").select(F.col("v").alias("id"))


def in_order(lists: DataFrame, prio: DataFrame) -> DataFrame:
    """target, place, source, dist: each list by descending priority, that is, by falling distance."""
    ranked = lists.join(prio.select(F.col("id").alias("s"), "prio"), F.col("source") == F.col("s"))
    return ranked.select("target", F.row_number().over(W.partitionBy("target").orderBy("prio")).alias("place"), "source", "dist")


def differing(a: DataFrame, b: DataFrame) -> DataFrame:
    """The rows that only one of two results has, repeats counted; none if they are equal."""
    return a.exceptAll(b).unionByName(b.exceptAll(a))
