"""Traversals: hop distances, reachability, labels from many sources.

Edges are a table dealt by their source; a hop shuffles its frontier alone. A job takes several hops from a small frontier,
or one from a wide one, so that little is expanded twice; it keeps the best value by vertex, drops what is settled, and
counts what it leaves while it writes. Each job writes what is new, and what was written before is never written again.
Hops of a job are one chain of joins: a row stays by its vertex's loop beside what it sends, so that no hop's rows are made again.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..plans.loop import Phases, by_source, counted, cut, drop, hops_ahead, near, small, together
from .construct import both_ways, restrict, transpose


def _oriented(edges: DataFrame, direction: str) -> DataFrame:
    return {"out": edges, "in": transpose(edges)}[direction].select("src", "dst")


def _leaving(kept: DataFrame, step: DataFrame, side: str | None = None) -> DataFrame:
    """The rows of step with the edges that leave them, on their side if there is one."""
    on = F.col("src") == F.col("id")
    return kept.join(step, on) if side is None else kept.withColumnRenamed(side, "_side").join(step, on & (F.col("_side") == F.col(side)))


def onward(kept: DataFrame, step: DataFrame, at: list[str], value: str, combine, along, where: Column | None = None, side: str | None = None) -> DataFrame:
    """step(*at, value) one hop on, with what it had: rows that meet `where` send along(value) along their edges, and all stay by their loop."""
    met = _leaving(near(kept), step, side)
    if where is not None:
        met = met.where(F.col("own") | where)
    moved = F.when(F.col("own"), F.col(value)).otherwise(along(F.col(value)))
    return met.select(F.col("dst").alias("id"), *at[1:], moved.alias(value)).groupBy(*at).agg(combine(F.col(value)).alias(value))


def bfs(edges: DataFrame, sources: DataFrame, direction: str = "out", hops: int | None = None, phases: Phases | None = None) -> DataFrame:
    """id, dist: least number of edges from any of sources(id). phases gets a row for each job: what it found, the frontier that it left, its hops."""
    with by_source(_oriented(edges, direction), loops=True) as kept:
        first, seen = counted(sources.select("id").distinct().withColumn("dist", F.lit(0)), n=F.count("*"))
        done, front, n, base, ahead = [first], first, seen["n"], 0, 0
        while n:
            ahead = hops_ahead(kept, n, hops, ahead)
            if ahead == 1:
                found = kept.where("not own").join(small(front.select("id"), n), F.col("src") == F.col("id")).select(F.col("dst").alias("id"), F.lit(1).alias("hop")).distinct()
            else:
                found = front.select("id", F.lit(0).alias("hop"))
                for k in range(ahead):
                    found = onward(kept, found, ["id"], "hop", F.min, lambda hop: hop + 1, F.col("hop") == k)
            least = found.where("hop > 0").select("id", (F.col("hop") + base).alias("dist"))
            base += ahead
            new, seen = counted(least.join(together(done).select(F.col("id").alias("s")), F.col("id") == F.col("s"), "left_anti"), n=F.count("*"), frontier=F.count_if(F.col("dist") == base))
            n = seen["frontier"]
            if seen["n"]:
                done.append(new)
            else:
                drop(new)
            front = new.where(F.col("dist") == base)
            if phases:
                phases.note("search", seen["n"], n, ahead)
        return together(done)


def reach(edges: DataFrame, sources: DataFrame, direction: str = "out") -> DataFrame:
    """id: what sources(id) reach, themselves included."""
    return bfs(edges, sources, direction).select("id")


def spread(edges: DataFrame, start: DataFrame, at: list[str], value: str, combine, better, along=lambda v: v, hops: int | None = None, phases: Phases | None = None, side: str | None = None) -> list[DataFrame]:
    """What vertices learn from those behind them until nothing changes, as the parts of a table that start and every job have written.

    start(*at, value): at begins with id. Values meet by combine, an aggregation, go along an edge as along(value), and are
    news where better(value, known) isn't null: then that is what is written and sent on. Combining all parts by `at` gives the result.
    side is a column of edges and of `at`, if values go along the edges of their own side only."""
    with by_source(edges, *([side] if side else []), loops=True) as kept:
        first, seen = counted(start.select(*at, value), n=F.count("*"))
        parts, delta, n, ahead = [first], first, seen["n"], 0
        keys = at[1:]
        while n:
            ahead = hops_ahead(kept, n, hops, ahead)
            if ahead == 1:
                moved = _leaving(kept.where("not own"), small(delta, n), side).select(F.col("dst").alias("id"), *keys, along(F.col(value)).alias(value))
                found = moved.groupBy(*at).agg(combine(F.col(value)).alias(value))
            else:
                found = delta
                for _ in range(ahead):
                    found = onward(kept, found, at, value, combine, along, side=side)
            both = found.withColumn("old", F.lit(False)).unionByName(together(parts).select(*at, value, F.lit(True).alias("old")))
            fresh, known = F.when(~F.col("old"), F.col(value)), F.when(F.col("old"), F.col(value))
            met = both.groupBy(*at).agg(combine(fresh).alias("fresh"), combine(known).alias("known")).where("fresh is not null")
            new, seen = counted(met.select(*at, better(F.col("fresh"), F.col("known")).alias(value)).where(F.col(value).isNotNull()), n=F.count("*"))
            delta, n = new, seen["n"]
            if n:
                parts.append(new)
            else:
                drop(new)
            if phases:
                phases.note("spread", n, n, ahead)
        return parts


def _if_less(fresh: Column, known: Column) -> Column:
    return F.when(known.isNull() | (fresh < known), fresh)


def least(edges: DataFrame, start: DataFrame, value: str, along=lambda v: v, hops: int | None = None) -> DataFrame:
    """id, value: the least value of start(id, value) that reaches a vertex, its own included, changed by along() on every edge."""
    return together(spread(edges, start, ["id"], value, F.min, _if_less, along, hops)).groupBy("id").agg(F.min(value).alias(value))


def least_label(edges: DataFrame, start: DataFrame, hops: int | None = None) -> DataFrame:
    """id, label: the least label of start(id, label) that reaches a vertex, its own included."""
    return cut(least(edges, start, "label", hops=hops))


def greatest_reaching(edges: DataFrame, start: DataFrame, hops: int | None = None) -> DataFrame:
    """id, label: the greatest label of start(id, label) that reaches a vertex: one row for each vertex all along, never the pairs."""
    turned = start.select("id", (-F.col("label")).alias("label"))
    return least(edges, turned, "label", hops=hops).select("id", (-F.col("label")).alias("label"))


def numbered(sources: DataFrame) -> DataFrame:
    """source, block, bit: sources(id) in the order of their ids, 64 to a block."""
    from ..model import densify_ids

    n = densify_ids(sources.select(F.col("id").alias("source")), "source")
    return n.select("source", F.shiftright("id", 6).alias("block"), F.col("id").bitwiseAND(F.lit(63)).cast("int").alias("bit"))


def _news(fresh: Column, known: Column) -> Column:
    none = F.lit(0).cast("long")
    return F.nullif(fresh.bitwiseAND(F.bitwise_not(F.coalesce(known, none))), none)


def packed_reach(edges: DataFrame, sources: DataFrame, part: DataFrame | None = None, direction: str = "out", hops: int | None = None, phases: Phases | None = None) -> DataFrame:
    """id, block, bits: which of 64 sources of a block reach a vertex. sources is what numbered() gives.

    A vertex sends on the bits that it didn't have; where they meet they are or-ed, so 64 searches cost the rows of one."""
    edges = _oriented(edges, direction)
    if part is not None:
        edges = restrict(edges, part).select("src", "dst")
    start = sources.select(F.col("source").alias("id"), "block", F.expr("shiftleft(1L, bit)").alias("bits"))
    parts = spread(edges, start, ["id", "block"], "bits", F.bit_or, _news, hops=hops, phases=phases)
    return together(parts).groupBy("id", "block").agg(F.bit_or("bits").alias("bits"))


def _either_way() -> Column:
    return F.explode(F.array(F.lit(False), F.lit(True))).alias("back")


def reach_both(edges: DataFrame, sources: DataFrame, hops: int | None = None) -> tuple[DataFrame, DataFrame]:
    """id of what sources(id) reach, and id of what reaches them, themselves included in both; by the same jobs."""
    start = sources.select("id").distinct().select("id", _either_way(), F.lit(True).alias("seen"))
    found = together(spread(both_ways(edges), start, ["id", "back"], "seen", F.bool_or, lambda fresh, known: F.when(known.isNull(), fresh), hops=hops, side="back"))
    return found.where("not back").select("id"), found.where("back").select("id")


def packed_both(edges: DataFrame, sources: DataFrame, hops: int | None = None, phases: Phases | None = None) -> DataFrame:
    """id, back, block, bits: packed_reach() along the edges (back is false) and against them, by the same jobs."""
    start = sources.select(F.col("source").alias("id"), _either_way(), "block", F.expr("shiftleft(1L, bit)").alias("bits"))
    parts = spread(both_ways(edges), start, ["id", "back", "block"], "bits", F.bit_or, _news, hops=hops, phases=phases, side="back")
    return together(parts).groupBy("id", "back", "block").agg(F.bit_or("bits").alias("bits"))


def unpacked(packed: DataFrame, sources: DataFrame) -> DataFrame:
    """id, label: the pairs of a vertex and a source that packed_reach()'s bits hold."""
    bits = F.filter(F.sequence(F.lit(0), F.lit(63)), lambda b: F.call_function("getbit", F.col("bits"), b) == 1)
    each = packed.select("id", "block", F.explode(bits).alias("bit"))
    named = sources.select(F.col("source").alias("label"), F.col("block").alias("of"), F.col("bit").alias("place"))
    return each.join(named, (F.col("block") == F.col("of")) & (F.col("bit") == F.col("place"))).select("id", "label")


def multi_reach(edges: DataFrame, sources: DataFrame, part: DataFrame | None = None, direction: str = "out", hops: int = 2) -> DataFrame:
    """id, label: the pairs of a vertex and each of sources(id) that reaches it; with part(id, part), along edges within a part only. Pairs are spelled out at the end."""
    named = cut(numbered(sources))
    return unpacked(packed_reach(edges, named, part, direction, hops), named)


def effective_degree(edges: DataFrame, dist: DataFrame, beyond: int) -> DataFrame:
    """id, degree: how many neighbours of a vertex are farther than `beyond` in dist(id, dist), or not in it at all."""
    near = dist.where(F.col("dist") <= beyond).select(F.col("id").alias("v"))
    return edges.join(near, F.col("dst") == F.col("v"), "left_anti").groupBy(F.col("src").alias("id")).agg(F.count("*").alias("degree"))


def greatest_label(pairs: DataFrame) -> DataFrame:
    """id, label: the greatest label of each vertex of multi_reach's pairs(id, label)."""
    return pairs.groupBy("id").agg(F.max("label").alias("label"))
