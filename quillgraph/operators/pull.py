"""Pulling: vertices that wait look among their neighbours for one in the frontier, and stop at the first.

Neighbours are sorted arrays, by ranges of WIDTH ids, so a hub's are many rows and no array is longer than a range. The
frontier is a bit map of each range that it touches. A row of neighbours meets one bit map, and `exists` over the array
ends at the first bit that is set; a wide frontier thus costs the waiting vertices a look each, and no edge is shuffled.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..model import Graph
from ..plans.loop import Phases, counted, dealt, drop, free, small, together

#: Ids of a range: its bit map has WIDTH / 64 longs.
WIDTH = 1 << 14


def adjacency(edges: DataFrame, width: int = WIDTH) -> DataFrame:
    """id, range, neighbours: the sources of the edges into id, once each, sorted, as places in their range of ids."""
    place = F.pmod("src", F.lit(width)).cast("int")
    return edges.groupBy(F.col("dst").alias("id"), F.floor(F.col("src") / width).alias("range")).agg(F.array_sort(F.collect_set(place)).alias("neighbours"))


def bitmap(ids: DataFrame, width: int = WIDTH) -> DataFrame:
    """range, words: a bit for each of ids(id) in its range."""
    place = F.pmod("id", F.lit(width))
    words = ids.select(F.floor(F.col("id") / width).alias("range"), F.floor(place / 64).cast("int").alias("word"), F.expr(f"shiftleft(1L, cast(pmod(id, {width}) % 64 as int))").alias("bit"))
    words = words.groupBy("range", "word").agg(F.bit_or("bit").alias("bits"))
    have = words.groupBy("range").agg(F.map_from_entries(F.collect_list(F.struct("word", "bits"))).alias("m"))
    return have.select("range", F.transform(F.sequence(F.lit(0), F.lit(width // 64 - 1)), lambda w: F.coalesce(F.try_element_at("m", w), F.lit(0).cast("long"))).alias("words"))


def pull(neighbours: DataFrame, waiting: DataFrame, frontier: DataFrame) -> DataFrame:
    """id: which of waiting(id) have a neighbour in the frontier, given as bitmap()'s rows."""
    own = neighbours.join(waiting.select(F.col("id").alias("w")), F.col("id") == F.col("w"), "left_semi")
    met = own.join(frontier.withColumnRenamed("range", "r"), F.col("range") == F.col("r"))
    found = F.exists("neighbours", lambda x: F.call_function("getbit", F.get("words", F.floor(x / 64).cast("int")), x % 64) == 1)
    return met.where(found).select("id").distinct()


def bfs(g: Graph, sources: DataFrame, width: int = WIDTH, phases: Phases | None = None) -> DataFrame:
    """id, dist: least number of edges from any of sources(id), a hop a job, all by pulling."""
    neighbours = dealt(adjacency(g.edges, width), "id")
    first, seen = counted(sources.select("id").distinct().withColumn("dist", F.lit(0)), n=F.count("*"))
    done, front, hop = [first], first, 0
    try:
        while seen["n"]:
            hop += 1
            frontier, ranges = counted(bitmap(front, width), n=F.count("*"))
            waiting = g.vertices.join(together(done).select(F.col("id").alias("s")), F.col("id") == F.col("s"), "left_anti")
            found = pull(neighbours, waiting, small(frontier, ranges["n"] * (width // 64)))
            front, seen = counted(found.withColumn("dist", F.lit(hop)), n=F.count("*"))
            drop(frontier)
            if seen["n"]:
                done.append(front)
            if phases:
                phases.note("pull", seen["n"], seen["n"], 1)
    finally:
        free(neighbours)
    return together(done)
