"""Trimming to the end by contraction: paths take rounds by the logarithm of their length, not one for each vertex.

What iterated trimming leaves are the vertices that lie on a walk from a cycle to a cycle. So those that no cycle leads to
go first, then, along reversed edges, those that lead to no cycle. A vertex with one way in shares the fate of the vertex
behind it, and so do all on a path of such vertices: pointers to the vertex behind double until they are at the path's
root, and the path becomes its root. Equal edges that this leaves meet, which makes new vertices with one way in. Each
round settles what has no way in, contracts what has one, and passes on only edges into what has several; fates of
contracted vertices are looked up once, from the last round back.

Defined cases: self-loops count as no cycle, as in trim(); parallel edges count once; an edge with an end that is no
vertex or is null doesn't count; repeated vertices count once. An empty graph gives empty results.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..model import Graph
from ..plans.loop import Phases, apart, counted, cut, drop
from .construct import subgraph, transpose


def path_roots(ups: DataFrame, rows: int | None = None) -> DataFrame:
    """id, root of ups(id, up), where each id has one up: the first up that is no id itself; null on a cycle of ups, and behind one.

    Each job doubles how far pointers go. One that brings none of them to a root says that the others never get to one: of
    those that would, the nearest would have got there. rows: how many ups there are, if that is known."""
    now, before = cut(ups.select("id", "up", F.lit(True).alias("open"))), None
    while True:
        ahead = now.select(F.col("id").alias("at"), F.col("up").alias("next"))
        moved = now.join(apart(ahead, rows), F.col("up") == F.col("at"), "left").select("id", F.coalesce("next", "up").alias("up"), F.col("at").isNotNull().alias("open"))
        after, seen = counted(moved, n=F.count_if("open"))
        drop(now)
        now = after
        if not seen["n"] or seen["n"] == before:
            return now.select("id", F.when(~F.col("open"), F.col("up")).alias("root"))
        before = seen["n"]


def without_cycle_behind(vertices: DataFrame, edges: DataFrame, phases: Phases | None = None) -> DataFrame:
    """id: the vertices that no cycle leads to. phases gets a row for each round: what it settled, and what it left."""
    todo, left = cut(vertices.select("id").distinct()), None
    # an edge without a source comes from a vertex that stays
    now = cut(edges.where("src <> dst").select("src", "dst").distinct())
    rounds: list[tuple[DataFrame, int]] = []
    while True:
        ways = now.groupBy("dst").agg(F.count("*").alias("n"), F.min("src").alias("up"), F.bool_or(F.col("src").isNull()).alias("fed"))
        kind = F.when(F.col("fed"), "stays").when(F.col("n").isNull(), "goes").when(F.col("n") == 1, "one").otherwise("many")
        state, seen = counted(todo.join(apart(ways, left), F.col("id") == F.col("dst"), "left").select("id", "up", kind.alias("kind")), n=F.count("*"), many=F.count_if(F.col("kind") == "many"), one=F.count_if(F.col("kind") == "one"))
        drop(todo)
        if phases:
            phases.note("peel", seen["n"] - seen["many"], seen["many"])
        if seen["many"] == seen["n"]:  # all that is left has several ways in from what is left, so cycles are behind all of it
            drop(now, state)
            break
        fates = state.where("kind <> 'one'").select("id", "kind", F.when(F.col("kind") == "many", F.col("id")).alias("to"))
        if seen["one"]:
            roots = path_roots(state.where("kind = 'one'").select("id", "up"), seen["one"])
            ends = state.select(F.col("id").alias("r"), F.col("kind").alias("end"))
            settled = F.when(F.col("root").isNull(), "stays").otherwise(F.col("end"))
            linked = roots.join(apart(ends, seen["n"]), F.col("root") == F.col("r"), "left").select("id", settled.alias("kind"), F.when(F.col("end") == "many", F.col("root")).alias("to"))
            fates = fates.unionByName(linked)
        fates = cut(fates)
        rounds.append((fates, seen["n"]))
        todo, left = cut(state.where("kind = 'many'").select("id")), seen["many"]
        drop(state)
        if not seen["many"]:
            drop(now)
            break
        into = now.join(apart(todo.select(F.col("id").alias("t")), left), F.col("dst") == F.col("t"), "left_semi")
        source = F.when((F.col("kind") == "many") & (F.col("to") != F.col("dst")), F.col("to"))  # a path that ends where it began is a cycle
        after = cut(into.join(apart(fates.where("kind <> 'goes'"), seen["n"]), F.col("src") == F.col("id")).select(source.alias("src"), "dst").distinct())
        drop(now)
        now = after
    gone = None
    for fates, n in reversed(rounds):
        own = fates.where("kind = 'goes'").select("id")
        if gone is not None:
            own = own.unionByName(fates.join(apart(gone.select(F.col("id").alias("g")), n), F.col("to") == F.col("g"), "left_semi").select("id"))
        after = cut(own)
        drop(fates, *([gone] if gone is not None else []))
        gone = after
    return gone if gone is not None else cut(vertices.select("id").limit(0))


def trim(g: Graph, phases: Phases | None = None) -> tuple[DataFrame, Graph]:
    """What construct.trim() gives with iterate: the vertices on no walk from a cycle to a cycle, and the graph of the others."""
    ids = g.vertices.select("id").distinct()
    edges = g.edges.where("src <> dst")

    def left(among: DataFrame, gone: DataFrame) -> DataFrame:
        return among.join(apart(gone.select(F.col("id").alias("gone"))), F.col("id") == F.col("gone"), "left_anti")

    inner = cut(subgraph(Graph(ids, edges), apart(ids)).edges)
    first = without_cycle_behind(ids, inner, phases)
    behind = subgraph(Graph(ids, inner), apart(cut(left(ids, first))))
    second = without_cycle_behind(behind.vertices, transpose(behind.edges), phases)
    keep = cut(left(behind.vertices, second))
    return first.unionByName(second), Graph(keep, subgraph(behind, apart(keep)).edges, g.symmetric)
