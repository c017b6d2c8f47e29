"""Strongly connected components: trimming, contraction, one pivot for the giant component, then colours.

Trimming takes vertices that no cycle can hold. Where edges that have their reverse are many, as among neighbours, what
they join is contracted, as it is of one component; what has no way in or out then goes, too. The pivot is the vertex with
the most in- times out-edges: what it reaches and what reaches it meet in its component. Of the rest, every vertex takes the least id that reaches it within
its subproblem as its colour; a colour's root is a member, and what reaches the root inside the colour is the root's
component. Settled vertices and edges between colours go, and the rest is trimmed and coloured again, until few are left:
these are searched from all at once.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.priority import priorities
from ..model import Graph
from ..plans.loop import Phases, counted, cut, drop
from .cc import connected_components
from .construct import batch, crossing, restrict, trim
from .decompose import batches
from .traverse import least_label, numbered, packed_both, reach, reach_both


#: Pairs of edges with their reverse for each vertex, from which on they are contracted.
MUTUAL = 0.25
#: Vertices up to which what the first component leaves is searched from all of them at once: at most 256 rows of 64 sources for each.
FEW = 16_384


def renamed(edges: DataFrame, names: DataFrame) -> DataFrame:
    """src, dst: edges between what their ends are called in names(id, to), or as they are if they aren't in it; once each, without self-loops."""
    a, b = names.select(F.col("id").alias("a"), F.col("to").alias("src_to")), names.select(F.col("id").alias("b"), F.col("to").alias("dst_to"))
    named = edges.join(a, F.col("src") == F.col("a"), "left").join(b, F.col("dst") == F.col("b"), "left")
    return named.select(F.coalesce("src_to", "src").alias("src"), F.coalesce("dst_to", "dst").alias("dst")).where("src <> dst").distinct()


def mutual_names(edges: DataFrame, n: int) -> tuple[DataFrame | None, int]:
    """id, to: of what edges that have their reverse join, all but the least id, with that id; and how many they are. edges have no parallel ones or self-loops. None where such edges are few beside n vertices."""
    twice = edges.groupBy(F.least("src", "dst").alias("src"), F.greatest("src", "dst").alias("dst")).agg(F.count("*").alias("ways")).where("ways = 2")
    pairs, seen = counted(twice.select("src", "dst"), n=F.count("*"))
    if not seen["n"] or seen["n"] < MUTUAL * n:
        drop(pairs)
        return None, 0
    joined = connected_components(Graph(pairs.select(F.col("src").alias("id")).unionByName(pairs.select(F.col("dst").alias("id"))), pairs))
    names, seen = counted(joined.where("id <> comp").select("id", F.col("comp").alias("to")), n=F.count("*"))
    drop(pairs)
    return names, seen["n"]


def pivot_of(edges: DataFrame) -> DataFrame:
    """id of the vertex with the most in- times out-edges, the least of several; no row if none has both."""
    by_src, by_dst = edges.groupBy(F.col("src").alias("id")).agg(F.count("*").alias("o")), edges.groupBy(F.col("dst").alias("d")).agg(F.count("*").alias("i"))
    return cut(by_src.join(by_dst, F.col("id") == F.col("d")).orderBy(F.desc(F.col("o") * F.col("i")), "id").limit(1).select("id"))


def _lowest(bits: Column) -> Column:
    """The place of the lowest bit that is set."""
    for k in (1, 2, 4, 8, 16, 32):
        bits = bits.bitwiseOR(F.shiftleft(bits, k))
    return 64 - F.bit_count(bits)


def _searched(edges: DataFrame, sources: DataFrame) -> tuple[DataFrame, DataFrame, int]:
    """What packed_both() gives of sources, that numbered() gave; id, comp of what they settle, by the least source of a component; and how many these are."""
    both = cut(packed_both(edges, sources))
    ahead, behind = both.where("not back"), both.where("back")
    there = behind.select(F.col("id").alias("i"), F.col("block").alias("of"), F.col("bits").alias("too"))
    met = ahead.join(there, (F.col("id") == F.col("i")) & (F.col("block") == F.col("of"))).select("id", "block", F.col("bits").bitwiseAND(F.col("too")).alias("bits")).where("bits <> 0")
    number = met.groupBy("id").agg(F.min(F.col("block") * 64 + _lowest(F.col("bits"))).alias("number"))
    named = sources.select(F.col("source").alias("comp"), (F.col("block") * 64 + F.col("bit")).alias("n"))
    found, seen = counted(number.join(named, F.col("number") == F.col("n")).select("id", "comp"), n=F.count("*"))
    return both, found, seen["n"]


def _batched(edges: DataFrame, part: DataFrame, beta: float, phases: Phases | None) -> list[DataFrame]:
    """id, comp by batches: searches both ways from batches of priorities that grow by beta, inside the parts.

    A vertex that a source reaches and that reaches it is in its component; all of a component have the same sources ahead
    and behind, so what a vertex has of them, both ways, names its part from then on, and no component is ever split. Every
    vertex is a source at last, so the batches, and not the paths, bound the rounds."""
    order = cut(priorities(part))
    done, total = [], order.count()
    for low, high in batches(total, beta):
        # no cycle holds what has no edge in or out within its part
        inner = cut(restrict(edges, part).select("src", "dst"))
        gone, rest = trim(Graph(part.select("id"), inner))
        done.append(cut(gone.select("id", F.col("id").alias("comp"))))
        part, seen = counted(part.join(rest.vertices.select(F.col("id").alias("k")), F.col("id") == F.col("k"), "left_semi"), n=F.count("*"))
        if not seen["n"]:
            break
        own = batch(order, low, high).join(part.select(F.col("id").alias("k")), F.col("id") == F.col("k"), "left_semi")
        sources = cut(numbered(own))
        if sources.isEmpty():
            continue
        both, found, n = _searched(inner, sources)
        ahead, behind = both.where("not back"), both.where("back")
        done.append(found)
        sets = lambda df, tag: df.select("id", F.xxhash64("block", "bits", F.lit(tag)).alias("h"))
        seen_by = sets(ahead, 0).unionByName(sets(behind, 1)).groupBy(F.col("id").alias("i")).agg(F.bit_xor("h").alias("h"))
        left = part.join(found.select(F.col("id").alias("k")), F.col("id") == F.col("k"), "left_anti").join(seen_by, F.col("id") == F.col("i"), "left")
        part, edges = cut(left.select("id", F.xxhash64("part", "h").alias("part"))), inner
        if phases:
            phases.note(f"batch {low}-{high - 1}", n)
    return done


def scc(g: Graph, phases: Phases | None = None, method: str = "colours", beta: float = 1.5) -> DataFrame:
    """id, comp: the least id of each vertex's strongly connected component. phases gets a row for each phase.

    method: what settles the vertices beside the giant component. "colours" takes a job for each few edges of the longest
    path in a colour; "batches" takes two searches for each of log(n) / log(beta) batches, whatever the paths."""
    if method not in ("colours", "batches"):
        raise ValueError(f"{method}: the method must be colours or batches")
    note = lambda phase, df: phases and phases.note(phase, df.count())
    own = lambda df: df.select("id", F.col("id").alias("comp"))
    g = Graph(cut(g.vertices.distinct()), cut(g.edges.where("src <> dst").distinct()))
    gone, rest = trim(g, iterate=True)
    done = [cut(own(gone))]
    note("trim", done[0])
    merged: list[DataFrame] = []
    while True:
        names, n = mutual_names(rest.edges, rest.vertices.count())
        if names is None:
            break
        merged.append(names)
        if phases:
            phases.note("mutual edges", n)
        left = rest.vertices.join(names.withColumnRenamed("id", "k"), F.col("id") == F.col("k"), "left_anti")
        gone, rest = trim(Graph(left, cut(renamed(rest.edges, names))), iterate=True)
        done.append(cut(own(gone)))
        note("trim", done[-1])
    pivot = pivot_of(rest.edges)
    if pivot.isEmpty():
        return _named(done, merged)
    ahead, behind = reach_both(rest.edges, pivot)
    giant = cut(ahead.join(behind.withColumnRenamed("id", "b"), F.col("id") == F.col("b"), "left_semi"))
    note("first component", giant)
    done.append(giant.join(giant.agg(F.min("id").alias("comp")), F.lit(True)).select("id", "comp"))
    left = rest.vertices.join(giant.withColumnRenamed("id", "b"), F.col("id") == F.col("b"), "left_anti")
    # ahead of the pivot, behind it, or neither: no component crosses these parts
    a, b = ahead.select(F.col("id").alias("a")), behind.select(F.col("id").alias("b"))
    part, seen = counted(left.join(a, F.col("id") == F.col("a"), "left").join(b, F.col("id") == F.col("b"), "left").select("id", F.when(F.col("a").isNotNull(), 1).when(F.col("b").isNotNull(), 2).otherwise(0).cast("long").alias("part")), n=F.count("*"))
    if method == "batches":
        done += _batched(rest.edges, part, beta, phases)
        seen["n"] = 0
    while n := seen["n"]:
        if n <= FEW:
            inner = cut(restrict(rest.edges, part).select("src", "dst"))
            done.append(_searched(inner, cut(numbered(part)))[1])
            note("colours", done[-1])
            break
        g = Graph(part.select("id"), cut(restrict(rest.edges, part).select("src", "dst")))
        gone, rest = trim(g, iterate=True)
        done.append(cut(own(gone)))
        colour = cut(least_label(rest.edges, own(rest.vertices).withColumnRenamed("comp", "label")))
        inside = cut(restrict(rest.edges, colour.select("id", F.col("label").alias("part"))).select("src", "dst"))
        member = reach(inside, colour.where("id = label").select("id"), "in")
        note("trim", done[-1])
        found = cut(colour.join(member.withColumnRenamed("id", "m"), F.col("id") == F.col("m"), "left_semi"))
        note("colours", found)
        done.append(found.select("id", F.col("label").alias("comp")))
        part, seen = counted(colour.join(found.select(F.col("id").alias("m")), F.col("id") == F.col("m"), "left_anti").select("id", F.col("label").alias("part")), n=F.count("*"))
    return _named(done, merged, least=method == "batches")  # components are named by a source there


def _named(done: list[DataFrame], merged: list[DataFrame], least: bool = False) -> DataFrame:
    """id, comp of all parts, and of what was contracted before, by its names. least: components aren't named by their least id yet."""
    out = done[0]
    for x in done[1:]:
        out = out.unionByName(x)
    if least:
        first = out.groupBy(F.col("comp").alias("c")).agg(F.min("id").alias("least"))
        out = out.join(first, F.col("comp") == F.col("c")).select("id", F.col("least").alias("comp"))
    for names in reversed(merged):
        of = out.select(F.col("id").alias("k"), "comp")
        out = out.unionByName(names.join(of, F.col("to") == F.col("k")).select("id", "comp"))
    return out


def condensation(g: Graph, comp: DataFrame) -> DataFrame:
    """src, dst: the edges between components, once each."""
    return crossing(g.edges, comp.select("id", F.col("comp").alias("label"))).select(F.col("src_label").alias("src"), F.col("dst_label").alias("dst")).distinct()
