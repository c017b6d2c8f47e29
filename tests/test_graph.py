"""Graph operators against plain Python on small graphs, and round trips of the file formats."""

import collections
import random

import pytest

from quillgraph.functions import stats
from quillgraph.model import Graph, densify_ids
from quillgraph.operators import cc, construct, decompose, scc, traverse
from quillgraph.sources import csr, relational

CASES = {
    "single": (1, []),
    "self_loop": (1, [(0, 0)]),
    "dup_edges": (2, [(0, 1), (0, 1)]),
    "depth1_dag": (3, [(0, 1), (0, 2)]),
    "cycle": (10, [(i, (i + 1) % 10) for i in range(10)]),
    "two_cycles": (4, [(0, 1), (1, 0), (2, 3), (3, 2), (1, 2)]),
    "isolated": (5, [(0, 1)]),
    "random": (40, [(random.Random(i).randrange(40), random.Random(i + 999).randrange(40)) for i in range(60)]),
}


def graph(spark, n, edges):
    return Graph.of(spark.createDataFrame(edges, "src long, dst long"), spark.range(n))


def reached(n, edges, s):
    seen, todo = {s: 0}, [s]
    for u in todo:
        for a, b in edges:
            if a == u and b not in seen:
                seen[b] = seen[u] + 1
                todo.append(b)
    return seen


def sccs(n, edges):
    r = [set(reached(n, edges, s)) for s in range(n)]
    return {v: min(u for u in r[v] if v in r[u]) for v in range(n)}


def ccs(n, edges):
    both = edges + [(b, a) for a, b in edges]
    return {v: min(reached(n, both, v)) for v in range(n)}


def rows(df, *c):
    return sorted(tuple(r[x] for x in c) for r in df.collect())


@pytest.mark.parametrize("name", CASES)
def test_components(spark, name):
    n, edges = CASES[name]
    g = graph(spark, n, edges)
    assert dict(rows(scc.scc(g), "id", "comp")) == sccs(n, edges)
    assert dict(rows(cc.connected_components(g), "id", "comp")) == ccs(n, edges)
    forest = rows(cc.spanning_forest(g), "src", "dst")
    assert len(forest) == n - len(set(ccs(n, edges).values()))
    assert ccs(n, forest) == ccs(n, edges)
    assert set(forest) <= {(min(e), max(e)) for e in edges}


def test_empty_graph(spark):
    g = graph(spark, 0, [])
    for df in (scc.scc(g), cc.connected_components(g), cc.spanning_forest(g), construct.out_degree(g), decompose.ldd(g), decompose.le_lists(g)):
        assert df.count() == 0


def test_traversal(spark):
    n, edges = CASES["random"]
    g = graph(spark, n, edges)
    for hops in (1, 3):
        assert dict(rows(traverse.bfs(g.edges, spark.range(1), hops=hops), "id", "dist")) == reached(n, edges, 0)
    back = [(b, a) for a, b in edges]
    assert rows(traverse.reach(g.edges, spark.range(1), "in"), "id") == sorted((v,) for v in reached(n, back, 0))
    got = rows(traverse.multi_reach(g.edges, spark.range(3)), "id", "label")
    assert got == sorted((v, s) for s in range(3) for v in reached(n, edges, s))
    part = [(u, v) for u, v in edges if u % 2 == v % 2]
    got = rows(traverse.multi_reach(g.edges, spark.range(3), g.vertices.selectExpr("id", "id % 2 part")), "id", "label")
    assert got == sorted((v, s) for s in range(3) for v in reached(n, part, s))


def test_path_needs_many_hops(spark):
    edges = [(i, i + 1) for i in range(60)]
    assert rows(traverse.bfs(graph(spark, 61, edges).edges, spark.range(1)), "id", "dist") == [(i, i) for i in range(61)]


def test_lists_and_clusters(spark):
    n, edges = CASES["random"]
    both = sorted({(a, b) for x, y in edges for a, b in ((x, y), (y, x)) if a != b})
    g = Graph(spark.range(n), spark.createDataFrame(both, "src long, dst long"), True)
    order = sorted(range(n), key=lambda i: ((i * 2654435761 + 12345) % 2**32, i))
    dist = {s: reached(n, both, s) for s in range(n)}
    expected = []
    for v in range(n):
        best = None
        for s in order:
            if v in dist[s] and (best is None or dist[s][v] < best):
                best = dist[s][v]
                expected.append((v, s, best))
    assert rows(decompose.le_lists(g), "target", "source", "dist") == sorted(expected)
    import math

    start = {s: math.ceil(math.log(p + 1.0) / 0.2) for p, s in enumerate(order)}
    got = {r["id"]: r for r in decompose.ldd(g, 0.2).collect()}
    for v in range(n):
        assert got[v]["center"] == min((start[s] + dist[s][v], p, s) for p, s in enumerate(order) if v in dist[s])[2]
        up = got[v]["parent"]
        assert (up == v) == (got[v]["center"] == v) and got[up]["center"] == got[v]["center"] and (up == v or (up, v) in both)


def test_construct(spark):
    g = graph(spark, 4, [(0, 1), (0, 1), (1, 1), (1, 2)])
    assert rows(construct.transpose(g.edges), "src", "dst") == [(1, 0), (1, 0), (1, 1), (2, 1)]
    assert rows(construct.symmetrize(g.edges), "src", "dst") == [(0, 1), (1, 0), (1, 2), (2, 1)]
    assert rows(construct.out_degree(g), "id", "degree") == [(0, 2), (1, 2), (2, 0), (3, 0)]
    assert rows(construct.csr_offsets(g), "id", "begin") == [(0, 0), (1, 2), (2, 4), (3, 4)]
    assert rows(construct.trim(g)[0], "id") == [(0,), (2,), (3,)]
    check = g.validate().first().asDict()
    assert check == {"dangling_src": 0, "dangling_dst": 0, "asymmetric": 3, "duplicates": 0, "nulls": 0}
    keys = spark.createDataFrame([("b",), ("a",), ("b",), ("c",)], "k string")
    assert rows(densify_ids(keys, "k"), "k", "id") == [("a", 0), ("b", 1), ("c", 2)]


@pytest.mark.parametrize("ending", ["adj", "bin"])
def test_files(spark, tmp_path, ending):
    n, edges = CASES["random"]
    g, path = graph(spark, n, edges), str(tmp_path / f"g.{ending}")
    (csr.write_adj if ending == "adj" else csr.write_bin)(g, path)
    back = csr.read(spark, path)
    assert back.vertices.count() == n and rows(back.edges, "src", "dst") == sorted(edges)
    if ending == "bin":
        assert rows(csr.read_bin(spark, path, piece=7).edges, "src", "dst") == sorted(edges)
        csr.write_bin(g, path, dual=True)
        assert rows(csr.read(spark, path, dual=True).edges, "src", "dst") == sorted(edges)
        with pytest.raises(ValueError):
            csr.read(spark, path)
    with pytest.raises(ValueError):
        csr.read(spark, path + ".txt")


def test_bad_header(spark, tmp_path):
    (tmp_path / "g.adj").write_text("Something 1 0 0")
    with pytest.raises(ValueError):
        csr.read(spark, str(tmp_path / "g.adj"))


def test_stats(spark):
    df = spark.createDataFrame([(1, 1, 9.0), (1, 2, 2.0), (1, 3, 8.0), (2, 2, float("nan")), (2, 3, 4.0)], "g int, run int, s double")
    assert rows(stats.after_warm_up(df.where("g = 1"), ["g"], "run", "s"), "g", "mean") == [(1, 5.0)]
    assert abs(df.agg(stats.geometric_mean(df["s"]).alias("x")).first()["x"] - (9 * 2 * 8 * 4) ** 0.25) < 1e-9
    n, edges = CASES["two_cycles"]
    g = graph(spark, n, edges)
    assert stats.graph_stats(g, scc.scc(g)).first().asDict() == {"n": 4, "m": 5, "components": 2, "largest": 2, "share": 0.5}


def test_torus(spark):
    g = relational.torus(spark, 6)
    assert g.vertices.count() == 36 and g.edges.count() == 72 and g.edges.where("src < 0 or dst > 35").count() == 0


def test_phases_and_facade(spark):
    from quillgraph.plans.loop import Phases

    n, edges = CASES["random"]
    g, phases = graph(spark, n, edges), Phases()
    assert dict(rows(scc.scc(g, phases), "id", "comp")) == sccs(n, edges)
    table = phases.table(spark).collect()
    assert sum(r["n"] for r in table) == n and {r["phase"] for r in table} <= {"trim", "first component", "colours"}
    assert rows(g.bfs(spark.range(1)), "id", "dist") == sorted(reached(n, edges, 0).items())
    dist = spark.createDataFrame(list(reached(n, edges, 0).items()), "id long, dist int")
    far = {v for v in range(n) if reached(n, edges, 0).get(v, 10**9) > 1}
    assert dict(rows(traverse.effective_degree(g.edges, dist, 1), "id", "degree")) == {u: k for u in range(n) if (k := sum(a == u and b in far for a, b in edges))}
    assert decompose.differing(g.edges, g.edges).count() == 0 and decompose.differing(g.edges, g.edges.limit(1)).count() == len(edges) - 1
    assert len(decompose.centres(50)) == 1024 and decompose.centres(0) == []


def test_frames(spark, tmp_path):
    from quillgraph.sources import logs

    (tmp_path / "x.csv").write_text("graph A\nx,y\n1, 2\n\ngraph B\nx,y\n3,4\n5,6\n")
    got = collections.defaultdict(list)
    for r in logs.read_frames(spark, str(tmp_path / "x.csv")).orderBy("line").collect():
        got[r["frame"]].append(r["values"])
    assert got == {"A": [["x", "y"], ["1", "2"]], "B": [["x", "y"], ["3", "4"], ["5", "6"]]}
    logs.write_table(spark.range(3).selectExpr("id", "id % 2 k"), str(tmp_path / "out"), by="k")
    assert rows(spark.read.option("header", True).option("inferSchema", True).csv(str(tmp_path / "out")), "id", "k") == [(0, 0), (1, 1), (2, 0)]
