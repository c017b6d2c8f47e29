"""Batches, packed searches, contraction, certificates, pulling, and the .bin data source against plain Python."""

import math
import random
import tracemalloc

import numpy as np
import pytest
from pyspark.sql import datasource as ds
from pyspark.sql import functions as F

from quillgraph.model import Graph
from quillgraph.operators import cc, construct, decompose, pairs, peel, pull, scc, traverse
from quillgraph.plans import loop
from quillgraph.sources import csr, csr_source, relational

from test_graph import CASES, ccs, graph, reached, rows, sccs


@pytest.mark.parametrize("name", ["two_cycles", "self_loop", "depth1_dag", "random"])
def test_batched_components(spark, name):
    n, edges = CASES[name]
    assert dict(rows(scc.scc(graph(spark, n, edges), method="batches", beta=3), "id", "comp")) == sccs(n, edges)


def test_batched_components_of_many_cycles(spark):
    """Cycles of many sizes that point to each other: no giant component, and paths through all of them."""
    r, edges, at = random.Random(2), [], 0
    for size in (1, 2, 3, 5, 9, 4, 1, 7):
        edges += [(at + i, at + (i + 1) % size) for i in range(size) if size > 1] + [(at + size - 1, at + size)]
        at += size
    edges += [(a, b) for a, b in ((r.randrange(at), r.randrange(at)) for _ in range(6)) if a < b]
    g = graph(spark, at + 1, edges)
    phases = loop.Phases()
    got = dict(rows(scc.scc(g, phases, method="batches", beta=4), "id", "comp"))
    assert got == sccs(at + 1, edges) == dict(rows(scc.scc(g), "id", "comp"))
    with pytest.raises(ValueError):
        scc.scc(g, method="other")


def test_contracted_components(spark):
    """Edges with their reverse make most of the components, one of them long; dangling paths lead in and out."""
    n = 60
    edges = [e for i in range(39) for e in ((i, i + 1), (i + 1, i))] + [(40, 5), (7, 41), (41, 42), (43, 44), (44, 43), (44, 45), (45, 46), (46, 43), (39, 43)]
    edges += [(47, 48), (48, 49), (49, 50), (50, 47), (50, 51), (51, 52), (3, 3), (5, 6), (52, 53)]
    phases = loop.Phases()
    assert dict(rows(scc.scc(graph(spark, n, edges), phases), "id", "comp")) == sccs(n, edges)
    assert ("mutual edges", 40) in {(x[0], x[1]) for x in phases.rows} and sum(x[1] for x in phases.rows) == n


def test_trimming_takes_few_jobs(spark, monkeypatch):
    """A path of 60 vertices to a cycle and one of 60 from it; edges whose ends are no vertices hold nothing."""
    n, jobs = 124, []
    edges = [(i, i + 1) for i in range(122)] + [(62, 60), (62, 60), (123, 123), (200, 0), (122, 200), (200, 123), (123, 200)]
    for name in ("cut", "counted"):
        real = getattr(loop, name)
        monkeypatch.setattr(construct, name, lambda *x, _real=real, **y: jobs.append(0) or _real(*x, **y))
    gone, rest = construct.trim(graph(spark, n, edges), iterate=True)
    assert rows(rest.vertices, "id") == [(60,), (61,), (62,)] and rows(rest.edges, "src", "dst") == [(60, 61), (61, 62), (62, 60), (62, 60)]
    assert rows(gone, "id") == [(i,) for i in range(n) if i not in (60, 61, 62)]
    assert len(jobs) <= 12


def test_batched_components_of_a_torus(spark):
    g = relational.torus(spark, 8)
    edges = [(r["src"], r["dst"]) for r in g.edges.collect()]
    assert dict(rows(scc.scc(g, method="batches", beta=6), "id", "comp")) == sccs(64, edges)


def test_lowest_bit(spark):
    r = random.Random(1)
    values = [1, 2, -(2**63), -1, 2**62] + [(r.getrandbits(63) << r.randrange(20)) % 2**63 or 1 for _ in range(50)]
    got = spark.createDataFrame([(v,) for v in values], "v long").select("v", scc._lowest(F.col("v")).alias("k")).collect()
    assert all(x["k"] == (x["v"] & -x["v"]).bit_length() - 1 for x in got)


def test_packed_reach(spark):
    """More sources than a LONG has bits, one of them the sign bit."""
    n = 150
    r = random.Random(5)
    edges = [(r.randrange(n), r.randrange(n)) for _ in range(170)]
    g = graph(spark, n, edges)
    sources = traverse.numbered(g.vertices)
    assert sources.agg(F.max("block")).first()[0] == 2
    packed = traverse.packed_reach(g.edges, sources)
    want = sorted((v, s) for s in range(n) for v in reached(n, edges, s))
    assert packed.count() == len({(v, s // 64) for v, s in want})
    assert rows(traverse.unpacked(packed, sources), "id", "label") == want
    assert dict(rows(traverse.greatest_reaching(g.edges, g.vertices.selectExpr("id", "id label")), "id", "label")) == {v: max(s for w, s in want if w == v) for v in range(n)}


def test_pairs_by_a_pivot(spark, monkeypatch):
    """A component of 40 with paths in, out and around it, contracted pairs and another component: the search gets none of the pairs that go through the first."""
    n, r, got = 70, random.Random(3), []
    edges = [(i, (i + 1) % 40) for i in range(40)] + [(r.randrange(40), r.randrange(40)) for _ in range(40)] + [(i + 1, i) for i in range(0, 30, 2)]
    edges += [(40, 41), (41, 42), (42, 0), (43, 41), (3, 44), (44, 45), (45, 46), (40, 47), (47, 46), (48, 49), (49, 48), (49, 44), (50, 50), (51, 52), (52, 53), (53, 51), (42, 51)]
    real = pairs.packed_reach
    monkeypatch.setattr(pairs, "packed_reach", lambda e, s: got.append(loop.cut(real(e, s))) or got[-1])
    monkeypatch.setattr(pairs, "CHUNK", 4)
    g = graph(spark, n, edges)
    sources = [v for v in range(n) if v % 5]
    found = rows(pairs.multi_reach(g.edges, spark.createDataFrame([(v,) for v in sources], "id long")), "id", "label")
    assert found == sorted((v, s) for s in sources for v in reached(n, edges, s))
    assert got[0].count() <= 60 < len(found) / 20


def test_pairs_without_a_cycle_left(spark, monkeypatch):
    """All in one contraction, which leaves no edge."""
    monkeypatch.setattr(pairs, "CHUNK", 4)
    n, edges = 20, [e for i in range(15) for e in ((i, i + 1), (i + 1, i))]
    found = rows(pairs.multi_reach(graph(spark, n, edges).edges, spark.range(n)), "id", "label")
    assert found == sorted((v, s) for s in range(n) for v in reached(n, edges, s))


@pytest.mark.parametrize("name", ["two_cycles", "isolated", "dup_edges", "random"])
def test_decomposition_components(spark, name):
    n, edges = CASES[name]
    comp, forest = cc.by_decomposition(graph(spark, n, edges), beta=1.0)
    assert dict(rows(comp, "id", "comp")) == ccs(n, edges)
    forest = rows(forest, "src", "dst")
    assert len(forest) == n - len(set(ccs(n, edges).values())) and ccs(n, forest) == ccs(n, edges)
    assert set(forest) <= {(min(e), max(e)) for e in edges}


def test_decomposition_of_a_path_takes_few_contractions(spark):
    n, phases = 400, loop.Phases()
    edges = [(i, i + 1) for i in range(n - 1)]
    comp, forest = cc.by_decomposition(graph(spark, n, edges), beta=1.0, phases=phases)
    assert {x["comp"] for x in comp.collect()} == {0} and forest.count() == n - 1
    assert len(phases.rows) <= 2 * math.log2(n) and phases.rows[-1][2] == 0


def test_many_small_components_take_few_contractions(spark):
    n, phases = 3000, loop.Phases()
    edges = [(i, i + 1) for i in range(0, n, 2)]
    comp, forest = cc.by_decomposition(graph(spark, n, edges), beta=1.0, phases=phases)
    assert dict(rows(comp, "id", "comp")) == {i: i - i % 2 for i in range(n)} and sorted(rows(forest, "src", "dst")) == edges
    assert len(phases.rows) <= 6


def both(edges):
    return sorted({(a, b) for x, y in edges for a, b in ((x, y), (y, x)) if a != b})


def test_batched_lists_and_certificate(spark):
    n, edges = CASES["random"]
    g = Graph(spark.range(n), spark.createDataFrame(both(edges), "src long, dst long"), True)
    lists = loop.cut(decompose.le_lists(g))
    for beta in (1.5, 8):
        assert rows(decompose.le_lists_batched(g, beta=beta), "target", "source", "dist") == rows(lists, "target", "source", "dist")
    wrong = lambda df: {x["kind"]: x["violations"] for x in decompose.certificate(g, df).collect()}
    assert set(wrong(lists).values()) == {0}
    data = [tuple(x) for x in lists.collect()]
    far = next(x for x in data if x[2] > 0)
    remade = lambda rows: spark.createDataFrame(rows, lists.schema)
    assert wrong(remade([x for x in data if x != far]))["missing"] > 0
    own = next(x for x in data if x[2] == 0)
    assert wrong(remade([x for x in data if x != own]))["own"] == 1
    assert wrong(remade([x for x in data if x != far] + [(far[0], far[1], far[2] - 1)]))["unfounded"] > 0
    last = max((x for x in data if x[0] == far[0]), key=lambda x: x[2])
    assert wrong(remade(data + [(far[0], far[0], last[2] + 1)]))["unfounded"] + wrong(remade(data + [(far[0], far[0], last[2] + 1)]))["order"] > 0


def test_batches():
    for n in (0, 1, 7, 1000):
        got = list(decompose.batches(n, 1.5))
        assert [x for a, b in got for x in range(a, b)] == list(range(n))
    assert len(list(decompose.batches(10**9, 1.5))) < 60


def test_counted_rounds(spark):
    n, edges = CASES["cycle"]
    g = graph(spark, n, edges)
    for hops in (1, 4):
        phases = loop.Phases()
        traverse.bfs(g.edges, spark.range(1), hops=hops, phases=phases)
        assert [(x[1], x[2], x[3]) for x in phases.rows] == [(sum((j - 1) * hops < d <= j * hops for d in range(n)), int(j * hops < n), hops) for j in range(1, (n - 1) // hops + 2)]


def test_a_hop_does_not_shuffle_edges(spark):
    n, edges = CASES["random"]
    with loop.by_source(graph(spark, n, edges).edges) as kept:
        front = spark.range(n).withColumnRenamed("id", "i").repartition(3)
        plan = kept.join(front.hint("merge"), F.col("src") == F.col("i"))._jdf.queryExecution().executedPlan().toString()
        side = plan[plan.index("quillgraph_") :] if plan.index("quillgraph_") > plan.index("Range") else plan[: plan.index("Range")]
        assert "Bucketed: true" in plan and plan.count("Exchange hashpartitioning") == 1, side
        name = kept._quill_table
        assert spark.catalog.tableExists(name)
    assert not spark.catalog.tableExists(name)


def test_jobs_grow_over_few_edges(spark):
    """A path of 60: jobs of 4, 8 and 16 hops, where 15 of 4 would do; beyond the rows that are broadcast, jobs stay at 4."""
    g = graph(spark, 60, [(k, k + 1) for k in range(59)])
    phases = loop.Phases()
    assert dict(rows(traverse.bfs(g.edges, spark.range(1), phases=phases), "id", "dist")) == {k: k for k in range(60)}
    assert [r[4 - 1] for r in phases.rows] == [4, 8, 16, 16, 16]
    kept = g.edges
    kept._quill_rows = loop.BROADCAST_ROWS + 1
    assert [loop.hops_ahead(kept, n, None, 8) for n in (10, loop.BROADCAST_ROWS + 1)] == [4, 1]


@pytest.mark.parametrize("name", ["two_cycles", "self_loop", "depth1_dag", "random"])
def test_both_ways_by_one_search(spark, name):
    n, edges = CASES[name]
    g = graph(spark, n, edges)
    for hops in (None, 1):
        ahead, behind = traverse.reach_both(g.edges, spark.range(1), hops)
        assert sorted(r.id for r in ahead.collect()) == sorted(reached(n, edges, 0))
        assert sorted(r.id for r in behind.collect()) == sorted(reached(n, [(b, a) for a, b in edges], 0))
    named = loop.cut(traverse.numbered(spark.range(0, n, 3)))
    both = loop.cut(traverse.packed_both(g.edges, named))
    for back, direction in ((False, "out"), (True, "in")):
        got = both.where(both.back == back).select("id", "block", "bits")
        assert decompose.differing(got, traverse.packed_reach(g.edges, named, direction=direction)).isEmpty()


def test_pull(spark):
    n, edges = 60, [(random.Random(i).randrange(60), random.Random(i + 99).randrange(60)) for i in range(90)] + [(0, i) for i in range(30)]
    g = graph(spark, n, edges)
    for width in (64, 1 << 14):
        assert dict(rows(pull.bfs(g, spark.range(2), width), "id", "dist")) == {v: min(d[v] for d in (reached(n, edges, 0), reached(n, edges, 1)) if v in d) for v in {**reached(n, edges, 0), **reached(n, edges, 1)}}
    arrays = pull.adjacency(g.edges, 64)
    assert all(r["neighbours"] == sorted({a for a, b in edges if b == r["id"]}) for r in arrays.collect())


def test_bin_source(spark, tmp_path):
    n = 40
    edges = CASES["random"][1]
    path = str(tmp_path / "g.bin")
    csr.write_bin(graph(spark, n, edges), path, dual=True)
    assert rows(csr.read_bin_transpose(spark, path, piece=7), "src", "dst") == sorted((b, a) for a, b in edges)
    reader = csr_source.CsrReader({"path": path, "dual": "true", "piece": "5"})
    everything = sum(p.high - p.low for p in reader.partitions())
    rest = list(reader.pushFilters([ds.GreaterThanOrEqual(("src",), 10), ds.LessThan(("src",), 20), ds.LessThan(("dst",), 5)]))
    assert everything == len(edges) and len(rest) == 1 and rest[0].attribute == ("dst",)
    assert sum(p.high - p.low for p in reader.partitions()) == sum(10 <= a < 20 for a, _ in edges)
    got = csr.read_bin(spark, path, dual=True).edges.where("src >= 10 and src < 20 and dst < 5")
    assert rows(got, "src", "dst") == sorted((a, b) for a, b in edges if 10 <= a < 20 and b < 5)
    with pytest.raises(ValueError):
        csr.write_bin(graph(spark, 3, [(0, 7)]), path)
    with pytest.raises(ValueError):
        csr_source.header(__file__, False)
    csr.write_bin(graph(spark, 0, []), path)
    assert csr.read_bin(spark, path).edges.count() == 0 and csr.read_bin(spark, path).vertices.count() == 0


def test_sampled_mode(spark):
    labels = spark.range(1000).select("id", F.when(F.col("id") % 3 == 0, 1).otherwise(F.col("id")).alias("label"))
    got = cc.sampled_mode(labels, 5000).first()
    assert got["label"] == 1 and abs(got["share"] - 0.334) < 0.03
    assert cc.sampled_mode(labels.limit(0)).count() == 0


def test_degrees_stay_of_construct(spark):
    g = graph(spark, 4, [(0, 1), (1, 2), (2, 3)])
    assert rows(construct.trim(g, iterate=True)[0], "id") == [(0,), (1,), (2,), (3,)]


def between_cycles(n, edges):
    left = {(a, b) for a, b in edges if a != b}
    keep = set(range(n))
    while True:
        ok = {v for v in keep if any(b == v for _, b in left) and any(a == v for a, _ in left)}
        if ok == keep:
            return keep, left
        keep, left = ok, {(a, b) for a, b in left if a in ok and b in ok}


@pytest.mark.parametrize("seed", [0, 3])
def test_trimming_by_contraction(spark, seed):
    """Sparse random graphs: paths, trees, cycles that paths join, cycles alone."""
    r = random.Random(seed)
    n = 60
    edges = [(r.randrange(n), r.randrange(n)) for _ in range(45 + 12 * seed)] + [(5, 5), (7, 8), (7, 8)]
    keep, left = between_cycles(n, edges)
    gone, rest = peel.trim(graph(spark, n, edges))
    assert {v for (v,) in rows(gone, "id")} == set(range(n)) - keep and gone.count() == n - len(keep)
    assert {v for (v,) in rows(rest.vertices, "id")} == keep and set(rows(rest.edges, "src", "dst")) == left


def test_trimming_a_path_takes_few_rounds(spark):
    """A path of 3,000 vertices between two cycles stays, as long a path beside it goes: in a few rounds of a few jobs."""
    n = 3000
    path = lambda at: [(i, i + 1) for i in range(at, at + n - 1)]
    edges = path(0) + [(1, 0), (n - 1, n - 2)] + path(n)
    phases = loop.Phases()
    gone, rest = peel.trim(graph(spark, 2 * n, edges), phases)
    assert gone.agg(F.min("id"), F.max("id"), F.count("*")).first() == (n, 2 * n - 1, n)
    assert rest.vertices.count() == n and rest.edges.count() == n + 1 and len(phases.rows) <= 6


def test_trimming_odd_graphs(spark):
    empty = peel.trim(graph(spark, 0, []))
    assert empty[0].count() == empty[1].vertices.count() == empty[1].edges.count() == 0
    odd = Graph.of(spark.createDataFrame([(0, 1), (1, 0), (1, 9), (9, 1), (None, 2), (2, None)], "src long, dst long"), spark.createDataFrame([(0,), (1,), (1,), (2,)], "id long"))
    gone, rest = peel.trim(odd)
    assert rows(gone, "id") == [(2,)] and rows(rest.edges, "src", "dst") == [(0, 1), (1, 0)]


def test_path_roots(spark):
    ups = spark.createDataFrame([(1, 0), (2, 1), (3, 2), (4, 3), (5, 4), (10, 11), (11, 10), (12, 11), (20, 99)], "id long, up long")
    assert dict((r["id"], r["root"]) for r in peel.path_roots(ups).collect()) == {1: 0, 2: 0, 3: 0, 4: 0, 5: 0, 10: None, 11: None, 12: None, 20: 99}


def _brute(x, ids, k):
    """The k nearest of each row in whole numbers of any size."""
    rows = [[int(v) for v in r] for r in x]
    out = set()
    for a, s in zip(rows, ids, strict=True):
        near = sorted((sum((u - v) ** 2 for u, v in zip(a, b, strict=True)), int(t)) for b, t in zip(rows, ids, strict=True) if t != s)[:k]
        out |= {(int(s), t, d) for d, t in near}
    return out


@pytest.mark.parametrize("scale", [3, 1000, 10**8])
def test_nearest_is_exact(scale):
    """Many ties, the values of embeddings, and values whose squares are past the doubles that are whole."""
    r = np.random.default_rng(scale)
    x, ids = r.integers(-scale, scale, (90, 5)), r.permutation(90).astype(np.int64) * 7
    a, b = slice(0, 50), slice(50, 90)
    parts = [relational._nearest(x[p], ids[p], x[q], ids[q], 3, tile=16) for p in (a, b) for q in (a, b)]
    best = {}
    for s, t, d in zip(*(np.concatenate([p[c] for p in parts]).tolist() for c in range(3)), strict=True):
        best.setdefault(s, []).append((d, t))
    assert {(s, t, d) for s, of in best.items() for d, t in sorted(of)[:3]} == _brute(x, ids, 3)


def test_nearest_holds_a_tile_of_distances_only():
    """Two blocks of 8,192 in 256 MB: all their distances at once are 512 MB, and were sorted besides."""
    x, ids = np.random.default_rng(1).integers(-1000, 1000, (8192, 8)), np.arange(8192)
    tracemalloc.start()
    src, dst, _ = relational._nearest(x, ids, x, ids, 2)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert len(src) == 2 * 8192 and (src != dst).all() and peak < 256 << 20


@pytest.mark.parametrize("top", [2**22 - 1, 2**22 + 1])
def test_nearest_in_singles_at_their_limit(top):
    """Squares of vectors just under the limit of singles, and just over it, where doubles follow; most distances are odd."""
    side = math.isqrt(top // 2)
    r = np.random.default_rng(top)
    x = np.stack([side - r.integers(0, 3, 60), -side + r.integers(0, 3, 60)], 1) * r.choice([-1, 1], (60, 1))
    ids = np.arange(60, dtype=np.int64)
    assert set(zip(*(c.tolist() for c in relational._nearest(x, ids, x, ids, 3, tile=16)), strict=True)) == _brute(x, ids, 3)


def test_nearest_takes_singles():
    """A tile of distances in singles is 16 MB; in doubles it was 32, twice."""
    x, ids = np.random.default_rng(1).integers(-700, 700, (8192, 8)), np.arange(8192)
    tracemalloc.start()
    relational._nearest(x, ids, x, ids, 2)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 48 << 20


@pytest.mark.parametrize("block", [100, 8192])
def test_knn_of_blocks(spark, tmp_path, block):
    """700 vectors in seven blocks, or in two; each is sent as often as there are blocks, and once more."""
    r = np.random.default_rng(5)
    x, ids = np.round(r.uniform(-1, 1, (700, 4)), 1), r.permutation(2000)[:700].tolist()
    rows = [(i, [float(v) for v in e]) for i, e in zip(ids, x, strict=True)]
    spark.createDataFrame(rows, "vec_id long, embedding array<float>").write.parquet(f"{tmp_path}/embeddings.parquet")
    got = {(e.src, e.dst) for e in relational.knn(spark, str(tmp_path), 2, block).edges.collect()}
    assert got == {(s, t) for s, t, _ in _brute(np.round(x * 1000).astype(int), np.array(ids), 2)}


def test_wide_joins_of_trimming_keep_off_the_driver(spark):
    n, edges = 60, [(i, i + 1) for i in range(59)] + [(20, 10), (45, 40)]
    gone, rest = peel.trim(graph(spark, n, edges))
    assert {x["id"] for x in gone.collect()} == set(range(10)) | set(range(46, 60))
    assert "BroadcastHashJoin" not in rest.edges._jdf.queryExecution().executedPlan().toString()
