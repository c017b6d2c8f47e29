"""Graph queries over the test tables, and SQL that says the same."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .functions import stats
from .functions.priority import priorities
from .model import Graph
from .operators import cc, construct, decompose, pairs, peel, pull, scc, traverse
from .plans.loop import HOPS, cut, shared_dir
from .sources import csr, logs
from .sources import relational as R

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def _query(sql: str | None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def _copart_sql(where: str) -> str:
    return f"""e AS MATERIALIZED (SELECT DISTINCT l_partkey AS src, nxt AS dst FROM (SELECT l_partkey, lead(l_partkey) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey) AS nxt FROM lineitem WHERE {where}) WHERE nxt IS NOT NULL AND nxt <> l_partkey),
v AS (SELECT p_partkey AS id FROM part)"""


C8, C12, RETURNS = _copart_sql("l_quantity < 8"), _copart_sql("l_quantity < 12"), _copart_sql("l_returnflag = 'R' AND l_quantity < 15")
PURCHASE = """e AS (SELECT DISTINCT user_id AS src, nxt AS dst FROM (SELECT user_id, lead(user_id) OVER (PARTITION BY date_trunc('hour', ts) ORDER BY ts, event_id) AS nxt FROM events WHERE event_type = 'purchase') WHERE nxt IS NOT NULL AND nxt <> user_id),
v AS (SELECT DISTINCT user_id AS id FROM events)"""
KNN2 = """q AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(round(CAST(x AS DOUBLE) * 1000) AS BIGINT)) AS e FROM embeddings),
d AS (SELECT a.vec_id AS src, b.vec_id AS dst, list_sum(list_transform(list_zip(a.e, b.e), lambda z: (z[1] - z[2]) * (z[1] - z[2]))) AS d FROM q a, q b WHERE a.vec_id <> b.vec_id),
e AS MATERIALIZED (SELECT src, dst FROM (SELECT src, dst, row_number() OVER (PARTITION BY src ORDER BY d, dst) AS r FROM d) WHERE r <= 2),
v AS (SELECT vec_id AS id FROM embeddings)"""
SYM = "u AS (SELECT DISTINCT src, dst FROM (SELECT src, dst FROM e UNION ALL SELECT dst, src FROM e) WHERE src <> dst)"
SOURCE = "s AS (SELECT src AS id FROM e GROUP BY src ORDER BY count(*) DESC, src LIMIT 1)"
PRIO = "p AS (SELECT id, row_number() OVER (ORDER BY (id * 2654435761 + 12345) % 4294967296, id) - 1 AS prio FROM v)"
CLOSURE = "c(a, b) AS (SELECT id, id FROM v UNION SELECT c.a, e.dst FROM c JOIN e ON c.b = e.src)"
SCC = "scc AS (SELECT x.a AS id, min(x.b) AS comp FROM c x JOIN c y ON x.a = y.b AND x.b = y.a GROUP BY x.a)"
UCLOSURE = "c(a, b) AS (SELECT id, id FROM v UNION SELECT c.a, u.dst FROM c JOIN u ON c.b = u.src)"
CC = "cc AS (SELECT a AS id, min(b) AS comp FROM c GROUP BY a)"
#: Distances of all pairs, as the length of the round in which a pair first appears.
PAIRS = "t(a, b, dist) USING KEY (a, b) AS (SELECT id, id, 0 FROM v UNION SELECT t.a, u.dst, t.dist + 1 FROM t JOIN u ON t.b = u.src WHERE NOT EXISTS (SELECT 1 FROM recurring.t r WHERE r.a = t.a AND r.b = u.dst))"


def _c12(spark: SparkSession, sf_dir: str) -> Graph:
    g = R.copart(spark, sf_dir, 12)
    return Graph(g.vertices, cut(g.edges))


def _source(g: Graph) -> DataFrame:
    return cut(g.edges.groupBy(F.col("src").alias("id")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "id").limit(1).select("id"))


@_query(f"WITH {C12} SELECT src, dst FROM e")
def edge_scan(spark, sf_dir):
    return R.copart(spark, sf_dir, 12).edges


@_query(f"WITH {C12} SELECT id FROM v")
def vertex_scan(spark, sf_dir):
    return R.copart(spark, sf_dir, 12).vertices


@_query(f"WITH {PURCHASE} SELECT src, dst FROM e")
def edge_scan_events(spark, sf_dir):
    return R.purchasers(spark, sf_dir).edges


@_query(f"WITH {KNN2} SELECT src, dst FROM e")
def knn_edges(spark, sf_dir):
    return R.knn(spark, sf_dir, 2).edges


@_query(f"WITH {C12} SELECT dst AS src, src AS dst FROM e")
def transpose(spark, sf_dir):
    return construct.transpose(R.copart(spark, sf_dir, 12).edges)


@_query(f"WITH {C12}, {SYM} SELECT src, dst FROM u")
def symmetrize(spark, sf_dir):
    return construct.symmetrize(R.copart(spark, sf_dir, 12).edges)


@_query(f"WITH {C12} SELECT src, dst FROM e WHERE (src + dst) % 2 = 0")
def edge_predicate(spark, sf_dir):
    return R.copart(spark, sf_dir, 12).where((F.col("src") + F.col("dst")) % 2 == 0).edges


@_query(f"WITH {C12} SELECT id, count(src) AS degree FROM v LEFT JOIN e ON id = src GROUP BY id")
def out_degree(spark, sf_dir):
    return construct.out_degree(R.copart(spark, sf_dir, 12))


@_query(f"WITH {C12} SELECT id, count(dst) AS degree FROM v LEFT JOIN e ON id = dst GROUP BY id")
def in_degree(spark, sf_dir):
    return construct.in_degree(R.copart(spark, sf_dir, 12))


@_query(f"WITH {C12}, d AS (SELECT id, count(src) AS degree FROM v LEFT JOIN e ON id = src GROUP BY id) SELECT degree, count(*) AS n FROM d GROUP BY degree")
def degree_hist(spark, sf_dir):
    return construct.out_degree(R.copart(spark, sf_dir, 12)).groupBy("degree").agg(F.count("*").alias("n"))


@_query(f"WITH {C12} SELECT id FROM v WHERE NOT (id IN (SELECT src FROM e) AND id IN (SELECT dst FROM e))")
def trim_once(spark, sf_dir):
    return construct.trim(R.copart(spark, sf_dir, 12))[0]


@_query(f"WITH {C12} SELECT id FROM v WHERE id IN (SELECT src FROM e) AND id IN (SELECT dst FROM e)")
def core_once(spark, sf_dir):
    return construct.core(R.copart(spark, sf_dir, 12))


@_query(f"WITH RECURSIVE {RETURNS} SELECT id FROM v")
def trim_all(spark, sf_dir):
    """Where the graph of returned parts has no cycle, as at 0.1, iterated trimming takes all of it; a cycle stays."""
    return construct.trim(R.copart(spark, sf_dir, 15, returned=True), iterate=True)[0]


#: ids that a cycle leads to, and ids that lead to one: an edge is on a cycle if its end leads back to its start.
BETWEEN = """y AS (SELECT DISTINCT e.src AS id FROM e JOIN c ON c.a = e.dst AND c.b = e.src),
behind AS (SELECT DISTINCT c.b AS id FROM c JOIN y ON c.a = y.id), ahead AS (SELECT DISTINCT c.a AS id FROM c JOIN y ON c.b = y.id)"""


@_query(f"WITH RECURSIVE {C12}, {CLOSURE}, {BETWEEN} SELECT id FROM v WHERE NOT (id IN (FROM behind) AND id IN (FROM ahead))")
def trim_contracted(spark, sf_dir):
    return peel.trim(_c12(spark, sf_dir))[0]


@_query(f"WITH RECURSIVE {C8}, {CLOSURE}, {BETWEEN} SELECT id FROM v WHERE id IN (FROM behind) AND id IN (FROM ahead)")
def core_contracted(spark, sf_dir):
    """Few lines make long paths here, beside some cycles."""
    return peel.trim(R.copart(spark, sf_dir, 8))[1].vertices


@_query(f"WITH RECURSIVE {KNN2}, {CLOSURE}, {BETWEEN} SELECT e.src, e.dst FROM e WHERE e.src IN (FROM behind) AND e.src IN (FROM ahead) AND e.dst IN (FROM behind) AND e.dst IN (FROM ahead)")
def core_edges(spark, sf_dir):
    """Every vector has neighbours, but some are nobody's."""
    return peel.trim(R.knn(spark, sf_dir, 2))[1].edges



@_query("""WITH k AS (SELECT DISTINCT o_custkey AS c, l_suppkey AS s FROM orders JOIN lineitem ON o_orderkey = l_orderkey WHERE l_quantity < 2),
x AS (SELECT DISTINCT 'c' AS kind, c AS num FROM k UNION SELECT DISTINCT 's', s FROM k) SELECT kind, num, row_number() OVER (ORDER BY kind, num) - 1 AS id FROM x""")
def densify_ids(spark, sf_dir):
    return R.tagged_keys(R.customer_suppliers(spark, sf_dir))


@_query(f"WITH {C12}, d AS (SELECT id, count(src) AS n FROM v LEFT JOIN e ON id = src GROUP BY id) SELECT id, CAST(coalesce(sum(n) OVER (ORDER BY id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS \"begin\" FROM d")
def csr_offsets(spark, sf_dir):
    return construct.csr_offsets(R.copart(spark, sf_dir, 12))


@_query(f"WITH RECURSIVE {C12}, {SOURCE}, r(id) AS (SELECT id FROM s UNION SELECT e.dst FROM r JOIN e ON r.id = e.src) SELECT id FROM r")
def reach_fwd(spark, sf_dir):
    g = _c12(spark, sf_dir)
    return traverse.reach(g.edges, _source(g))


@_query(f"WITH RECURSIVE {C12}, {SOURCE}, r(id) AS (SELECT id FROM s UNION SELECT e.src FROM r JOIN e ON r.id = e.dst) SELECT id FROM r")
def reach_bwd(spark, sf_dir):
    g = _c12(spark, sf_dir)
    return traverse.reach(g.edges, _source(g), "in")


_BOTH = f"WITH RECURSIVE {C12}, {SOURCE}, r(id) AS (SELECT id FROM s UNION SELECT e.dst FROM r JOIN e ON r.id = e.src), b(id) AS (SELECT id FROM s UNION SELECT e.src FROM b JOIN e ON b.id = e.dst)"


@_query(f"{_BOTH} SELECT id FROM r INTERSECT SELECT id FROM b")
def reach_both(spark, sf_dir):
    g = _c12(spark, sf_dir)
    ahead, behind = traverse.reach_both(g.edges, _source(g))
    return ahead.intersect(behind)


@_query(f"{_BOTH} SELECT coalesce(r.id, b.id) AS id FROM r FULL JOIN b ON r.id = b.id WHERE r.id IS NULL OR b.id IS NULL")
def reach_xor(spark, sf_dir):
    g = _c12(spark, sf_dir)
    a, behind = traverse.reach_both(g.edges, _source(g))
    b = behind.withColumnRenamed("id", "b")
    return a.join(b, F.col("id") == F.col("b"), "full").where("id is null or b is null").select(F.coalesce("id", "b").alias("id"))


_BFS = "b(id, dist) USING KEY (id) AS (SELECT id, 0 FROM s UNION SELECT e.dst, b.dist + 1 FROM b JOIN e ON b.id = e.src WHERE NOT EXISTS (SELECT 1 FROM recurring.b r WHERE r.id = e.dst))"


@_query(f"WITH RECURSIVE {C12}, {SOURCE}, {_BFS} SELECT id, CAST(dist AS INT) AS dist FROM b")
def bfs_dist(spark, sf_dir):
    g = _c12(spark, sf_dir)
    return traverse.bfs(g.edges, _source(g))


@_query(f"WITH RECURSIVE {KNN2}, s AS (SELECT min(id) AS id FROM v), {_BFS} SELECT CAST(dist AS INT) AS dist, count(*) AS n FROM b GROUP BY dist")
def bfs_levels(spark, sf_dir):
    """High diameter: many hops for each job matter here."""
    g = R.knn(spark, sf_dir, 2)
    return traverse.bfs(cut(g.edges), g.vertices.agg(F.min("id").alias("id")), hops=8).groupBy("dist").agg(F.count("*").alias("n"))


@_query(f"WITH {C12}, {SOURCE} SELECT DISTINCT e.dst AS id FROM e WHERE e.src IN (SELECT id FROM s) AND e.dst NOT IN (SELECT id FROM s)")
def neighbour_pull(spark, sf_dir):
    g = _c12(spark, sf_dir)
    s = _source(g).withColumnRenamed("id", "s")
    edges_in = g.edges.join(F.broadcast(s), F.col("src") == F.col("s"), "left_semi")
    return g.vertices.join(s, F.col("id") == F.col("s"), "left_anti").join(edges_in, F.col("id") == F.col("dst"), "left_semi")


@_query(f"WITH RECURSIVE {KNN2}, r(id, label) AS (SELECT id, id FROM v UNION SELECT e.dst, r.label FROM r JOIN e ON r.id = e.src) SELECT id, label FROM r")
def multi_reach(spark, sf_dir):
    g = R.knn(spark, sf_dir, 2)
    return pairs.multi_reach(cut(g.edges), g.vertices)


@_query(f"WITH RECURSIVE {C12}, w AS (SELECT e.* FROM e WHERE src % 3 = dst % 3), r(id, label) AS (SELECT id, id FROM v UNION SELECT w.dst, r.label FROM r JOIN w ON r.id = w.src) SELECT id, label FROM r")
def multi_reach_parts(spark, sf_dir):
    g = _c12(spark, sf_dir)
    return traverse.multi_reach(g.edges, g.vertices, g.vertices.select("id", (F.col("id") % 3).alias("part")))


@_query(f"WITH RECURSIVE {C12}, {CLOSURE}, {SCC} SELECT id, comp FROM scc")
def scc_labels(spark, sf_dir):
    return scc.scc(_c12(spark, sf_dir))


@_query(f"WITH RECURSIVE {C8}, {CLOSURE}, {SCC} SELECT comp, count(*) AS size FROM scc GROUP BY comp")
def scc_sizes(spark, sf_dir):
    return stats.component_sizes(scc.scc(R.copart(spark, sf_dir, 8)))


@_query(f"WITH RECURSIVE {PURCHASE}, {CLOSURE}, {SCC} SELECT comp, count(*) AS size FROM scc GROUP BY comp ORDER BY size DESC, comp LIMIT 1")
def scc_top(spark, sf_dir):
    return stats.top_component(scc.scc(R.purchasers(spark, sf_dir)))


@_query(f"WITH RECURSIVE {C8}, {CLOSURE}, {SCC}, z AS (SELECT comp, count(*) AS size FROM scc GROUP BY comp) SELECT CAST(sum(size) AS BIGINT) AS n, (SELECT count(*) FROM e) AS m, count(*) AS components, max(size) AS largest, max(size) / sum(size) AS share FROM z")
def scc_stats(spark, sf_dir):
    g = R.copart(spark, sf_dir, 8)
    return stats.graph_stats(g, scc.scc(g))


@_query(f"WITH RECURSIVE {KNN2}, {CLOSURE}, {SCC} SELECT DISTINCT x.comp AS src, y.comp AS dst FROM e JOIN scc x ON e.src = x.id JOIN scc y ON e.dst = y.id WHERE x.comp <> y.comp")
def scc_condensation(spark, sf_dir):
    g = R.knn(spark, sf_dir, 2)
    g = Graph(g.vertices, cut(g.edges))
    return scc.condensation(g, scc.scc(g))


@_query(f"WITH RECURSIVE {RETURNS}, {SYM}, {UCLOSURE}, {CC} SELECT id, comp FROM cc")
def cc_labels(spark, sf_dir):
    return cc.connected_components(R.copart(spark, sf_dir, 15, returned=True))


@_query(f"WITH RECURSIVE {C8}, {SYM}, {UCLOSURE}, {CC} SELECT comp, count(*) AS size FROM cc GROUP BY comp")
def cc_sizes(spark, sf_dir):
    return stats.component_sizes(cc.connected_components(R.copart(spark, sf_dir, 8)))


@_query(f"WITH RECURSIVE {C8.replace('e AS MATERIALIZED (', 'f AS (')}, e AS (SELECT * FROM f WHERE (src + dst) % 2 = 0), {SYM}, {UCLOSURE}, {CC} SELECT id, comp FROM cc")
def cc_filtered(spark, sf_dir):
    return cc.connected_components(R.copart(spark, sf_dir, 8).where((F.col("src") + F.col("dst")) % 2 == 0))


@_query(f"WITH RECURSIVE {RETURNS}, {SYM}, {UCLOSURE}, {CC} SELECT comp AS label, count(*) AS n FROM cc GROUP BY comp ORDER BY n DESC, comp LIMIT 1")
def dominant_label(spark, sf_dir):
    return cc.dominant_label(cc.connected_components(R.copart(spark, sf_dir, 15, returned=True)).withColumnRenamed("comp", "label"))


@_query(f"WITH RECURSIVE {RETURNS}, {SYM}, {UCLOSURE}, {CC} SELECT count(*) - count(DISTINCT comp) AS edges, 0 AS foreign_edges, 0 AS moved FROM cc")
def spanning_forest(spark, sf_dir):
    """Invariants: n - c edges, all of the graph, and the same components."""
    g = R.copart(spark, sf_dir, 15, returned=True)
    forest = cut(cc.spanning_forest(g))
    u = construct.symmetrize(g.edges).select(F.col("src").alias("a"), F.col("dst").alias("b"))
    foreign = forest.join(u, (F.col("src") == F.col("a")) & (F.col("dst") == F.col("b")), "left_anti").agg(F.count("*").cast("int").alias("foreign_edges"))
    other = cc.connected_components(Graph(g.vertices, forest)).select(F.col("id").alias("i"), F.col("comp").alias("c"))
    moved = cc.connected_components(g).join(other, F.col("id") == F.col("i")).where("comp <> c").agg(F.count("*").cast("int").alias("moved"))
    return forest.agg(F.count("*").alias("edges")).join(foreign, F.lit(True)).join(moved, F.lit(True))


_LE = f"l AS (SELECT b AS target, a AS source, dist, prio, min(dist) OVER (PARTITION BY b ORDER BY prio ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS best FROM t JOIN p ON p.id = t.a)"


def _knn_sym(spark, sf_dir) -> Graph:
    g = R.knn(spark, sf_dir, 2)
    return Graph(g.vertices, cut(construct.symmetrize(g.edges)), True)


@_query(f"WITH RECURSIVE {KNN2}, {SYM}, {PRIO}, {PAIRS}, {_LE} SELECT target, source, CAST(dist AS INT) AS dist FROM l WHERE best IS NULL OR dist < best")
def le_lists(spark, sf_dir):
    return decompose.le_lists(_knn_sym(spark, sf_dir))


@_query(f"WITH RECURSIVE {KNN2}, {SYM}, {PRIO}, {PAIRS}, {_LE} SELECT count(*) AS n FROM l WHERE best IS NULL OR dist < best")
def le_list_size(spark, sf_dir):
    return decompose.le_lists(_knn_sym(spark, sf_dir)).agg(F.count("*").alias("n"))


@_query("SELECT o_orderkey, o_custkey, o_totalprice FROM (SELECT o_orderkey, o_custkey, o_totalprice, min(o_totalprice) OVER (PARTITION BY o_custkey ORDER BY o_orderkey ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS best FROM orders) WHERE best IS NULL OR o_totalprice < best")
def prefix_min_filter(spark, sf_dir):
    return decompose.prefix_min(R.table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_totalprice"), "o_custkey", "o_orderkey", "o_totalprice")


_LDD = f"WITH RECURSIVE {KNN2}, {SYM}, {PRIO}, {PAIRS}, l AS (SELECT b AS id, arg_min(a, (CAST(ceil(ln(prio + 1.0) / 0.2) AS INT) + dist, prio)) AS center FROM t JOIN p ON p.id = t.a GROUP BY b)"


@_query(f"{_LDD} SELECT id, center FROM l")
def ldd(spark, sf_dir):
    return decompose.ldd(_knn_sym(spark, sf_dir)).select("id", "center")


@_query(f"{_LDD} SELECT x.center AS src_label, y.center AS dst_label, count(*) AS n FROM u JOIN l x ON u.src = x.id JOIN l y ON u.dst = y.id WHERE x.center <> y.center GROUP BY 1, 2")
def ldd_cut_edges(spark, sf_dir):
    g = _knn_sym(spark, sf_dir)
    return construct.crossing(g.edges, decompose.ldd(g).select("id", F.col("center").alias("label"))).groupBy("src_label", "dst_label").agg(F.count("*").alias("n"))


@_query(f"WITH RECURSIVE {C12}, {SYM}, x AS (SELECT src AS k, dst AS v FROM e) SELECT k, count(*) AS times, bool_or(v = 17) AS has_17 FROM x GROUP BY k")
def multimap_ops(spark, sf_dir):
    return R.copart(spark, sf_dir, 12).edges.groupBy(F.col("src").alias("k")).agg(F.count("*").alias("times"), F.bool_or(F.col("dst") == 17).alias("has_17"))


@_query(f"WITH {C8.replace('e AS MATERIALIZED (', 'x AS (').replace('v AS', 'vv AS')}, {C12} SELECT 'intersect' AS op, count(*) AS n FROM (SELECT * FROM x INTERSECT SELECT * FROM e) UNION ALL SELECT 'difference', count(*) FROM (SELECT * FROM e EXCEPT SELECT * FROM x) UNION ALL SELECT 'union', count(*) FROM (SELECT * FROM e UNION SELECT * FROM x)")
def set_ops_edges(spark, sf_dir):
    a, b = R.copart(spark, sf_dir, 8).edges, R.copart(spark, sf_dir, 12).edges
    n = lambda op, df: df.agg(F.lit(op).alias("op"), F.count("*").alias("n"))
    return n("intersect", a.intersect(b)).unionByName(n("difference", b.subtract(a))).unionByName(n("union", a.union(b).distinct()))


@_query("SELECT event_type, exp(avg(ln(value)) FILTER (WHERE value > 0)) AS geo_mean FROM events GROUP BY event_type")
def geo_mean_value(spark, sf_dir):
    return R.table(spark, sf_dir, "events").groupBy("event_type").agg(stats.geometric_mean(F.col("value")).alias("geo_mean"))


@_query("WITH r AS (SELECT l_orderkey, min(l_tax) AS a, min(l_discount) AS b FROM lineitem GROUP BY l_orderkey) SELECT l_orderkey, CASE WHEN b > 0 THEN least(a, b) ELSE a END AS best FROM r")
def best_of(spark, sf_dir):
    r = R.table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.min("l_tax").alias("a"), F.min("l_discount").alias("b")).withColumn("b", F.when(F.col("b") > 0, F.col("b")))
    return r.select("l_orderkey", stats.best_of("a", "b").alias("best"))


@_query("WITH t AS (SELECT user_id, sum(value) FILTER (WHERE event_type = 'view') AS v, sum(value) FILTER (WHERE event_type = 'purchase') AS p FROM events GROUP BY user_id) SELECT user_id, v / p AS speedup FROM t WHERE p > 0")
def speedup(spark, sf_dir):
    t = R.table(spark, sf_dir, "events").groupBy("user_id").agg(F.sum(F.when(F.col("event_type") == "view", F.col("value"))).alias("v"), F.sum(F.when(F.col("event_type") == "purchase", F.col("value"))).alias("p"))
    return t.where("p > 0").select("user_id", (F.col("v") / F.col("p")).alias("speedup"))


@_query("SELECT l_shipmode_y AS y, coalesce(sum(q) FILTER (WHERE f = 'A'), 0) AS \"A\", coalesce(sum(q) FILTER (WHERE f = 'N'), 0) AS \"N\", sum(q) - coalesce(sum(q) FILTER (WHERE f = 'A'), 0) - coalesce(sum(q) FILTER (WHERE f = 'N'), 0) AS others FROM (SELECT CAST(year(l_shipdate) AS INT) AS l_shipmode_y, l_returnflag AS f, l_quantity AS q FROM lineitem) GROUP BY 1")
def phase_breakdown(spark, sf_dir):
    rows = R.table(spark, sf_dir, "lineitem").select(F.year("l_shipdate").alias("y"), F.col("l_returnflag").alias("f"), F.col("l_quantity").alias("q"))
    rows = rows.unionByName(rows.withColumn("f", F.lit("total")))
    return stats.phase_breakdown(rows, "y", "f", "q", ["A", "N"], "total")


@_query("SELECT l_suppkey, avg(l_quantity) AS mean FROM lineitem WHERE l_linenumber > 1 GROUP BY l_suppkey")
def after_warm_up(spark, sf_dir):
    return stats.after_warm_up(R.table(spark, sf_dir, "lineitem"), ["l_suppkey"], "l_linenumber", "l_quantity")


@_query(f"WITH {C12}, {PRIO} SELECT id, prio FROM p")
def permutation(spark, sf_dir):
    return priorities(R.copart(spark, sf_dir, 12).vertices)


@_query(f"WITH RECURSIVE {C12}, {SOURCE}, {_BFS} SELECT CAST(max(dist) AS BIGINT) AS rounds, CAST(ceil(max(dist) / {HOPS}) AS BIGINT) AS jobs, max(dist) / ceil(max(dist) / {HOPS}) AS ratio FROM b")
def bfs_rounds(spark, sf_dir):
    g = _c12(spark, sf_dir)
    return stats.rounds(traverse.bfs(g.edges, _source(g), hops=HOPS), HOPS)


@_query(f"WITH RECURSIVE {C12}, {SOURCE}, {_BFS}, d AS (SELECT src, count(*) AS d FROM e GROUP BY src) SELECT CAST(dist AS INT) AS dist, count(*) AS n, CAST(coalesce(sum(d), 0) AS BIGINT) AS degrees FROM b LEFT JOIN d ON id = src GROUP BY dist")
def bfs_frontiers(spark, sf_dir):
    g = _c12(spark, sf_dir)
    return stats.frontiers(g, g.bfs(_source(g)))


@_query(f"WITH RECURSIVE {C12}, {SOURCE}, {_BFS} SELECT src AS id, count(*) AS degree FROM e WHERE dst NOT IN (SELECT id FROM b WHERE dist <= 2) GROUP BY src")
def effective_degree(spark, sf_dir):
    g = _c12(spark, sf_dir)
    return traverse.effective_degree(g.edges, g.bfs(_source(g)), 2)


@_query(f"WITH RECURSIVE {KNN2}, r(id, label) AS (SELECT id, id FROM v UNION SELECT e.dst, r.label FROM r JOIN e ON r.id = e.src) SELECT id, max(label) AS label FROM r GROUP BY id")
def greatest_label(spark, sf_dir):
    g = R.knn(spark, sf_dir, 2)
    return traverse.greatest_reaching(cut(g.edges), g.vertices.select("id", F.col("id").alias("label")))


@_query(f"""WITH RECURSIVE {KNN2}, {SYM}, {PRIO}, {PAIRS}, l AS MATERIALIZED (SELECT b AS id, arg_min(a, (CAST(ceil(ln(prio + 1.0) / 0.2) AS INT) + dist, prio)) AS center, min(CAST(ceil(ln(prio + 1.0) / 0.2) AS INT) + dist) AS arrival FROM t JOIN p ON p.id = t.a GROUP BY b),
up AS (SELECT u.dst AS d, min(u.src) AS parent FROM u JOIN l x ON x.id = u.src JOIN l y ON y.id = u.dst WHERE x.center = y.center AND y.arrival = x.arrival + 1 GROUP BY u.dst)
SELECT id, center, CASE WHEN id = center THEN id ELSE parent END AS parent FROM l LEFT JOIN up ON d = id""")
def ldd_parents(spark, sf_dir):
    return _knn_sym(spark, sf_dir).ldd()


@_query("SELECT CAST(0 AS BIGINT) AS differing")
def le_list_check(spark, sf_dir):
    """Lists made with several hops a job against those made hop by hop, both ways."""
    g = _knn_sym(spark, sf_dir)
    return decompose.differing(g.le_lists(), decompose.le_lists(g, hops=1)).agg(F.count("*").alias("differing"))


@_query("SELECT l_linenumber, avg(l_quantity) FILTER (WHERE l_returnflag = 'A') AS \"A\", avg(l_quantity) FILTER (WHERE l_returnflag = 'N') AS \"N\", avg(l_quantity) FILTER (WHERE l_returnflag = 'R') AS \"R\" FROM lineitem GROUP BY l_linenumber")
def sweep_pivot(spark, sf_dir):
    return stats.pivot_mean(R.table(spark, sf_dir, "lineitem"), "l_linenumber", "l_returnflag", "l_quantity", ["A", "N", "R"])


@_query(f"WITH {C12}, s AS (SELECT id FROM v WHERE id IN (SELECT dst FROM e)) SELECT count(*) AS degrees FROM e WHERE src IN (SELECT id FROM s)")
def degree_sum(spark, sf_dir):
    g = _c12(spark, sf_dir)
    return construct.degree_sum(g, g.edges.select(F.col("dst").alias("id")).distinct())


@_query(f"WITH {C12}, {PRIO} SELECT id, prio FROM p WHERE prio >= 128 AND prio < 256")
def priority_batch(spark, sf_dir):
    return construct.batch(priorities(R.copart(spark, sf_dir, 12).vertices), 128, 256)


@_query("""WITH k AS (SELECT DISTINCT o_custkey AS c, l_suppkey AS s FROM orders JOIN lineitem ON o_orderkey = l_orderkey WHERE l_quantity < 2),
x AS (SELECT DISTINCT 'c' AS kind, c AS num FROM k UNION SELECT DISTINCT 's', s FROM k), d AS (SELECT kind, num, row_number() OVER (ORDER BY kind, num) - 1 AS id FROM x)
SELECT a.id AS src, b.id AS dst FROM k JOIN d a ON a.kind = 'c' AND a.num = c JOIN d b ON b.kind = 's' AND b.num = s""")
def adj_round_trip(spark, sf_dir):
    """The graph of customers and suppliers, written as .adj text and read again."""
    g = R.dense_customer_suppliers(spark, sf_dir)
    path = f"{shared_dir(spark)}/quillgraph/graph-{uuid.uuid4().hex}.adj"
    csr.write_adj(Graph(cut(g.vertices), cut(g.edges)), path)
    return csr.read(spark, path).edges


@_query(f"WITH RECURSIVE {C12}, {CLOSURE}, {SCC} SELECT id, comp FROM scc")
def scc_batched(spark, sf_dir):
    return scc.scc(_c12(spark, sf_dir), method="batches", beta=8)


@_query(f"WITH RECURSIVE {KNN2}, {CLOSURE}, {SCC} SELECT id, comp FROM scc")
def scc_batched_knn(spark, sf_dir):
    """Long paths and many small components."""
    g = R.knn(spark, sf_dir, 2)
    return scc.scc(Graph(g.vertices, cut(g.edges)), method="batches", beta=8)


@_query(f"WITH RECURSIVE {RETURNS}, {SYM}, {UCLOSURE}, {CC} SELECT id, comp FROM cc")
def cc_by_decomposition(spark, sf_dir):
    return cc.by_decomposition(R.copart(spark, sf_dir, 15, returned=True), beta=1.0)[0]


@_query(f"WITH RECURSIVE {RETURNS}, {SYM}, {UCLOSURE}, {CC} SELECT count(*) - count(DISTINCT comp) AS edges, 0 AS foreign_edges, 0 AS moved FROM cc")
def forest_by_decomposition(spark, sf_dir):
    """Invariants of a spanning forest, as of spanning_forest, from the cluster trees."""
    g = R.copart(spark, sf_dir, 15, returned=True)
    comp, forest = cc.by_decomposition(g, beta=1.0)
    forest = cut(forest)
    u = construct.symmetrize(g.edges).select(F.col("src").alias("a"), F.col("dst").alias("b"))
    foreign = forest.join(u, (F.col("src") == F.col("a")) & (F.col("dst") == F.col("b")), "left_anti").agg(F.count("*").cast("int").alias("foreign_edges"))
    other = cc.connected_components(Graph(g.vertices, forest)).select(F.col("id").alias("i"), F.col("comp").alias("c"))
    moved = comp.join(other, F.col("id") == F.col("i")).where("comp <> c").agg(F.count("*").cast("int").alias("moved"))
    return forest.agg(F.count("*").alias("edges")).join(foreign, F.lit(True)).join(moved, F.lit(True))


@_query(f"""WITH RECURSIVE {RETURNS}, {SYM}, {UCLOSURE}, {CC}, p AS (SELECT comp, row_number() OVER (ORDER BY id) - 1 AS place, count(*) OVER () AS n FROM cc),
d AS (SELECT (i * 2654435761 + 12345) % 4294967296 % (SELECT max(n) FROM p) AS place FROM range(10000) r(i)) SELECT comp AS label, count(*) / 10000 AS share FROM d JOIN p USING (place) GROUP BY comp ORDER BY share DESC, label LIMIT 1""")
def dominant_label_sampled(spark, sf_dir):
    return cc.sampled_mode(cc.connected_components(R.copart(spark, sf_dir, 15, returned=True)).withColumnRenamed("comp", "label"))


@_query(f"WITH RECURSIVE {KNN2}, {SYM}, {PRIO}, {PAIRS}, {_LE} SELECT target, source, CAST(dist AS INT) AS dist FROM l WHERE best IS NULL OR dist < best")
def le_lists_batched(spark, sf_dir):
    return decompose.le_lists_batched(_knn_sym(spark, sf_dir), beta=4)


def _violations(variant: str) -> str:
    """SQL for what is wrong with the lists of a table, by subqueries instead of the operator's joins and running minima."""
    t = f"list_{variant}"
    return f"""SELECT '{variant}' AS variant, 'own' AS kind, count(*) AS violations FROM v WHERE NOT EXISTS (SELECT 1 FROM {t} x WHERE x.target = v.id AND x.source = v.id AND x.dist = 0)
UNION ALL SELECT '{variant}', 'unfounded', count(*) FROM {t} x WHERE NOT (target = source AND dist = 0) AND NOT EXISTS (SELECT 1 FROM u JOIN {t} y ON y.target = u.src WHERE u.dst = x.target AND y.source = x.source AND y.dist + 1 = x.dist)
UNION ALL SELECT '{variant}', 'order', count(*) FROM {t} x WHERE EXISTS (SELECT 1 FROM {t} y WHERE y.target = x.target AND y.prio < x.prio AND y.dist <= x.dist)
UNION ALL SELECT '{variant}', 'missing', count(*) FROM (SELECT u.dst AS target, x.prio, min(x.dist) + 1 AS due FROM {t} x JOIN u ON u.src = x.target GROUP BY ALL) c WHERE NOT EXISTS (SELECT 1 FROM {t} y WHERE y.target = c.target AND y.prio <= c.prio AND y.dist <= c.due)"""


@_query(f"""WITH RECURSIVE {KNN2}, {SYM}, {PRIO}, {PAIRS}, {_LE}, list_exact AS MATERIALIZED (SELECT target, source, dist, prio FROM l WHERE best IS NULL OR dist < best),
list_missing AS MATERIALIZED (SELECT * FROM list_exact WHERE (target * 7 + source) % 11 <> 0), list_far AS MATERIALIZED (SELECT target, source, dist + CASE WHEN target % 13 = 0 AND dist > 0 THEN 1 ELSE 0 END AS dist, prio FROM list_exact)
{" UNION ALL ".join(map(_violations, ("exact", "missing", "far")))}""")
def le_list_certificate(spark, sf_dir):
    """The lists as they are, without some rows, and with some distances one too far."""
    g = _knn_sym(spark, sf_dir)
    exact = cut(g.le_lists())
    damaged = {
        "exact": exact,
        "missing": exact.where((F.col("target") * 7 + F.col("source")) % 11 != 0),
        "far": exact.withColumn("dist", F.col("dist") + F.when((F.col("target") % 13 == 0) & (F.col("dist") > 0), 1).otherwise(0)),
    }
    out = None
    for variant, lists in damaged.items():
        found = decompose.certificate(g, lists).withColumn("variant", F.lit(variant))
        out = found if out is None else out.unionByName(found)
    return out.select("variant", "kind", "violations")


@_query(f"""WITH RECURSIVE {C12}, {SOURCE}, {_BFS}, m AS (SELECT max(dist) AS m FROM b), j AS (SELECT h AS hops, unnest(range(1, m // h + 2)) AS job FROM m, (VALUES (1), (4)) x(h))
SELECT CAST(hops AS INT) AS hops, job, count(dist) AS found, count(dist) FILTER (WHERE dist = job * hops) AS frontier FROM j LEFT JOIN b ON dist > (job - 1) * hops AND dist <= job * hops GROUP BY hops, job""")
def counted_rounds(spark, sf_dir):
    """What the jobs of two searches counted as they ran: one hop a job, and four."""
    from .plans.loop import Phases

    g, out = _c12(spark, sf_dir), None
    source = _source(g)
    for hops in (1, 4):
        phases = Phases()
        traverse.bfs(g.edges, source, hops=hops, phases=phases)
        rows = phases.table(spark).select("hops", (F.col("round") + 1).alias("job"), F.col("n").alias("found"), "frontier")
        out = rows if out is None else out.unionByName(rows)
    return out


_DENSE = """WITH k AS (SELECT DISTINCT o_custkey AS c, l_suppkey AS s FROM orders JOIN lineitem ON o_orderkey = l_orderkey WHERE l_quantity < 2),
x AS (SELECT DISTINCT 'c' AS kind, c AS num FROM k UNION SELECT DISTINCT 's', s FROM k), d AS (SELECT kind, num, row_number() OVER (ORDER BY kind, num) - 1 AS id FROM x),
e AS (SELECT a.id AS src, b.id AS dst FROM k JOIN d a ON a.kind = 'c' AND a.num = c JOIN d b ON b.kind = 's' AND b.num = s)"""


def _written(spark, sf_dir, dual: bool) -> str:
    g = R.dense_customer_suppliers(spark, sf_dir)
    path = f"{shared_dir(spark)}/quillgraph/graph-{uuid.uuid4().hex}.bin"
    csr.write_bin(Graph(cut(g.vertices), cut(g.edges)), path, dual)
    return path


@_query(f"{_DENSE} SELECT src, dst FROM e")
def bin_round_trip(spark, sf_dir):
    """The graph of customers and suppliers, written by tasks as one .bin file and read by byte ranges."""
    return csr.read_bin(spark, _written(spark, sf_dir, False), piece=100).edges


@_query(f"{_DENSE} SELECT 'out' AS block, src, dst FROM e UNION ALL SELECT 'in', dst, src FROM e WHERE dst >= (SELECT min(id) + 3 FROM d WHERE kind = 's')")
def bin_dual_round_trip(spark, sf_dir):
    """Both blocks of a dual file; of the second one, the vertices from the fourth supplier on: the reader skips the others' bytes."""
    path = _written(spark, sf_dir, True)
    out = csr.read_bin(spark, path, dual=True).edges
    first = out.agg(F.min("dst")).first()[0]
    back = csr.read_bin_transpose(spark, path, piece=64).where(F.col("src") >= F.lit(first + 3))
    return out.select(F.lit("out").alias("block"), "src", "dst").unionByName(back.select(F.lit("in").alias("block"), "src", "dst"))


@_query(f"WITH RECURSIVE {C12}, {SOURCE}, {_BFS} SELECT id, CAST(dist AS INT) AS dist FROM b")
def bfs_by_pull(spark, sf_dir):
    """The unvisited look for a neighbour in the frontier, instead of the frontier for its neighbours."""
    g = _c12(spark, sf_dir)
    return pull.bfs(g, _source(g))


@_query(f"WITH RECURSIVE {KNN2}, {SYM}, {PRIO}, {PAIRS}, {_LE} SELECT target, CAST(row_number() OVER (PARTITION BY target ORDER BY prio) AS INT) AS place, source, CAST(dist AS INT) AS dist FROM l WHERE best IS NULL OR dist < best")
def le_list_sorted(spark, sf_dir):
    g = _knn_sym(spark, sf_dir)
    prio = cut(priorities(g.vertices))
    return decompose.in_order(decompose.le_lists(g, prio), prio)


@_query(f"WITH {C12} SELECT id FROM v WHERE (id * 2654435761 + 12345) % 4294967296 % 100 < 7")
def hash_mod_sample(spark, sf_dir):
    return construct.hash_sample(R.copart(spark, sf_dir, 12).vertices, 7, 100)


@_query(f"WITH {C12}, p AS (SELECT id, row_number() OVER (ORDER BY id) - 1 AS place, count(*) OVER () AS n FROM v) SELECT id FROM p WHERE place IN (SELECT (i * 2654435761 + 12345) % 4294967296 % (SELECT max(n) FROM p) FROM range(1024, 2048) r(i))")
def ldd_centres(spark, sf_dir):
    return decompose.sampled_centres(R.copart(spark, sf_dir, 12).vertices)


@_query(f"""WITH {C8.replace('e AS MATERIALIZED (', 'x AS MATERIALIZED (').replace('v AS', 'vv AS')}, {C12}
SELECT 'key' AS probe, src AS k, dst AS v FROM e WHERE src IN (SELECT dst FROM x) UNION ALL SELECT 'pair', src, dst FROM e SEMI JOIN x USING (src, dst)""")
def multimap_probe(spark, sf_dir):
    """Which pairs have a key that is asked for, and which pairs are."""
    few, many = R.copart(spark, sf_dir, 8).edges, R.copart(spark, sf_dir, 12).edges.toDF("k", "v")
    by_key = construct.with_key(many, few.select(F.col("dst").alias("k")).distinct())
    by_pair = construct.with_pair(many, few.toDF("k", "v"))
    return by_key.select(F.lit("key").alias("probe"), "k", "v").unionByName(by_pair.select(F.lit("pair").alias("probe"), "k", "v"))


@_query("SELECT 'view' AS kind, count(*) AS n, sum(CAST(round(value * 1000) AS BIGINT))::DOUBLE AS total FROM events WHERE event_type = 'view' UNION ALL SELECT 'purchase', count(*), sum(CAST(round(value * 1000) AS BIGINT))::DOUBLE FROM events WHERE event_type = 'purchase'")
def log_round_trip(spark, sf_dir):
    """Events written as log lines, and the measurements of two patterns read out of them."""
    path = f"{shared_dir(spark)}/quillgraph/log-{uuid.uuid4().hex}"
    events = R.table(spark, sf_dir, "events")
    events.select(F.concat(F.lit("event "), F.col("event_type"), F.lit(" by user took: "), F.round(F.col("value") * 1000).cast("long").cast("string")).alias("value")).write.text(path)
    out = None
    for kind in ("view", "purchase"):
        found = logs.read_measurements(spark, path, f"^event {kind} ").agg(F.lit(kind).alias("kind"), F.count("*").alias("n"), F.sum("value").alias("total"))
        out = found if out is None else out.unionByName(found)
    return out


@_query("SELECT CAST(l_suppkey AS VARCHAR) AS frame, CAST(l_orderkey AS VARCHAR) AS a, CAST(l_partkey AS VARCHAR) AS b FROM lineitem WHERE l_quantity < 3")
def frames_round_trip(spark, sf_dir):
    """Files of several CSV tables, one for each supplier, after a line `graph key` each."""
    path = f"{shared_dir(spark)}/quillgraph/frames-{uuid.uuid4().hex}"
    lines = R.table(spark, sf_dir, "lineitem").where("l_quantity < 3")
    heads = lines.select("l_suppkey").distinct().select("l_suppkey", F.lit(0).alias("at"), F.concat(F.lit("graph "), F.col("l_suppkey").cast("string")).alias("value"))
    body = lines.select("l_suppkey", F.lit(1).alias("at"), F.concat_ws(", ", "l_orderkey", "l_partkey").alias("value"))
    heads.unionByName(body).repartition("l_suppkey").sortWithinPartitions("l_suppkey", "at").select("value").write.text(path)
    read = logs.read_frames(spark, path)
    return read.select("frame", F.col("values")[0].alias("a"), F.col("values")[1].alias("b"))


@_query("SELECT o_orderstatus AS status, o_orderpriority AS priority, count(*) AS n FROM orders GROUP BY ALL")
def csv_round_trip(spark, sf_dir):
    """A result written as CSV, in a folder for each status, and read again."""
    path = f"{shared_dir(spark)}/quillgraph/csv-{uuid.uuid4().hex}"
    counts = R.table(spark, sf_dir, "orders").groupBy(F.col("o_orderstatus").alias("status"), F.col("o_orderpriority").alias("priority")).agg(F.count("*").alias("n"))
    logs.write_table(counts, path, by="status")
    return spark.read.option("header", True).schema("priority string, n long, status string").csv(path).select("status", "priority", "n")


@_query(f"""WITH {C8.replace('e AS MATERIALIZED (', 'e8 AS (').replace('v AS', 'v8 AS')}, {RETURNS.replace('e AS MATERIALIZED (', 'er AS (').replace('v AS', 'vr AS')}, {C12}
SELECT 'copart12' AS name, (SELECT count(*) FROM v) AS n, (SELECT count(*) FROM e) AS m UNION ALL SELECT 'copart8', (SELECT count(*) FROM v8), (SELECT count(*) FROM e8) UNION ALL SELECT 'returns15', (SELECT count(*) FROM vr), (SELECT count(*) FROM er)""")
def catalog_sizes(spark, sf_dir):
    out = None
    for name in ("copart12", "copart8", "returns15"):
        g = R.CATALOG[name](spark, sf_dir)
        size = g.vertices.agg(F.count("*").alias("n")).join(g.edges.agg(F.count("*").alias("m")), F.lit(True)).select(F.lit(name).alias("name"), "n", "m")
        out = size if out is None else out.unionByName(size)
    return out
