"""Graphs derived from relational tables: ordered neighbours, bipartite pairs, nearest neighbours, and a torus."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..model import Graph, densify_ids


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def successive(rows: DataFrame, group: Column | str, order: list[Column | str], id: str) -> DataFrame:
    """src, dst: each row's id and that of the next row of its group, once each, without self-loops."""
    nxt = F.lead(id).over(W.partitionBy(group).orderBy(*order))
    return rows.select(F.col(id).alias("src"), nxt.alias("dst")).where("dst is not null and src <> dst").distinct()


def copart(spark: SparkSession, sf_dir: str, below: float, returned: bool = False) -> Graph:
    """Parts that follow each other in an order, of lines with a quantity under `below` (and returned, if asked for). Vertices are all parts."""
    lines = table(spark, sf_dir, "lineitem").where(F.col("l_quantity") < below)
    if returned:
        lines = lines.where("l_returnflag = 'R'")
    parts = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"))
    return Graph.of(successive(lines, "l_orderkey", ["l_linenumber", "l_partkey"], "l_partkey"), parts)


def purchasers(spark: SparkSession, sf_dir: str) -> Graph:
    """Users whose purchases follow each other within an hour. Vertices are all users."""
    events = table(spark, sf_dir, "events")
    bought = events.where("event_type = 'purchase'")
    return Graph.of(successive(bought, F.date_trunc("hour", "ts"), ["ts", "event_id"], "user_id"), events.select(F.col("user_id").alias("id")).distinct())


def customer_suppliers(spark: SparkSession, sf_dir: str, below: float = 2.0) -> DataFrame:
    """c, s: customers and the suppliers of their small lines; the two key spaces overlap."""
    lines = table(spark, sf_dir, "lineitem").where(F.col("l_quantity") < below)
    return table(spark, sf_dir, "orders").join(lines, F.col("o_orderkey") == F.col("l_orderkey")).select(F.col("o_custkey").alias("c"), F.col("l_suppkey").alias("s")).distinct()


def tagged_keys(pairs: DataFrame) -> DataFrame:
    """key and id of both key spaces: customers as 'c' and suppliers as 's' before their numbers."""
    tag = lambda t, c: F.struct(F.lit(t).alias("kind"), F.col(c).alias("num")).alias("key")
    return densify_ids(pairs.select(tag("c", "c")).union(pairs.select(tag("s", "s"))), "key").select("key.kind", "key.num", "id")


def dense_customer_suppliers(spark: SparkSession, sf_dir: str) -> Graph:
    """customer_suppliers() from customers to suppliers, with the dense ids of tagged_keys()."""
    pairs = customer_suppliers(spark, sf_dir)
    ids = tagged_keys(pairs)
    of = lambda kind, num, name: ids.where(F.col("kind") == kind).select(F.col("num").alias(num), F.col("id").alias(name))
    edges = pairs.join(of("c", "nc", "src"), F.col("c") == F.col("nc")).join(of("s", "ns", "dst"), F.col("s") == F.col("ns")).select("src", "dst")
    return Graph.of(edges, ids.select("id"))


def _nearest(x: np.ndarray, src: np.ndarray, y: np.ndarray, dst: np.ndarray, k: int, tile: int = 512) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """src, dst, d of the k nearest rows of y for every row of x, by squared distance, then dst; rows of one id aren't compared.

    Distances are one product: -2xy, the squares of x and those of y, as two more columns. Whole numbers are exact in singles
    while four times the greatest square of a vector stays under 2^24, which bounds every part of a sum in whatever order, in
    doubles up to 2^53, and both are multiplied many times faster than whole numbers, which are used beyond."""
    order = np.argsort(dst, kind="stable")
    y, dst = y[order], dst[order]
    top = 4 * max((float(np.square(e.astype(np.float64)).sum(1).max()) for e in (x, y) if e.size), default=0.0)
    kind = np.float32 if top < 2**24 else np.float64 if top < 2**53 else np.int64
    far = np.iinfo(np.int64).max if kind is np.int64 else np.inf
    xx, yy = (x * x).sum(1), (y * y).sum(1)
    left = np.column_stack([-2 * x, xx, np.ones_like(xx)]).astype(kind)
    right = np.ascontiguousarray(np.column_stack([y, np.ones_like(yy), yy]).astype(kind).T)
    at = np.searchsorted(dst, src, "left"), np.searchsorted(dst, src, "right")
    out = []
    for low in range(0, len(x), tile):
        d = left[low : low + tile] @ right
        rows = np.arange(len(d))
        for r in np.flatnonzero(at[0][low : low + tile] < at[1][low : low + tile]):
            d[r, at[0][low + r] : at[1][low + r]] = far
        for _ in range(min(k, len(dst))):
            best = d.argmin(1)  # of equal ones the first, which has the least id
            least = d[rows, best]
            some = least < far
            out.append((src[low : low + tile][some], dst[best[some]], least[some].astype(np.int64)))
            d[rows, best] = far
    return tuple(np.concatenate([o[c] for o in out]) if out else np.empty(0, np.int64) for c in range(3))


def knn(spark: SparkSession, sf_dir: str, k: int, block: int = 16384, spread: int = 8) -> Graph:
    """Directed k-nearest neighbours of the embeddings, by squared distance of values rounded to thousandths; ties by vec_id.

    Blocks of vectors meet once in pairs; each pair gives the k best of one block for every vector of the other, both ways,
    and a window keeps the k best of all. All pairs are compared, so the arithmetic is quadratic, in tasks that hold two
    blocks; a vector is sent once for each block. Fewer than spread * block vectors make `spread` blocks of 512 or more."""
    vectors = table(spark, sf_dir, "embeddings").select("vec_id", F.transform("embedding", lambda x: F.round(x.cast("double") * 1000).cast("long")).alias("e"))
    n = vectors.count()
    blocks = max(1, -(-n // block), min(spread, -(-n // 512)))
    mine = F.pmod(F.xxhash64("vec_id"), F.lit(blocks)).cast("int")
    pairs = blocks * (blocks + 1) // 2
    left = vectors.select(mine.alias("i"), F.explode(F.sequence(mine, F.lit(blocks - 1))).alias("j"), "vec_id", "e").repartition(pairs, "i", "j")
    right = vectors.select(F.explode(F.sequence(F.lit(0), mine)).alias("i"), mine.alias("j"), "vec_id", "e").repartition(pairs, "i", "j")

    def nearest(key: tuple, a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        if not len(a) or not len(b):
            return pd.DataFrame({c: np.empty(0, np.int64) for c in ("src", "dst", "d")})
        x, y = np.stack(a["e"]).astype(np.int64), np.stack(b["e"]).astype(np.int64)
        s, t = a["vec_id"].to_numpy(), b["vec_id"].to_numpy()
        ways = [_nearest(x, s, y, t, k)] + ([_nearest(y, t, x, s, k)] if key[0] != key[1] else [])
        return pd.DataFrame({c: np.concatenate([w[at] for w in ways]) for at, c in enumerate(("src", "dst", "d"))})

    near = left.groupBy("i", "j").cogroup(right.groupBy("i", "j")).applyInPandas(nearest, "src long, dst long, d long")
    rank = F.row_number().over(W.partitionBy("src").orderBy("d", "dst"))
    return Graph.of(near.withColumn("rank", rank).where(F.col("rank") <= k).select("src", "dst"), vectors.select(F.col("vec_id").alias("id")))


def torus(spark: SparkSession, side: int = 40) -> Graph:
    """side x side cells with an edge right and an edge down each, whose direction a bit of a hash gives."""
    cell = spark.range(side * side).select("id", F.floor(F.col("id") / side).alias("r"), (F.col("id") % side).alias("c"))
    to = lambda dst, x: F.when(F.shiftright((x * F.lit(2654435761) + F.lit(12345)) % F.lit(4294967296), 16).bitwiseAND(F.lit(1)) == 1, F.struct(dst.alias("src"), F.col("id").alias("dst"))).otherwise(F.struct(F.col("id").alias("src"), dst.alias("dst")))
    right = to((F.col("r") * side + (F.col("c") + 1) % side).cast("long"), F.col("id"))
    down = to(((F.col("r") + 1) % side * side + F.col("c")).cast("long"), F.col("id") + 5000)
    return Graph.of(cell.select(F.explode(F.array(right, down)).alias("e")).select("e.*"), cell.select("id"))


#: Graphs of the tables by name: each takes (spark, sf_dir).
CATALOG = {
    "copart8": lambda spark, sf_dir: copart(spark, sf_dir, 8),
    "copart12": lambda spark, sf_dir: copart(spark, sf_dir, 12),
    "returns15": lambda spark, sf_dir: copart(spark, sf_dir, 15, returned=True),
    "purchasers": purchasers,
    "customer_suppliers": dense_customer_suppliers,
    "knn2": lambda spark, sf_dir: knn(spark, sf_dir, 2),
    "torus": lambda spark, sf_dir: torus(spark),
}
