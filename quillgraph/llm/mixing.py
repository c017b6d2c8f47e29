"""Mixing sources to target weights by cube-method balanced sampling.

A source with target ratio r = target / size takes floor(r) whole copies of each of its documents, and one more copy
with inclusion probability p = r - floor(r). Which documents get that copy is decided by the cube method: the vector
of fractional probabilities is moved along the null space of the constraints (tokens and documents), which keeps
sum(p * size) and sum(p) as they are, until a coordinate reaches 0 or 1; with two constraints, three fractional units
always leave a direction to move in. Each chunk of a source runs this flight on its own, and at most two units of it
stay fractional. The leftovers of the chunks form the chunks of the next level, until one chunk for each source is
left. Only its last one or two units, the landing problem, are rounded: to the choice with the total nearest to what
it should be. So a source of any size is dealt over many tasks, its total misses the target by less than one document,
and nothing is dropped or capped.

Defined cases: null text has size 0; a null source is a source of its own and comes last. Documents of size 0 take
part in balancing the document count and never take words. An empty table, or one without words, gives no words to
any source. Rows that repeat a doc_id are units of their own, and so are rows without one. Up to a quarter of a chunk they
share a chunk and are decided by size; ids (or, without ids, texts) of more rows are dealt over chunks by the rows'
places in the table, so that no task gets all of them; which of them are taken then depends on how the table is split.
repeat() takes each row by a number of its own, and keeps as many rows of size 0 as are decided.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import WORD, cut, fresh

#: Documents in a chunk of the flight phase.
CHUNK = 4096
WEIGHTS = (3.0, 1.0, 2.0)
EPS = 1e-12


def flight(p: list[float], sizes: list[float]) -> list[float]:
    """Moves p until two units at most are fractional, keeping sum(p) and sum(p * size) (or, once only two differ, sum(p) alone is left to landing)."""
    p, live = list(p), []
    for i in range(len(p)):
        if EPS < p[i] < 1 - EPS:
            live.append(i)
            if len(live) == 3:
                a, b, c = live
                # a direction orthogonal to (1, 1, 1) and to the sizes
                u = [sizes[b] - sizes[c], sizes[c] - sizes[a], sizes[a] - sizes[b]]
                if not any(u):
                    u = [1.0, -1.0, 0.0]
                up = min(((1 - p[k]) / x if x > 0 else -p[k] / x) for k, x in zip(live, u, strict=True) if x)
                for k, x in zip(live, u, strict=True):
                    p[k] += up * x
                    if p[k] < EPS:
                        p[k] = 0.0
                    elif p[k] > 1 - EPS:
                        p[k] = 1.0
                live = [k for k in live if 0.0 < p[k] < 1.0]
    return p


def landing(p: list[float], sizes: list[float]) -> list[float]:
    """Rounds the few fractional units so that sum(p * size) comes nearest to what it is."""
    live = [i for i, x in enumerate(p) if 0.0 < x < 1.0]
    goal = sum(p[i] * sizes[i] for i in live)
    best = min(range(1 << len(live)), key=lambda m: (abs(goal - sum(sizes[i] for k, i in enumerate(live) if m >> k & 1)), m))
    for k, i in enumerate(live):
        p[i] = float(best >> k & 1)
    return p


def targets(sources: DataFrame, weights: tuple[float, ...] = WEIGHTS, share: float = 1.5, most: float = 2.0) -> DataFrame:
    """source, source_size, target of sources(source, source_size): share of all sizes by weights that repeat in the order of the code points, nulls last; what is above most times a source's size is shared again among the others.

    The cap settles in as many rounds as sources reach it; it is the water level t at which sum(min(cap, weight * t)) is
    the total. Sorted by cap / weight, prefix sums give t directly, so no loop is needed. The windows run over one row
    for each source."""
    from pyspark.sql import Window as W

    by = W.orderBy(F.col("source").isNull(), F.col("source"))
    weight = F.element_at(F.array(*map(F.lit, weights)), (F.pmod(F.row_number().over(by) - 1, F.lit(len(weights))) + 1).cast("int"))
    s = sources.withColumn("weight", weight).withColumn("cap", F.col("source_size") * most)
    order = W.orderBy(F.col("cap") / F.col("weight"), F.col("source").isNull(), F.col("source"))
    upto, every = order.rowsBetween(W.unboundedPreceding, -1), W.partitionBy()
    goal = F.sum("source_size").over(every) * share
    # the level if exactly the sources before this one are at their cap
    level = (goal - F.coalesce(F.sum("cap").over(upto), F.lit(0.0))) / (F.sum("weight").over(every) - F.coalesce(F.sum("weight").over(upto), F.lit(0.0)))
    s = s.withColumn("level", level).withColumn("below", F.col("level") <= F.col("cap") / F.col("weight"))
    water = F.coalesce(F.first(F.when(F.col("below"), F.col("level")), ignorenulls=True).over(order.rowsBetween(W.unboundedPreceding, W.unboundedFollowing)), F.lit(float("inf")))
    return s.select("source", "source_size", F.least(F.col("cap"), F.col("weight") * water).alias("target"))


def source_targets(docs: DataFrame, **options) -> DataFrame:
    """source, source_size, target of every source of docs(source, text)."""
    size = F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long")
    return targets(docs.groupBy(F.col("source").cast("string").alias("source")).agg(F.sum(size).alias("source_size")), **options)


def _fly(last: bool):
    def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["doc_id", "size", "p", "row"], na_position="first", kind="mergesort").reset_index(drop=True)
        p = flight(pdf["p"].tolist(), pdf["size"].astype(float).tolist())
        return pdf.assign(p=landing(p, pdf["size"].astype(float).tolist()) if last else p)

    return run


def mix(docs: DataFrame, weights: tuple[float, ...] = WEIGHTS, share: float = 1.5, most: float = 2.0, chunk: int = CHUNK) -> DataFrame:
    """doc_id, size, source, source_size, target, taken for every document."""
    plan = _plan(docs, F.monotonically_increasing_id(), weights, share, most, chunk)
    return plan.select("doc_id", "size", "source", "source_size", "target", (F.col("size") * F.col("copies")).cast("long").alias("taken"))


def _plan(docs: DataFrame, row: Column, weights: tuple[float, ...] = WEIGHTS, share: float = 1.5, most: float = 2.0, chunk: int = CHUNK) -> DataFrame:
    """row, doc_id, size, source, source_size, target, copies for every document."""
    size = F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long")
    sized = cut(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"), size.alias("size"), row.alias("row"), F.coalesce(F.col("doc_id").cast("long"), F.xxhash64("text")).alias("spread")), "mix-sizes")
    per = sized.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("n"))
    goal = cut(targets(per.select("source", "source_size"), weights, share, most).join(per.select(F.col("source").alias("s"), "n"), F.col("source").eqNullSafe(F.col("s"))).drop("s"), "mix-targets")
    ratio = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    whole = F.floor(ratio + 1e-12)
    n_chunks = F.greatest(F.lit(1), F.ceil(F.col("n") / chunk))
    to = F.broadcast(goal.withColumnRenamed("source", "s")) if _few(goal) else goal.withColumnRenamed("source", "s")
    units = _dealt(sized, chunk).join(to, F.col("source").eqNullSafe(F.col("s"))).select("row", "doc_id", "source", "size", "source_size", "target", whole.alias("whole"), F.greatest(F.lit(0.0), ratio - whole).alias("p"), F.pmod("spread", n_chunks).alias("chunk"), n_chunks.alias("chunks"))
    done, most_chunks, last = [], goal.agg(F.max(F.greatest(F.lit(1), F.ceil(F.col("n") / chunk)))).first()[0] or 1, False
    while True:
        last = most_chunks <= 1
        flown = units.groupBy("source", "chunk").applyInPandas(_fly(last), units.schema)
        if last:
            done.append(flown)
            break
        flown = cut(flown, "mix-flown")
        done.append(flown.where("p <= 0 or p >= 1"))
        # at most two units of a chunk are left: chunks of the next level hold as many units again
        fan = max(2, chunk // 2)
        units = flown.where("p > 0 and p < 1").withColumn("chunk", F.floor(F.col("chunk") / fan)).withColumn("chunks", F.ceil(F.col("chunks") / fan)).select(*units.columns)
        most_chunks = -(-most_chunks // fan)
    out = done[0]
    for x in done[1:]:
        out = out.unionByName(x)
    return out.select("row", "doc_id", "size", "source", "source_size", "target", (F.col("whole") + F.round("p")).cast("int").alias("copies"))


def _dealt(sized: DataFrame, chunk: int) -> DataFrame:
    """sized with the hash that deals its rows over the chunks of their source: that of the id alone, or of the id and the row's number if over a quarter of a chunk shares the id."""
    many = cut(sized.groupBy(F.col("spread").alias("shared")).count().where(F.col("count") > max(1, chunk // 4)).select("shared"), "mix-shared")
    rows = sized.join(F.broadcast(many) if _few(many) else many, F.col("spread") == F.col("shared"), "left")
    return rows.withColumn("spread", F.when(F.col("shared").isNull(), F.xxhash64("spread")).otherwise(F.xxhash64("spread", "row"))).drop("shared")


def _few(goal: DataFrame, most: int = 100_000) -> bool:
    """Whether the table of sources is small enough to broadcast: its rows are counted first."""
    return goal.limit(most + 1).count() <= most


#: Blocks of rows up to which they are broadcast, after counting them.
BLOCKS = 10_000
#: Rows whose numbers of copies travel together.
PACK = 4096


def repeat(docs: DataFrame, **options) -> DataFrame:
    """The mix itself: each row as often as it is taken, with the columns of docs.

    Rows get numbers that are written with them, so rows that share an id, or have none, are units of their own here
    too. Numbers rise by one within a task, so the copies of a block of rows are an array by place; those arrays are
    broadcast if they are few, and no text is shuffled then."""
    row, n, block, copies = fresh(docs, "mix_row", "mix_copies", "mix_block", "mix_array")
    named = cut(docs.withColumn(row, F.monotonically_increasing_id()), "mix-rows")
    place = F.struct((F.col("row") % PACK).alias("at"), F.col("copies").alias("n"))
    plan = _plan(named, F.col(row), **options).groupBy(F.floor(F.col("row") / PACK).alias(block)).agg(F.array_sort(F.collect_list(place))["n"].alias(copies))
    plan = cut(plan, "mix-plan")
    joined = named.join(F.broadcast(plan) if _few(plan, BLOCKS) else plan, F.floor(named[row] / PACK) == F.col(block))
    joined = joined.withColumn(n, F.get(copies, (F.col(row) % PACK).cast("int")).cast("int")).where(F.col(n) > 0).drop(copies, block)
    return joined.withColumn(n, F.explode(F.array_repeat(F.lit(0), F.col(n)))).select(*docs.columns)
