"""Component statistics and the arithmetic of experiment tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..model import Graph


def component_sizes(comp: DataFrame) -> DataFrame:
    """comp, size."""
    return comp.groupBy("comp").agg(F.count("*").alias("size"))


def top_component(comp: DataFrame) -> DataFrame:
    """The largest component; ties: the least label."""
    return component_sizes(comp).orderBy(F.desc("size"), "comp").limit(1)


def graph_stats(g: Graph, comp: DataFrame) -> DataFrame:
    """n, m, the number of components, the largest one's size and its share of the vertices."""
    c = component_sizes(comp).agg(F.count("*").alias("components"), F.max("size").alias("largest"), F.sum("size").alias("n"))
    return c.join(g.edges.agg(F.count("*").alias("m")), F.lit(True)).select("n", "m", "components", "largest", (F.col("largest") / F.col("n")).alias("share"))


def geometric_mean(x: Column) -> Column:
    """Of the positive values; nulls and NaN don't count."""
    return F.exp(F.avg(F.when((x > 0) & ~F.isnan(x), F.log(x))))


def best_of(*columns: str) -> Column:
    """The least value that isn't null or NaN."""
    return F.least(*[F.nanvl(F.col(c).cast("double"), F.lit(None).cast("double")) for c in columns])


def after_warm_up(runs: DataFrame, by: list[str], run: str, value: str) -> DataFrame:
    """Mean of the runs after the first."""
    return runs.where(F.col(run) > 1).groupBy(*by).agg(F.avg(value).alias("mean"))


def phase_breakdown(phases: DataFrame, by: str, phase: str, seconds: str, names: list[str], total: str) -> DataFrame:
    """One column for each phase, and what the total has beyond them as others."""
    wide = phases.groupBy(by).pivot(phase, [*names, total]).agg(F.sum(seconds))
    known = sum((F.coalesce(F.col(n), F.lit(0.0)) for n in names), F.lit(0.0))
    return wide.select(by, *[F.coalesce(F.col(n), F.lit(0.0)).alias(n) for n in names], (F.col(total) - known).alias("others"))


def pivot_mean(runs: DataFrame, row: str, column: str, value: str, names: list) -> DataFrame:
    """The mean of value by row, one column for each of names: a sweep's table."""
    return runs.groupBy(row).pivot(column, names).agg(F.avg(value))


def rounds(dist: DataFrame, hops: int) -> DataFrame:
    """rounds, jobs, ratio: synchronous rounds that distances took, jobs of `hops` hops each that do the same, and how many times fewer those are."""
    r = dist.agg(F.coalesce(F.max("dist"), F.lit(0)).cast("long").alias("rounds"))
    return r.withColumn("jobs", F.ceil(F.col("rounds") / hops)).withColumn("ratio", F.col("rounds") / F.nullif(F.col("jobs"), F.lit(0)))


def frontiers(g: Graph, dist: DataFrame) -> DataFrame:
    """dist, n, degrees: the size of the frontier of each round, and the edges that leave it."""
    out = g.edges.groupBy(F.col("src").alias("v")).agg(F.count("*").alias("d"))
    return dist.join(out, F.col("id") == F.col("v"), "left").groupBy("dist").agg(F.count("*").alias("n"), F.coalesce(F.sum("d"), F.lit(0)).alias("degrees"))
