"""Iteration on DataFrames: each round is one job whose result is written to the folder all executors share, and read back.

Lineage ends at every round, so plans stay small, and a lost executor loses nothing that was written.
"""

from __future__ import annotations

import tempfile
import time
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

#: Rows up to which the side of a join is broadcast, after it was counted; beyond, the join shuffles.
BROADCAST_ROWS = 200_000
#: Hops that one job of a traversal takes from a small frontier, unless it is told how many, and those that later jobs come to where all edges are few.
HOPS, FAR = 4, 16
#: Rows beyond which apart() keeps the side of a join from the driver.
APART_ROWS = 20_000


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir, or a temporary folder where it is unset and Spark is local, as in tests."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        base = "file://" + tempfile.mkdtemp(prefix="quillgraph-")
        spark.conf.set("spark.checkpoint.dir", base)
    return base


def cut(df: DataFrame) -> DataFrame:
    """df, written and read back."""
    return counted(df)[0]


def counted(df: DataFrame, **counts: Column) -> tuple[DataFrame, dict[str, int]]:
    """df, written and read back, and aggregations over it that the same job observes, so that no second one counts."""
    path = f"{shared_dir(df.sparkSession)}/quillgraph/graph-{uuid.uuid4().hex}"
    seen = Observation() if counts else None
    schema = df.schema
    if seen:
        df = df.observe(seen, *[c.alias(name) for name, c in counts.items()])
    df.write.parquet(path)
    out = df.sparkSession.read.schema(schema).parquet(path)
    out._quill_path = path
    return out, observed(seen) or out.agg(*[c.alias(name) for name, c in counts.items()]).first().asDict() if seen else {}


def observed(seen: Observation) -> dict[str, int]:
    """What was observed; empty if Spark found that there is no row at all, and left the observing out."""
    return seen.get if seen._jo.getRow().size() else {}


def drop(*frames: DataFrame) -> None:
    """Removes what cut() wrote, once nothing reads it any more."""
    for df in frames:
        if path := getattr(df, "_quill_path", None):
            p = df.sparkSession.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
            p.getFileSystem(df.sparkSession.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def together(frames: list[DataFrame]) -> DataFrame:
    """What several cut() of one schema wrote, as one scan."""
    return frames[0].sparkSession.read.schema(frames[0].schema).parquet(*[f._quill_path for f in frames])


class Phases:
    """What a run reports of itself: a row for each phase or job, with what was counted in it and the seconds since the row before."""

    def __init__(self) -> None:
        self.rows: list[tuple[str, int, int | None, int | None, float]] = []
        self._since = time.perf_counter()

    def note(self, phase: str, n: int, frontier: int | None = None, hops: int | None = None) -> None:
        """n: the vertices that the phase settled or the rows that the job found; frontier: what it left to go on from; hops: how far it went."""
        now = time.perf_counter()
        self.rows.append((phase, n, frontier, hops, now - self._since))
        self._since = now

    def table(self, spark: SparkSession) -> DataFrame:
        """round, phase, n, frontier, hops, seconds."""
        return spark.createDataFrame([(k, *r) for k, r in enumerate(self.rows)], "round long, phase string, n long, frontier long, hops int, seconds double")


def dealt(df: DataFrame, key: str) -> DataFrame:
    """df as a table in the shared folder, bucketed and sorted by a column: joins on it don't shuffle it, and what a lost executor was reading is read again, not made again. free() removes it."""
    spark = df.sparkSession
    name, n = f"quillgraph_{uuid.uuid4().hex}", int(spark.conf.get("spark.sql.shuffle.partitions"))
    path = f"{shared_dir(spark)}/quillgraph/{name}"
    seen = Observation()
    # one file for each bucket: rows are dealt before they are written
    df.observe(seen, F.count("*").alias("n")).repartition(n, key).write.bucketBy(n, key).sortBy(key).option("path", path).saveAsTable(name)
    out = spark.table(name)
    out._quill_path, out._quill_table, out._quill_rows = path, name, observed(seen).get("n", 0)
    return out


def free(df: DataFrame) -> None:
    """Removes what dealt() wrote."""
    if name := getattr(df, "_quill_table", None):
        df.sparkSession.sql(f"drop table if exists {name}")
    drop(df)


@contextmanager
def by_source(edges: DataFrame, *more: str, loops: bool = False) -> Iterator[DataFrame]:
    """edges(src, dst, more), dealt by src while a loop runs: a hop then shuffles its frontier only, never the edges.

    With loops, each vertex of an edge, with its `more`, has a row from itself to itself besides, and a column `own` that marks these."""
    rows = edges.select("src", "dst", *more)
    if loops:
        ends = rows.select(F.col("src").alias("id"), *more).unionByName(rows.select(F.col("dst").alias("id"), *more)).distinct()
        rows = rows.withColumn("own", F.lit(False)).unionByName(ends.select(F.col("id").alias("src"), F.col("id").alias("dst"), *more, F.lit(True).alias("own")))
    kept = dealt(rows, "src")
    try:
        yield kept
    finally:
        free(kept)


def near(kept: DataFrame) -> DataFrame:
    """What dealt() wrote, with a broadcast hint if its rows are few: a hop then shuffles what it found, in as few tasks as that needs."""
    return small(kept, kept._quill_rows)


def hops_ahead(kept: DataFrame, n: int, hops: int | None, before: int) -> int:
    """How many hops the next job takes from a frontier of n rows, after one of `before`; hops is what a caller has asked for."""
    if n > BROADCAST_ROWS:
        return 1
    return hops or (max(HOPS, min(FAR, 2 * before)) if kept._quill_rows <= BROADCAST_ROWS else HOPS)


def small(df: DataFrame, rows: int) -> DataFrame:
    """df with a broadcast hint if its known number of rows allows it."""
    return F.broadcast(df) if rows <= BROADCAST_ROWS else df


def apart(df: DataFrame, rows: int | None = None) -> DataFrame:
    """df as the side of a join that never goes through the driver, as Spark's own broadcasts do, unless its known number of rows is small."""
    return df if rows is not None and rows <= APART_ROWS else df.hint("merge")
