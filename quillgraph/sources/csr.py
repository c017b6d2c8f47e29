"""CSR graph files: `.adj` text and `.bin` little-endian binary.

A `.bin` block is u64 n, u64 m, u64 size, u64 offset[n + 1], u32 target[m]; a dual file has a second block, of the edges
by their targets. Reading plans byte ranges from the header, and a task reads its range of targets and the offsets that
cover it, so a file of any size is read in pieces, from wherever pyarrow's file systems reach. An `.adj` graph is one text
file or a folder of them in the order of their names; it is read and written by Spark's own text source.
"""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..model import Graph
from ..operators.construct import csr_offsets
from .csr_source import PIECE, header, local_path, register


def read(spark: SparkSession, path: str, symmetric: bool = False, dual: bool = False) -> Graph:
    """A graph file by its ending, `.adj` or `.bin`."""
    if path.endswith(".adj"):
        return read_adj(spark, path, symmetric)
    if path.endswith(".bin"):
        return read_bin(spark, path, symmetric, dual)
    raise ValueError(f"{path}: the ending must be .adj or .bin")


def read_bin(spark: SparkSession, path: str, symmetric: bool = False, dual: bool = False, piece: int = PIECE) -> Graph:
    """The graph of a `.bin` file, by the data source `csr`; of a dual file, its first block."""
    n, _ = header(path, dual)
    register(spark)
    options = {"path": path, "piece": str(piece), "dual": str(dual).lower()}
    return Graph(spark.range(n), spark.read.format("csr").options(**options).load(), symmetric)


def read_bin_transpose(spark: SparkSession, path: str, piece: int = PIECE) -> DataFrame:
    """src, dst of the second block of a dual `.bin` file: the edges turned round, as they are stored."""
    register(spark)
    return spark.read.format("csr").options(path=path, piece=str(piece), block="in").load()


def read_adj(spark: SparkSession, path: str, symmetric: bool = False) -> Graph:
    """Tokens in lines of any length: AdjacencyGraph, n, m, n offsets, m targets. Tokens are numbered by file, place of the split in it, and line, and their running number comes from the splits' counts."""
    from ..plans.loop import cut

    split = F.struct(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("at"))
    lines = spark.read.text(path).select(split.alias("part"), F.monotonically_increasing_id().alias("line"), F.filter(F.split("value", r"[\r\t \x00]+"), lambda x: x != "").alias("t")).where("size(t) > 0")
    lines = cut(lines)
    # lines of one split are numbered in order; a window holds one row for each split
    sizes = lines.select("line", F.size("t").alias("n"), "part")
    of_part = sizes.groupBy("part").agg(F.sum("n").alias("s"))
    base = of_part.select(F.col("part").alias("p"), F.coalesce(F.sum("s").over(W.orderBy("part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("base"))
    start = F.coalesce(F.sum("n").over(W.partitionBy("part").orderBy("line").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    at = sizes.withColumn("inner", start).join(base, F.col("part") == F.col("p")).select(F.col("line").alias("l"), (F.col("base") + F.col("inner")).alias("start"))
    tokens = lines.join(at, F.col("line") == F.col("l")).select("start", F.posexplode("t").alias("k", "v")).select((F.col("start") + F.col("k")).alias("i"), "v")
    tokens = cut(tokens)
    head = {r["i"]: r["v"] for r in tokens.where("i < 3").collect()}
    if head.get(0) != "AdjacencyGraph" or not (head.get(1, "").isdigit() and head.get(2, "").isdigit()):
        raise ValueError(f"{path}: no AdjacencyGraph header")
    n, m = int(head[1]), int(head[2])
    if tokens.count() != 3 + n + m:
        raise ValueError(f"{path}: {n} offsets and {m} targets are announced")
    number = F.col("v").cast("long")
    offset = tokens.where((F.col("i") >= 3) & (F.col("i") < 3 + n)).select((F.col("i") - 3).alias("id"), number.alias("begin"))
    # the end of a vertex's range is the next one's beginning
    after = offset.select((F.col("id") - 1).alias("b"), F.col("begin").alias("end"))
    ranges = offset.join(after, F.col("id") == F.col("b"), "left").select("id", "begin", F.coalesce("end", F.lit(m)).alias("end")).where("end > begin")
    owned = ranges.select("id", F.explode(F.sequence("begin", F.col("end") - 1)).alias("e"))
    target = tokens.where(F.col("i") >= 3 + n).select((F.col("i") - 3 - n).alias("j"), number.alias("dst"))
    return Graph(spark.range(n), owned.join(target, F.col("e") == F.col("j")).select(F.col("id").alias("src"), "dst"), symmetric)


def write_bin(g: Graph, path: str, dual: bool = False) -> None:
    """Writes dense ids 0..n-1 as one `.bin` file, in place and by tasks, to a path that all executors mount; with dual, a second block of the edges by their targets."""
    target = local_path(path)
    if os.path.exists(target):
        os.remove(target)
    blocks = [g.edges, g.edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"))][: 2 if dual else 1]
    n, m = g.vertices.count(), g.edges.count()
    if g.edges.where(F.least("src", "dst") < 0).union(g.edges.where(F.greatest("src", "dst") >= n)).count():
        raise ValueError("ids must be 0 to n-1")
    size, numbers, heads = (n + 1) * 8 + m * 4 + 24, None, []
    for k, edges in enumerate(blocks):
        base = k * size
        begin = csr_offsets(Graph(g.vertices, edges))
        last = g.edges.sparkSession.createDataFrame([(n, m)], "id long, begin long")
        offsets = begin.unionByName(last).select((F.col("id") * 8 + (base + 24)).alias("at"), F.col("begin").alias("value"), F.lit(8).alias("width"))
        place = F.row_number().over(W.partitionBy("src").orderBy("dst")) - 1
        targets = edges.withColumn("k", place).join(begin, F.col("src") == F.col("id")).select(((F.col("begin") + F.col("k")) * 4 + (base + 24 + 8 * (n + 1))).alias("at"), F.col("dst").alias("value"), F.lit(4).alias("width"))
        both = offsets.unionByName(targets)
        numbers = both if numbers is None else numbers.unionByName(both)
        heads.append(f"{base}:{n}:{m}")
    register(g.edges.sparkSession)
    numbers.repartitionByRange("at").sortWithinPartitions("at").write.format("csr").options(path=path, headers=",".join(heads), size=str(size * len(blocks))).mode("append").save()


def write_adj(g: Graph, path: str) -> None:
    """Writes dense ids 0..n-1 as a folder of `.adj` text, one token a line; each task writes a range of the tokens."""
    spark, n, m = g.edges.sparkSession, g.vertices.count(), g.edges.count()
    begin = csr_offsets(g)
    head = spark.createDataFrame([(0, "AdjacencyGraph"), (1, str(n)), (2, str(m))], "i long, value string")
    offsets = begin.select((F.col("id") + 3).alias("i"), F.col("begin").cast("string").alias("value"))
    place = F.row_number().over(W.partitionBy("src").orderBy("dst")) - 1
    targets = g.edges.withColumn("k", place).join(begin, F.col("src") == F.col("id")).select((F.col("begin") + F.col("k") + n + 3).alias("i"), F.col("dst").cast("string").alias("value"))
    head.unionByName(offsets).unionByName(targets).repartitionByRange("i").sortWithinPartitions("i").select("value").write.text(path)
