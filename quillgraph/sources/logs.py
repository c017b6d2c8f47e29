"""Measurements out of log files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..plans.loop import cut


def read_measurements(spark: SparkSession, path: str, pattern: str) -> DataFrame:
    """file and value: the last token, as a number, of each line that the pattern finds."""
    lines = spark.read.text(path).where(F.col("value").rlike(pattern))
    return lines.select(F.input_file_name().alias("file"), F.element_at(F.split(F.trim("value"), r"\s+"), -1).cast("double").alias("value"))


def read_frames(spark: SparkSession, path: str, marker: str = "graph") -> DataFrame:
    """frame, line, values of a file of several CSV tables: a line `marker name` begins a table, and the lines after it are its rows. Lines before the first marker are left out.

    Lines are numbered by split and place. Within a split the last marker above a line names its table; a line above all of
    its split's markers has that of the splits before, of which there is a row each. So a file of any size is read in pieces."""
    rows = spark.read.text(path).select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("at"), F.monotonically_increasing_id().alias("line"), F.trim("value").alias("v")).where("v <> ''")
    name = F.regexp_extract("v", rf"^{marker}\s+(.+)$", 1)
    rows = cut(rows.withColumn("mark", F.nullif(name, F.lit(""))))
    own = F.last("mark", True).over(W.partitionBy("file", "at").orderBy("line"))
    splits = rows.groupBy("file", "at").agg(F.max_by("mark", F.when(F.col("mark").isNotNull(), F.col("line"))).alias("last"))
    before = F.last("last", True).over(W.partitionBy("file").orderBy("at").rowsBetween(W.unboundedPreceding, -1))
    carried = splits.select(F.col("file").alias("f"), F.col("at").alias("a"), before.alias("carried"))
    body = rows.withColumn("own", own).where("mark is null").join(carried, (F.col("file") == F.col("f")) & (F.col("at") == F.col("a")))
    return body.select(F.coalesce("own", "carried").alias("frame"), "line", F.split("v", r"\s*,\s*").alias("values")).where("frame is not null")


def write_table(df: DataFrame, path: str, by: str | None = None) -> None:
    """A result as CSV with a header; with by, a folder for each of its values, in place of one file of several tables."""
    out = df.write.mode("overwrite").option("header", True)
    (out.partitionBy(by) if by else out).csv(path)
