"""A fixed pseudo-random order of ids, the same in every engine."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def scramble(id: Column) -> Column:
    """A multiplicative hash of an id below 2**31 to 32 bits."""
    return (id * F.lit(2654435761) + F.lit(12345)) % F.lit(4294967296)


def priorities(vertices: DataFrame, salt: int = 0) -> DataFrame:
    """id and prio, 0 to n-1 in the scrambled order; another salt gives another order."""
    from ..model import densify_ids

    h = scramble(F.col("id")) if not salt else F.xxhash64("id", F.lit(salt))
    keyed = vertices.select("id").distinct().select(F.struct(h.alias("h"), "id").alias("key"))
    return densify_ids(keyed, "key").select(F.col("key.id").alias("v"), "id").select(F.col("v").alias("id"), F.col("id").alias("prio"))
