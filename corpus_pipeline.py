"""The corpus pipeline: quality, exact dedup, near-dedup, decontamination, mixing. Each stage is one operator over all its predecessor kept.

Defined cases: a null text counts as an empty one in every stage. A row without a doc_id is a document of its own: it is
scored, compared and mixed like any other. Rows that repeat a doc_id are decided by their own texts; of rows that repeat
both, exact dedup leaves one, whichever if their other columns differ. Of equal texts the largest doc_id stays, of near
copies the least, so ties are decided by id. Empty texts are one group of equal texts. Rows without words are near copies
of nothing, leak nothing, and may come into the mix, to which they add no words. An empty table gives an empty result with
the columns of documents, which every stage keeps, whatever other columns there are and however they are named. Without
labels every document scores 0.5 and stays. Texts of any length are processed whole.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from quillgraph.llm import decontaminate, exact_dedup, minhash, mixing, quality
from quillgraph.llm.common import cut, drop_cut, table


def good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier doesn't reject."""
    return quality.keep_good(docs, table(spark, sf_dir, "labels"))


def distinct(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of equal texts."""
    return exact_dedup.dedup(docs, once=True)


def apart(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies: five words, similarity 0.8."""
    return minhash.dedup(docs, n=5, percent=80, once=True)


def untainted(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that leak no benchmark item."""
    return decontaminate.clean(docs, table(spark, sf_dir, "benchmark"))


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix: each document as often as its source's target takes it."""
    return mixing.repeat(docs)


STAGES = [("quality", good), ("exact_dedup", distinct), ("near_dedup", apart), ("decontaminate", untainted), ("mix", mixed)]
#: No SQL says what the classifier and the cube method do; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, before = table(spark, sf_dir, "documents"), None
    for name, stage in STAGES[:-1]:
        docs = cut(stage(spark, docs, sf_dir), f"pipeline-{name}")
        if before is not None:
            drop_cut(before)  # nothing reads a stage that the next one has been written from
        before = docs
    return STAGES[-1][1](spark, docs, sf_dir)
