"""Target-distribution importance resampling: documents are drawn by how much their hashed word features look like a target's.

Features are the runs of one to two words, with repeats; a feature's bucket is its CRC modulo BUCKETS. Each block of a
partition's texts becomes a word trie: a node below the root for each distinct word, and below it one for each word that
follows it. A node holds how often its feature occurs and the state of the CRC after its bytes, so a pair's CRC goes on
from its first word's state. A task adds its tries' counts by bucket, and sums of buckets over tasks are the totals of a
corpus, which give each bucket a gain. Scoring walks the same paths again, with gains in place of counts; tries are built
anew for it, since stored ones would be as large as the texts. Every text is read whole, twice, and never shuffled; of the
corpus, BUCKETS sums come to the driver. Ranks are numbered in ranges of the score, so no task sees all documents.

Words of a block are told apart by hashes of 62 bits.

Defined cases: a null or empty text, or one without words, has no features, weight 0, and is scored but never drawn for
want of words. Documents that score alike are drawn by the lesser id; a null id counts as an empty text in the hash and
comes last; rows that are equal in all that is returned are drawn in any order. Rows that repeat an id are documents of
their own. An empty table gives an empty result, an empty target a gain for every bucket. Extra columns are ignored.
"""

from __future__ import annotations

import math
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from . import common as C

BUCKETS, LEAST_WORDS, PERCENT, SEED = 10_000, 20, 25, 7
#: Bytes of text in a trie; a longer document has one of its own.
TRIE_BYTES = 1 << 22
#: What no word has: all of ASCII but digits and a-z (the text is lower-cased).
APART = np.ones(256, bool)
APART[48:58] = APART[97:123] = APART[128:] = False
#: Bytes of a word that all nodes' states take at once; what a longer word has beyond goes node by node.
_STEPS = 48


def _crc_table() -> np.ndarray:
    t = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        t = np.where(t & 1, np.uint32(0xEDB88320) ^ (t >> 1), t >> 1).astype(np.uint32)
    return t


_TABLE = _crc_table()


def _walk(state: np.ndarray, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """The CRC states after the bytes of a span each, from the states before."""
    size = ends - starts
    order = np.argsort(-size, kind="stable")
    now, at, size = state[order], starts[order], size[order]
    for j in range(min(_STEPS, int(size[0]) if len(size) else 0)):
        k = int(np.searchsorted(-size, -j))
        now[:k] = _TABLE[(now[:k] ^ data[at[:k] + j]) & 255] ^ (now[:k] >> np.uint32(8))
    for i in range(int(np.searchsorted(-size, -_STEPS))):
        rest = data[at[i] + _STEPS : at[i] + size[i]].tobytes()
        now[i] = zlib.crc32(rest, int(now[i]) ^ 0xFFFFFFFF) ^ 0xFFFFFFFF
    out = np.empty_like(now)
    out[order] = now
    return out


class Trie:
    """The words and pairs of a block: word (pair) gives the node of each word (of it and the next one, -1 at a document's end)."""

    def __init__(self, data: np.ndarray, at: np.ndarray, buckets: int) -> None:
        data = C.LOWER[data]
        starts, ends, self.bounds = C.words(data, at, APART)
        hashes = C.span_hash(C.prefix_hash(data), starts, ends)
        some, first, self.word, self.word_count = np.unique(hashes, return_index=True, return_inverse=True, return_counts=True)
        root = np.full(len(some), 0xFFFFFFFF, np.uint32)
        state = _walk(root, data, starts[first], ends[first])
        self.word_bucket = (state ^ np.uint32(0xFFFFFFFF)).astype(np.int64) % buckets
        self.pair = np.full(len(starts), -1, np.int64)
        follows = np.ones(len(starts), bool)
        follows[self.bounds[1:][self.bounds[1:] > self.bounds[:-1]] - 1] = False
        i = np.flatnonzero(follows)
        _, first, node, self.pair_count = np.unique(self.word[i] * np.int64(len(some) + 1) + self.word[i + 1], return_index=True, return_inverse=True, return_counts=True)
        self.pair[i] = node
        i = i[first]  # a place of each pair
        below = state[self.word[i]]
        below = _TABLE[(below ^ np.uint32(32)) & 255] ^ (below >> np.uint32(8))
        state = _walk(below, data, starts[i + 1], ends[i + 1])
        self.pair_bucket = (state ^ np.uint32(0xFFFFFFFF)).astype(np.int64) % buckets

    def add_to(self, totals: np.ndarray) -> None:
        np.add.at(totals, self.word_bucket, self.word_count)
        np.add.at(totals, self.pair_bucket, self.pair_count)

    def sums(self, gains: np.ndarray) -> np.ndarray:
        """The sum of the gains along each document's paths."""
        each = gains[self.word_bucket][self.word]
        if len(self.pair_bucket):
            each = each + np.where(self.pair >= 0, gains[self.pair_bucket][self.pair], 0)
        upto = np.concatenate([[0], np.cumsum(each)])
        return upto[self.bounds[1:]] - upto[self.bounds[:-1]]


def bucket_totals(texts: DataFrame, buckets: int = BUCKETS) -> DataFrame:
    """bucket, n: how many features of texts(text) are in each bucket that has any."""

    def run(batches):
        totals = np.zeros(buckets, np.int64)
        for _, data, at in C.blocks(batches, limit=TRIE_BYTES):
            Trie(data, at, buckets).add_to(totals)
        some = np.flatnonzero(totals)
        yield pa.RecordBatch.from_arrays([pa.array(some.astype(np.int32)), pa.array(totals[some])], names=["bucket", "n"])

    return texts.select("text").mapInArrow(run, "bucket int, n long").groupBy("bucket").agg(F.sum("n").alias("n"))


def gains(docs: DataFrame, target: DataFrame, buckets: int = BUCKETS) -> np.ndarray:
    """Thousandths of the logarithm of how much likelier each bucket is in the target, one added to each count, rounded down."""

    def counts(df: DataFrame) -> np.ndarray:
        out = np.zeros(buckets, np.int64)
        for b, n in bucket_totals(df, buckets).collect():  # one row for each bucket at most
            out[b] = n
        return out

    s, t = counts(docs), counts(target)
    above, below = float(s.sum() + buckets), float(t.sum() + buckets)
    return np.array([math.floor(1000 * math.log((t[b] + 1.0) * above / ((s[b] + 1.0) * below))) for b in range(buckets)], np.int64)


def weigh(docs: DataFrame, target: DataFrame, buckets: int = BUCKETS) -> DataFrame:
    """doc_id, n_words, n_features, weight: the mean gain of each document's features, rounded down."""
    gain = gains(docs, target, buckets)  # one number for each bucket

    def run(batches):
        for part, data, at in C.blocks(batches, limit=TRIE_BYTES):
            trie = Trie(data, at, buckets)
            n = np.diff(trie.bounds)
            features = n + np.maximum(n - 1, 0)
            weight = np.where(features > 0, trie.sums(gain) // np.maximum(features, 1), 0)
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(n), pa.array(features), pa.array(weight)], names=["doc_id", "n_words", "n_features", "weight"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, n_words long, n_features long, weight long")


def noise(doc_id: Column, seed: int = SEED) -> Column:
    """Thousandths of a Gumbel number that the id and the seed give, rounded down: the highest sums of weight and noise are a draw without replacement."""
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit(""))).cast("binary"), 256), 1, 8), 16, 10).cast("long")
    return F.floor(F.lit(-1000) * F.log(-F.log((h + F.lit(0.5)) / F.lit(4294967296.0)))).cast("long")


def resample(docs: DataFrame, target: DataFrame, percent: int = PERCENT, least_words: int = LEAST_WORDS, seed: int = SEED, buckets: int = BUCKETS) -> DataFrame:
    """doc_id, n_words, n_features, weight, score of every row of docs(doc_id, text), and the rank of those drawn: `percent` of the documents with least_words or more."""
    scored = C.cut(weigh(docs, target, buckets).withColumn("score", F.col("weight") + noise(F.col("doc_id"), seed)), "resample-scores")
    enough = F.col("n_words") >= least_words
    drawn = scored.where(enough).count() * percent // 100
    # sorted ranges of the score, and in each the rows' places: the identifier counts up within a task
    place = F.monotonically_increasing_id()
    order = [F.desc("score"), F.asc_nulls_last("doc_id"), F.asc("n_features"), F.asc("tie")]
    ranged = scored.where(enough).withColumn("tie", place).repartitionByRange(*order).sortWithinPartitions(*order).drop("tie").withColumn("place", place)
    ranged = C.cut(ranged, "resample-order")
    task, row = F.shiftright("place", 33), F.col("place").bitwiseAND(F.lit((1 << 33) - 1))
    sizes = ranged.groupBy(task.alias("task")).agg(F.count("*").alias("n"))  # a row for each task
    before = sizes.select(F.col("task").alias("of"), F.coalesce(F.sum("n").over(W.orderBy("task").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("before"))
    ranked = ranged.join(F.broadcast(before), task == F.col("of")).withColumn("rank", F.col("before") + row + 1)
    columns = ["doc_id", "n_words", "n_features", "weight", "score"]
    ranked = ranked.select(*columns, F.when(F.col("rank") <= drawn, F.col("rank")).alias("rank"))
    return ranked.unionByName(scored.where(~enough).select(*columns, F.lit(None).cast("long").alias("rank")))
