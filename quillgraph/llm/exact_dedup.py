"""Exact dedup with Patricia-trie owners.

Texts are equal when identical after lower-casing A-Z only; null counts as empty. A first pass inserts the full
byte strings of each input partition into compressed radix tries, one trie for each length, so that one row for each
distinct text leaves the task (pre-aggregation: a group of copies, however large, sends at most one row for each
flush of a task). Those rows are partitioned by length and content hash, and sorted by both within a partition. A
second pass inserts them into tries again: equality is decided there by walking full byte strings, never by a hash.
Terminal nodes store the identifier that stays (the largest by default, or the smallest) and the number of rows.
Spilling is by subtree: since the rows of one (length, hash) subtree come one after another out of Spark's external
sort, a trie over the byte budget is emitted and freed at the next subtree's edge. Owners then go back to all rows
over the SHA-256 of the normalised text, a join whose hot keys adaptive execution can split.

Defined cases: an empty table gives an empty result. Null or empty texts are one group. Rows that repeat a doc_id are
decided by their own text, and each count in group_size; where id and text are equal they share the decision, of which
dedup(once=True) leaves one row. A null doc_id never owns a group that has other ids; it is kept
only if its group has no other. Extra columns are ignored by decide(), and preserved by dedup().
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import LOWER, blocks, dedup_rows, small_batches

#: Bytes of text that a task's tries hold before they are emitted.
TRIE_BYTES = 16 << 20


class Patricia:
    """Compressed radix trie over byte strings. A node is [label, children by first byte, value]."""

    def __init__(self) -> None:
        self.root: list = [b"", {}, None]

    def terminal(self, key: bytes) -> list:
        """The node at which key ends; it is made if it isn't there."""
        node, i = self.root, 0
        while i < len(key):
            child = node[1].get(key[i])
            if child is None:
                node[1][key[i]] = child = [key[i:], {}, None]
                return child
            label = child[0]
            if key.startswith(label, i):
                i, node = i + len(label), child
                continue
            n = _common(label, key, i)
            middle = [label[:n], {label[n]: child}, None]
            child[0] = label[n:]
            node[1][key[i]] = middle
            i, node = i + n, middle
        return node


def _common(label: bytes, key: bytes, i: int) -> int:
    """Length of the common prefix of label and key[i:]."""
    low, high = 1, min(len(label), len(key) - i)
    while low < high:
        mid = (low + high + 1) // 2
        if label[:mid] == key[i : i + mid]:
            low = mid
        else:
            high = mid - 1
    return low


class Owners:
    """Tries by length whose terminals hold [id that stays, rows, text]."""

    def __init__(self, better: Callable) -> None:
        self.better, self.tries, self.bytes, self.found = better, {}, 0, []

    def add(self, text: bytes, doc_id: int | None, rows: int) -> None:
        node = self.tries.setdefault(len(text), Patricia()).terminal(text)
        if node[2] is None:
            node[2] = [doc_id, rows, text]
            self.found.append(node[2])
            self.bytes += 2 * len(text) + 200
        else:
            node[2][0] = self.better(node[2][0], doc_id)
            node[2][1] += rows

    def flush(self) -> list[list]:
        out, self.tries, self.bytes, self.found = self.found, {}, 0, []
        return out


def _better(keep: str) -> Callable:
    pick = {"largest": max, "smallest": min}[keep]
    return lambda a, b: b if a is None else a if b is None else pick(a, b)


def _normal(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int | None, bytes]]:
    """(doc_id, normalised text) of each row."""
    for rows, data, at in blocks(batches):
        low, at = LOWER[data].tobytes(), at.tolist()
        for k, doc_id in enumerate(rows.column("doc_id").to_pylist()):
            yield doc_id, low[at[k] : at[k + 1]]


_LOCAL = pa.schema([("n_bytes", pa.int64()), ("hash", pa.int64()), ("text", pa.binary()), ("best", pa.int64()), ("rows", pa.int64())])
_OWNER = pa.schema([("sha", pa.string()), ("keep_id", pa.int64()), ("group_size", pa.int64())])


def _hash(text: bytes) -> int:
    return int.from_bytes(hashlib.blake2b(text, digest_size=8).digest(), "big", signed=True)


def owners(docs: DataFrame, keep: str = "largest", trie_bytes: int = TRIE_BYTES) -> DataFrame:
    """sha, keep_id, group_size: one row for each distinct normalised text."""
    better = _better(keep)
    small_batches(docs.sparkSession)

    def combine(batches):
        tries = Owners(better)
        out = lambda found: pa.RecordBatch.from_arrays([pa.array([len(x[2]) for x in found], pa.int64()), pa.array([_hash(x[2]) for x in found], pa.int64()), pa.array([x[2] for x in found], pa.binary()), pa.array([x[0] for x in found], pa.int64()), pa.array([x[1] for x in found], pa.int64())], schema=_LOCAL)
        for doc_id, text in _normal(batches):
            tries.add(text, doc_id, 1)
            if tries.bytes > trie_bytes:
                yield out(tries.flush())
        yield out(tries.flush())

    def own(batches):
        tries, at = Owners(better), None
        out = lambda found: pa.RecordBatch.from_arrays([pa.array([hashlib.sha256(x[2]).hexdigest() for x in found], pa.string()), pa.array([x[0] for x in found], pa.int64()), pa.array([x[1] for x in found], pa.int64())], schema=_OWNER)
        for batch in batches:
            for n, h, text, best, rows in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if tries.bytes > trie_bytes and (n, h) != at:  # no later row can equal what the tries hold
                    yield out(tries.flush())
                tries.add(text, best, rows)
                at = (n, h)
        yield out(tries.flush())

    local = docs.select("doc_id", "text").mapInArrow(combine, "n_bytes long, hash long, text binary, best long, rows long")
    return local.repartition("n_bytes", "hash").sortWithinPartitions("n_bytes", "hash").mapInArrow(own, "sha string, keep_id long, group_size long")


def _digests(batches):
    for rows, data, at in blocks(batches):
        low, at = LOWER[data].tobytes(), at.tolist()
        shas = [hashlib.sha256(low[at[k] : at[k + 1]]).hexdigest() for k in range(rows.num_rows)]
        yield pa.RecordBatch.from_arrays([rows.column("doc_id"), pa.array(shas, pa.string())], names=["doc_id", "sha"])


def decide(docs: DataFrame, keep: str = "largest", trie_bytes: int = TRIE_BYTES) -> DataFrame:
    """doc_id, keep_id, group_size, kept, text_sha256 for every row of docs(doc_id, text)."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    each = docs.mapInArrow(_digests, "doc_id long, sha string")
    return each.join(owners(docs, keep, trie_bytes), "sha").select("doc_id", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"), F.col("sha").alias("text_sha256"))


def dedup(docs: DataFrame, keep: str = "largest", once: bool = False) -> DataFrame:
    """The rows of docs that stay, with all their columns; with once, rows that repeat id and text are copies too."""
    return dedup_rows(docs, lambda d: decide(d, keep), keep == "largest", once)
