"""Helpers shared by the corpus operators: reading, cutting lineage, and numpy views of Arrow text columns."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of text that a numpy pass works on at once; a longer document makes a block of its own.
BLOCK_BYTES = 1 << 20
#: The same for passes that make many numbers of each byte, so that a Python worker stays small.
NARROW_BYTES = 1 << 18
#: Bytes of a batch that goes to Python at once; Spark's own bound is 10,000 rows, of texts of any length.
BATCH_BYTES = 4 << 20
#: White space of the word pattern [^\x20\x09-\x0D]+.
WHITE = np.zeros(256, bool)
WHITE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
#: Lower-cases A-Z and nothing else.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
UPPER_AZ, LOWER_AZ = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share (spark.checkpoint.dir); a temporary one where it is unset and Spark is local, as in tests."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        base = "file://" + tempfile.mkdtemp(prefix="quillgraph-")
        spark.conf.set("spark.checkpoint.dir", base)
    return base


def small_batches(spark: SparkSession) -> None:
    """Bounds the bytes of batches that go to Python, unless the session has a tighter bound."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    have = spark._jsparkSession.sessionState().conf().arrowMaxBytesPerBatch()
    if have <= 0 or have > BATCH_BYTES:
        spark.conf.set(key, str(BATCH_BYTES))


def cut(df: DataFrame, name: str = "cut") -> DataFrame:
    """Writes df as a table in the shared folder and reads it back: lineage ends there, and a lost executor loses nothing of it."""
    path = f"{shared_dir(df.sparkSession)}/quillgraph/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._quill_path = path
    return out


def drop_cut(df: DataFrame) -> None:
    """Removes a table that cut() wrote, once nothing reads it any more."""
    spark, path = df.sparkSession, df._quill_path
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


#: Ids up to which a filter by them is broadcast, after counting them; beyond, it is a shuffled join.
BROADCAST_IDS = 200_000


def only(df: DataFrame, column: str, ids: DataFrame, key: str) -> DataFrame:
    """The rows of df whose column is among the distinct ids: df isn't shuffled while the ids are few."""
    few = ids.limit(BROADCAST_IDS + 1).count() <= BROADCAST_IDS
    return df.join(F.broadcast(ids) if few else ids, df[column] == ids[key], "left_semi")


def without(df: DataFrame, decided: DataFrame) -> DataFrame:
    """The rows of df whose doc_id has a kept row in decided(doc_id, kept). Dropped ids are usually few, so df isn't shuffled for them."""
    (key,) = fresh(df, "dropped_id")
    ids = cut(decided.groupBy(F.col("doc_id").alias(key)).agg(F.max("kept").alias("k")).where("not k").select(key), "dropped")
    few = ids.limit(BROADCAST_IDS + 1).count() <= BROADCAST_IDS
    return df.join(F.broadcast(ids) if few else ids, df["doc_id"].eqNullSafe(F.col(key)), "left_anti")


def own_ids(docs: DataFrame, nulls_first: bool, once: bool) -> tuple[DataFrame, str]:
    """docs, and the name of a column of ids that no two texts share; it is doc_id if that holds already.

    Else each (doc_id, text) has its place in their order as an id, in a column of its own: repeated ids with different
    texts are told apart, null ids too, and equal rows have one id. With once, one row of equal ones is left, whichever
    if their other columns differ. Texts are shuffled for it only where ids repeat or are null."""
    some = docs.groupBy("doc_id").agg(F.count("*").alias("c")).where("c > 1 or doc_id is null")
    if some.isEmpty():
        return docs, "doc_id"
    row, tag, d, t, c = fresh(docs, "row_id", "row_tag", "of_id", "of_tag", "row_count")
    tagged = docs.withColumn(tag, F.sha2(F.coalesce(F.col("text"), F.lit("")).cast("binary"), 256))
    each = tagged.groupBy(F.col("doc_id").alias(d), F.col(tag).alias(t)).agg(F.count("*").alias(c))
    # places rise over the sorted partitions, so ids keep the order of doc_id
    places = cut(each.orderBy(F.asc_nulls_first(d) if nulls_first else F.asc_nulls_last(d), t).withColumn(row, F.monotonically_increasing_id()), "row-ids")
    few = places.limit(BROADCAST_IDS + 1).count() <= BROADCAST_IDS
    named = cut(tagged.join(F.broadcast(places) if few else places, F.col("doc_id").eqNullSafe(F.col(d)) & (F.col(tag) == F.col(t))).drop(tag, d, t), "row-named")
    if once:
        named = cut(named.where(F.col(c) == 1).unionByName(named.where(F.col(c) > 1).dropDuplicates([row])), "row-once")
    return named.drop(c), row


def dedup_rows(docs: DataFrame, decide, nulls_first: bool, once: bool) -> DataFrame:
    """The rows of docs that decide(docs(doc_id, text)) keeps, each row by its own text."""
    named, row = own_ids(docs, nulls_first, once)
    if row == "doc_id":
        return without(docs, decide(docs))
    decided = decide(named.select(F.col(row).alias("doc_id"), "text"))
    (key,) = fresh(named, "dropped_id")
    ids = cut(decided.where("not kept").select(F.col("doc_id").alias(key)).distinct(), "dropped")
    few = ids.limit(BROADCAST_IDS + 1).count() <= BROADCAST_IDS
    return named.join(F.broadcast(ids) if few else ids, F.col(row) == F.col(key), "left_anti").select(*[named[x] for x in docs.columns])


def bounded_sample(ids: DataFrame, key: str, rows: int) -> DataFrame:
    """At most `rows` rows of a narrow table, by the hash of key. Its count gives a threshold first, so about twice as many rows reach the last task, however large the table is."""
    n, span = ids.count(), 1 << 40
    h = F.xxhash64(key)
    if n > 2 * rows:
        ids = ids.where(F.pmod(h, F.lit(span)) < F.lit(int(span * 2 * rows / n)))
    return ids.orderBy(h, key).limit(rows)


def fresh(df: DataFrame, *names: str) -> list[str]:
    """Column names like names that df doesn't have."""
    have = {c.lower() for c in df.columns}
    out = []
    for n in names:
        while n.lower() in have:
            n = "_" + n
        out.append(n)
    return out


def crc_mod(col: str, m: int):
    """crc32 of the id's decimal text, mod m."""
    return F.pmod(F.crc32(F.col(col).cast("string")), F.lit(m)).cast("int")


# ---------------------------------------------------------------- Arrow text as numpy


def text_buffers(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string or binary column and its len+1 offsets into them; null counts as empty."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    kind = np.int64 if pa.types.is_large_string(col.type) or pa.types.is_large_binary(col.type) else np.int32
    if col.null_count:
        col = col.fill_null(b"" if pa.types.is_binary(col.type) or pa.types.is_large_binary(col.type) else "")
    _, offsets, data = col.buffers()
    at = np.frombuffer(offsets, kind)[col.offset : col.offset + len(col) + 1].astype(np.int64) if len(col) else np.zeros(1, np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return raw, at


def blocks(batches: Iterable[pa.RecordBatch], text: str = "text", limit: int = BLOCK_BYTES) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """Slices of whole rows with about limit bytes of text: (rows, bytes, offsets from 0)."""
    for batch in batches:
        n, i = batch.num_rows, 0
        if not n:
            continue
        raw, at = text_buffers(batch.column(batch.schema.get_field_index(text)))
        while i < n:
            j = max(i + 1, int(np.searchsorted(at, at[i] + limit, "right")) - 1)
            j = min(j, n)
            yield batch.slice(i, j - i), raw[at[i] : at[j]], at[i : j + 1] - at[i]
            i = j


def words(data: np.ndarray, at: np.ndarray, apart: np.ndarray = WHITE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the words of a block, which the bytes of `apart` separate, and len(at) bounds: document i has words bounds[i] to bounds[i+1]."""
    if not len(data):
        z = np.zeros(0, np.int64)
        return z, z, np.zeros(len(at), np.int64)
    inside = ~apart[data]
    before = np.empty_like(inside)
    before[0] = False
    before[1:] = inside[:-1]
    first = at[:-1][at[:-1] < at[1:]]
    before[first] = False
    starts = np.flatnonzero(inside & ~before)
    after = np.empty_like(inside)
    after[-1] = False
    after[:-1] = inside[1:]
    after[first[first > 0] - 1] = False
    ends = np.flatnonzero(inside & ~after) + 1
    return starts, ends, np.searchsorted(starts, at)


#: Hashes of spans are pairs of polynomials modulo a prime; modulo 2**64, some pairs of texts would collide under every base.
PRIME = np.uint64((1 << 31) - 1)
_BITS = np.uint64(31)
BASE = 0x9E3779B97F4A7C15
BASE2 = 0xC2B2AE3D27D4EB4F
#: Bytes up to which sums need no reduction.
_EXACT = 1 << 24
_POWERS: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def _reduced(x: np.ndarray) -> np.ndarray:
    """x modulo PRIME, in place."""
    for _ in range(2):
        high = x >> _BITS
        x &= PRIME
        x += high
    x[x >= PRIME] -= PRIME
    return x


def _power_row(base: int, m: int) -> np.ndarray:
    out, k, step = np.ones(m, np.uint64), 1, base
    while k < m:
        some = out[: min(k, m - k)] * np.uint64(step)
        out[k : k + len(some)] = _reduced(some)
        k, step = 2 * k, step * step % int(PRIME)
    return out


def powers(n: int, base: int = BASE) -> tuple[np.ndarray, np.ndarray]:
    """Two rows of powers of bases taken from base, and two of their inverses, for exponents i < n at least. They are kept for blocks of usual length only."""
    have = _POWERS.get(base)
    if have is None or have[0].shape[1] < n:
        m, p = next((k + 1 for k in (NARROW_BYTES, BLOCK_BYTES, 4 * BLOCK_BYTES) if n <= k + 1), n), int(PRIME)
        pair = [(base >> 32) % p, base % (1 << 32) % p]
        have = tuple(np.stack([_power_row(b, m).astype(np.uint32) for b in bases]) for bases in (pair, [pow(b, -1, p) for b in pair]))
        if m <= 4 * BLOCK_BYTES + 1:
            _POWERS[base] = have
    return have


def prefix_hash(data: np.ndarray, base: int = BASE) -> np.ndarray:
    """Two rows of len+1 sums of (byte+1) * base**i: with span_hash, a hash of any span in constant time."""
    n = len(data)
    out, pw, x = np.zeros((2, n + 1), np.uint64), powers(n + 1, base)[0], data.astype(np.uint64) + np.uint64(1)
    for r in range(2):
        np.cumsum(x * pw[r, :n], out=out[r, 1:])
        if n > _EXACT:  # sums over all of it would pass 2**64
            carry = np.uint64(0)
            for i in range(0, n, _EXACT):
                part = np.cumsum(x[i : i + _EXACT] * pw[r, i : min(n, i + _EXACT)]) + carry
                out[r, i + 1 : i + 1 + len(part)] = _reduced(part)
                carry = part[-1]
    return out


def mix(h: np.ndarray) -> np.ndarray:
    """Finalizer that spreads all bits of h over all bits."""
    h = h ^ (h >> np.uint64(30))
    h = h * np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(27)
    h *= np.uint64(0x94D049BB133111EB)
    h ^= h >> np.uint64(31)
    return h


def span_hash(sums: np.ndarray, starts: np.ndarray, ends: np.ndarray, base: int = BASE) -> np.ndarray:
    """64-bit hashes of the spans [start, end) of what prefix_hash summed."""
    inverse, pair = powers(sums.shape[1], base)[1], []
    for r in range(2):
        h, low = sums[r][ends], sums[r][starts]
        if sums.shape[1] - 1 > _EXACT:
            h += PRIME * (h < low)
        h -= low
        h = _reduced(h)
        h *= inverse[r][starts]
        pair.append(_reduced(h))
    return mix(pair[0] + (pair[1] << np.uint64(32)) + (ends - starts).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))


def gather(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of the spans one after another, and len+1 offsets."""
    lens = ends - starts
    at = np.zeros(len(lens) + 1, np.int64)
    np.cumsum(lens, out=at[1:])
    return data[np.repeat(starts - at[:-1], lens) + np.arange(at[-1])], at


def binary_array(data: np.ndarray, at: np.ndarray, kind: pa.DataType = pa.binary()) -> pa.Array:
    """An Arrow string or binary array of bytes and offsets."""
    return pa.Array.from_buffers(kind, len(at) - 1, [None, pa.py_buffer(at.astype(np.int32).tobytes()), pa.py_buffer(np.ascontiguousarray(data).tobytes())])


def list_array(values: np.ndarray, at: np.ndarray) -> pa.Array:
    """An Arrow list array of flat values and offsets."""
    return pa.ListArray.from_arrays(pa.array(at.astype(np.int32)), pa.array(values))
