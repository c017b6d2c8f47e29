"""MinHash near-dedup: universal hash minima with banding, signature and full-set verification, large/small-star.

1. Each text gives the set of its distinct word n-grams as 64-bit hashes, and `bands * rows` minima of random affine
   functions (a*x + b, a odd) of them. Texts with equal sets form one class; its least doc_id stands for it, so a group
   of copies is one node from here on.
2. Bands: classes meet in a bucket if `rows` minima agree. A pair of similarity s meets in some bucket with probability
   1 - (1 - s**rows)**bands: with 4 and 32, over 1 - 5e-8 at 0.8. Buckets are split by windows of set size, since sets
   as similar as that differ by a factor of 1.25 in size at most. In a bucket, links to its least member (its leader)
   are proposed, never all pairs.
3. Signature verification drops proposed pairs whose minima agree in under `slack` of all places (0.6: over five
   standard deviations below 0.8), then full shingle sets decide exactly.
4. Components of the confirmed links, by alternating large-star and small-star. A bucket that now lies in one component
   is done. Of the others, those of up to SMALL members propose their pairs across components. Larger ones are documents
   that share much without being near copies of their leader. Two sets as similar as percent share one of their rarest
   shingles, of which each set counts as many as it may lack (a prefix filter); sets that share none of those fall out, and
   the others are joined to clusters by them, dealt by windows of set size into chunks of about CHUNK documents. Each pair
   of chunks takes the exact intersections of all its sets as one product of sparse matrices, and gives at most one link
   for each pair of components that it joins. No bucket is capped, and no task holds more than two chunks; what is left
   quadratic is that product, in the number of documents that share rare shingles without being linked yet.

Defined cases: words are [^\\x20\\x09-\\x0D]+ after lower-casing A-Z. A text of fewer than n words is its whole
word sequence as one shingle; without words (empty, white space or null) the set is empty and linked with nothing.
Rows that repeat a doc_id, or have none, are documents of their own where their texts differ; a component is named by its
least doc_id, and null names it only if it has no other.
An empty table gives an empty result. Extra columns are ignored by components_of(), and kept by dedup().
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from . import common as C
from .components import components

BANDS, ROWS, SLACK = 32, 4, 0.6
#: Members of a bucket up to which pairs across its components are proposed; larger ones are split first.
SMALL = 64
#: Documents in a chunk of a cluster, and columns of a matrix of shingles at once.
CHUNK, COLUMNS = 768, 4096
#: Of the 128 lowest bits of minima, so many may differ in proposed pairs (13 are expected at 0.8, with a deviation of 3.4).
BITS_APART = 34
#: Shingles whose minima are taken in one numpy pass.
_STEP = 2048


def shingle_hashes(data: np.ndarray, at: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of all word n-grams of a block of lower-cased texts, in order, and their bounds by document."""
    starts, ends, bounds = C.words(data, at)
    word = C.span_hash(C.prefix_hash(data), starts, ends)
    counts = np.diff(bounds)
    m = np.where(counts >= n, counts - n + 1, np.minimum(counts, 1))
    out_at = np.zeros(len(m) + 1, np.int64)
    np.cumsum(m, out=out_at[1:])
    first = np.repeat(bounds[:-1] - out_at[:-1], m) + np.arange(out_at[-1])  # the first word of each shingle
    length = np.repeat(np.minimum(counts, n), m)
    h = length.astype(np.uint64)
    for k in range(n):
        use = np.minimum(first + k, max(len(word) - 1, 0))
        step = C.mix(h * np.uint64(0x9FB21C651E98DF25) + word[use]) if len(word) else h
        h = np.where(length > k, step, h)
    return h, out_at


def _affine(count: int) -> tuple[np.ndarray, np.ndarray]:
    draw = np.random.default_rng(20240607)
    return draw.integers(0, 1 << 31, count, dtype=np.uint32) * np.uint32(2) + np.uint32(1), draw.integers(0, 1 << 32, count, dtype=np.uint32)


def minima(distinct: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The least of a*x + b mod 2**32 over x, for each (a, b)."""
    x = (distinct >> np.uint64(32)).astype(np.uint32)
    out = np.full(len(a), 0xFFFFFFFF, np.uint32)
    for i in range(0, len(x), _STEP):
        part = x[None, i : i + _STEP] * a[:, None]
        part += b[:, None]
        np.minimum(out, part.min(axis=1), out=out)
    return out


def sign(docs: DataFrame, n: int, bands: int, rows: int) -> DataFrame:
    """doc_id, n_shingles, s1, s2 (128-bit hash of the set), b1, b2 (lowest bits of the first 128 minima), sig (lowest bytes of all minima), band (one hash for each band) of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a, b = _affine(bands * rows)
        for part, data, at in C.blocks(batches, limit=C.NARROW_BYTES):
            h, bounds = shingle_hashes(C.LOWER[data], at, n)
            k = part.num_rows
            size, s1, s2 = np.zeros(k, np.int64), np.zeros(k, np.int64), np.zeros(k, np.int64)
            sigs = np.zeros((k, bands * rows), np.uint32)
            for i in range(k):
                own = np.unique(h[bounds[i] : bounds[i + 1]])
                size[i] = len(own)
                if len(own):
                    s1[i], s2[i] = (C.mix(own).sum(dtype=np.uint64).astype(np.int64), C.mix(own ^ np.uint64(C.BASE2)).sum(dtype=np.uint64).astype(np.int64))
                    sigs[i] = minima(own, a, b)
            quads = sigs.reshape(k * bands, rows).astype(np.uint64)
            key = np.tile(np.arange(bands, dtype=np.uint64), k)
            for r in range(rows):
                key = C.mix(key * np.uint64(C.BASE) + quads[:, r])
            band = pa.ListArray.from_arrays(pa.array(np.arange(0, k * bands + 1, bands, dtype=np.int32)), pa.array(key.view(np.int64)))
            sig = pa.array([x.tobytes() for x in (sigs & np.uint32(255)).astype(np.uint8)], pa.binary())
            low = np.zeros((k, 128), np.uint8)
            low[:, : sigs.shape[1]] = (sigs & np.uint32(1))[:, :128]
            low = np.packbits(low, axis=1).view(np.int64)
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(size), pa.array(s1), pa.array(s2), pa.array(low[:, 0]), pa.array(low[:, 1]), sig, band], names=["doc_id", "n_shingles", "s1", "s2", "b1", "b2", "sig", "band"])

    C.small_batches(docs.sparkSession)
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, n_shingles long, s1 long, s2 long, b1 long, b2 long, sig binary, band array<long>")


def _agreeing(slack: float):
    """Of rows (u, v, su, sv), the pairs whose signatures agree in `slack` of all places."""

    def run(batches):
        for batch in batches:
            su, sv = (np.frombuffer(b"".join(batch.column(c).to_pylist()), np.uint8).reshape(batch.num_rows, -1) for c in ("su", "sv"))
            yield batch.select(["u", "v"]).filter(pa.array((su == sv).mean(axis=1) >= slack))

    return run


def _confirm(n: int, percent: int):
    """Rows sorted by (u, salt, kind): u, then the v to compare with it, each with its text. Gives the links (u, v)."""

    def run(batches):
        text = own = None
        for batch in batches:
            us, vs = [], []
            for u, v, kind, raw in zip(*(batch.column(c).to_pylist() for c in ("u", "v", "kind", "raw")), strict=True):
                if kind == 0:
                    text, own = raw, None
                    continue
                if own is None:
                    own = _set_of(text, n)
                s = _set_of(raw, n)
                both = len(np.intersect1d(own, s, assume_unique=True))
                if 100 * both >= percent * (len(own) + len(s) - both):
                    us.append(u)
                    vs.append(v)
            yield pa.RecordBatch.from_arrays([pa.array(us, pa.int64()), pa.array(vs, pa.int64())], names=["u", "v"])

    return run


def _set_of(text: bytes, n: int) -> np.ndarray:
    data = C.LOWER[np.frombuffer(text, np.uint8)]
    return np.unique(shingle_hashes(data, np.array([0, len(data)]), n)[0])


def links(pairs: DataFrame, signed: DataFrame, docs: DataFrame, n: int, percent: int, slack: float) -> DataFrame:
    """The pairs (u, v) of class representatives that are as similar as percent: signatures are compared first, on narrow rows; only what they leave brings its texts together."""
    sigs = signed.select(F.col("doc_id").alias("d"), "sig")
    ends = C.cut(pairs.select(F.explode(F.array("u", "v")).alias("e")).distinct(), "minhash-ids")
    sigs = C.cut(C.only(sigs, "d", ends, "e").dropDuplicates(["d"]), "minhash-sigs")
    both = pairs.join(sigs.select("d", F.col("sig").alias("su")), F.col("u") == F.col("d")).drop("d").join(sigs.select("d", F.col("sig").alias("sv")), F.col("v") == F.col("d")).drop("d")
    alike = C.cut(both.mapInArrow(_agreeing(slack), "u long, v long"), "minhash-alike")
    # a u with many partners is dealt over as many groups as they need
    size = alike.groupBy(F.col("u").alias("w")).agg(F.ceil(F.count("*") / 256).alias("groups"))
    salted = C.cut(alike.join(size, F.col("u") == F.col("w")).select("u", "v", F.pmod(F.xxhash64("v"), F.col("groups")).alias("salt")), "minhash-salted")
    need = salted.select(F.col("v").alias("d"), "u", "v", "salt", F.lit(1).alias("kind")).unionByName(salted.select(F.col("u").alias("d"), "u", F.col("u").alias("v"), "salt", F.lit(0).alias("kind")).distinct())
    ids = C.cut(salted.select(F.explode(F.array("u", "v")).alias("e")).distinct(), "minhash-ids")
    texts = C.only(docs, "doc_id", ids, "e").select("doc_id", F.coalesce("text", F.lit("")).cast("binary").alias("raw"))
    rows = need.join(texts, F.col("doc_id") == F.col("d")).select("u", "salt", "kind", "v", "raw")
    return rows.repartition("u", "salt").sortWithinPartitions("u", "salt", "kind").mapInArrow(_confirm(n, percent), "u long, v long")


def _near_labels(found: DataFrame) -> DataFrame:
    """id, component: the least neighbour, and its least neighbour: components, but for links of more steps."""
    least = C.cut(found.groupBy(F.greatest("u", "v").alias("id")).agg(F.min(F.least("u", "v")).alias("component")), "minhash-near")
    up = least.select(F.col("id").alias("i"), F.col("component").alias("c"))
    return least.join(up, F.col("component") == F.col("i"), "left").select("id", F.coalesce("c", "component").alias("component"))


def _pairs(u: str, v: str, percent: int):
    """What two members of a bucket must meet to be proposed: sizes and lowest bits can't rule out that they are similar."""
    sizes = (F.col(f"{u}.n") * 100 >= F.col(f"{v}.n") * percent) & (F.col(f"{v}.n") * 100 >= F.col(f"{u}.n") * percent)
    apart = sum((F.bit_count(F.col(f"{u}.{b}").bitwiseXOR(F.col(f"{v}.{b}"))) for b in ("b1", "b2")), F.lit(0))
    return sizes & (apart <= BITS_APART)


def _stars(bucket: DataFrame, percent: int) -> DataFrame:
    """Links (u, v) of each member with its bucket's leader, the least member."""
    item = F.struct("doc_id", "n", "b1", "b2")
    lead = bucket.groupBy("key").agg(F.min(item).alias("x")).withColumnRenamed("key", "k")
    both = bucket.select("key", item.alias("y")).join(lead, F.col("key") == F.col("k")).where("x.doc_id < y.doc_id")
    return both.where(_pairs("x", "y", percent)).select(F.col("x.doc_id").alias("u"), F.col("y.doc_id").alias("v")).distinct()


def _meeting(rows: DataFrame) -> DataFrame:
    """The rows whose key occurs more than once."""
    again = C.cut(rows.groupBy(F.col("key").alias("k")).agg(F.count("*").alias("members")).where("members > 1").select("k"), "minhash-keys")
    return C.only(rows, "key", again, "k")


def _class(n, percent: int):
    """Sets as similar as percent are of one size class or of neighbouring ones."""
    return F.floor(F.log(n) / F.log(F.lit(100.0 / percent)) + 1e-9)


def _sets(n: int):
    def run(batches):
        for part, data, at in C.blocks(batches, limit=C.NARROW_BYTES):
            h, bounds = shingle_hashes(C.LOWER[data], at, n)
            sets = [np.unique(h[a:b]).tobytes() for a, b in zip(bounds[:-1], bounds[1:], strict=True)]
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(sets, pa.binary())], names=["s_id", "set"])

    return run


def _each(batches):
    """Rows (s_id, set) as rows (doc_id, size, h)."""
    for batch in batches:
        for i in range(0, batch.num_rows, 256):
            part = batch.slice(i, 256)
            sets = [np.frombuffer(x, np.int64) for x in part.column("set").to_pylist()]
            size = np.array([len(x) for x in sets])
            yield pa.RecordBatch.from_arrays([part.column("s_id").take(pa.array(np.repeat(np.arange(len(sets)), size))), pa.array(np.repeat(size, size)), pa.array(np.concatenate(sets))], names=["doc_id", "size", "h"])


def rarest(sets: DataFrame, percent: int) -> DataFrame:
    """doc_id, h: of each of sets(s_id, set) its rarest hashes, so many that two sets as similar as percent have one in common; those that no other set has are left out."""
    each = sets.mapInArrow(_each, "doc_id long, size long, h long")
    often = each.groupBy(F.col("h").alias("g")).agg(F.count("*").alias("df")).where("df > 1")
    by_doc = W.partitionBy("doc_id")
    met = each.join(often, F.col("h") == F.col("g")).withColumn("place", F.col("size") - F.count("*").over(by_doc) + F.row_number().over(by_doc.orderBy("df", "h")))
    return met.where(F.col("place") <= F.col("size") - F.floor((F.col("size") * percent + 99) / 100) + 1).select("doc_id", "h")


def cross_links(left: list[np.ndarray], right: list[np.ndarray], percent: int) -> np.ndarray:
    """For all (i, j), whether left[i] and right[j] (sorted distinct hashes) are as similar as percent."""
    n = len(left)
    flat = np.concatenate([*left, *right])
    owner = np.repeat(np.arange(n + len(right)), [len(x) for x in (*left, *right)])
    _, column, times = np.unique(flat, return_inverse=True, return_counts=True)
    shared = times > 1  # the others can't be in an intersection
    number = np.cumsum(shared) - 1
    use = shared[column]
    owner, column = owner[use], number[column[use]]
    order = np.argsort(column, kind="stable")
    owner, column = owner[order], column[order]
    both = np.zeros((n, len(right)), np.float64)
    for lo in range(0, int(shared.sum()), COLUMNS):
        i, j = np.searchsorted(column, (lo, lo + COLUMNS))
        m = np.zeros((n + len(right), min(COLUMNS, int(shared.sum()) - lo)), np.float32)
        m[owner[i:j], column[i:j] - lo] = 1
        both += m[:n] @ m[n:].T
    sizes = np.array([len(x) for x in left])[:, None] + np.array([len(x) for x in right])[None, :]
    return (100 + percent) * both >= percent * sizes


def _chunk_pairs(percent: int):
    """Rows sorted by pair of chunks; gives links that join the components of a pair."""

    def solve(rows):
        if not rows or not any(r[1] == 0 for r in rows) or not any(r[1] == 1 for r in rows):
            return [], []
        a, b = ([r for r in rows if r[1] == side] for side in (0, 1))
        hit = cross_links([r[4] for r in a], [r[4] for r in b], percent)
        root: dict[int, int] = {}

        def find(x):
            while root.get(x, x) != x:
                x = root[x] = root.get(root[x], root[x])
            return x

        us, vs = [], []
        for i, j in zip(*np.nonzero(hit), strict=True):
            x, y = find(a[i][3]), find(b[j][3])
            if x != y:
                root[max(x, y)] = min(x, y)
                us.append(a[i][2])
                vs.append(b[j][2])
        return us, vs

    def run(batches):
        now, rows = None, []
        for batch in batches:
            us, vs = [], []
            for pair, side, doc_id, comp, raw in zip(*(batch.column(c).to_pylist() for c in ("pair", "side", "doc_id", "comp", "set")), strict=True):
                if pair != now:
                    u, v = solve(rows)
                    us += u
                    vs += v
                    now, rows = pair, []
                rows.append((pair, side, doc_id, comp, np.frombuffer(raw, np.uint64)))
            yield pa.RecordBatch.from_arrays([pa.array(us, pa.int64()), pa.array(vs, pa.int64())], names=["u", "v"])
        us, vs = solve(rows)
        yield pa.RecordBatch.from_arrays([pa.array(us, pa.int64()), pa.array(vs, pa.int64())], names=["u", "v"])

    return run


def _cluster_links(large: DataFrame, docs: DataFrame, n: int, percent: int, chunk: int) -> DataFrame:
    """Links across components between all members of large buckets that share one of their rarest shingles."""
    ids = C.cut(large.select(F.col("doc_id").alias("d")).distinct(), "minhash-ids")
    sets = C.cut(C.only(docs, "doc_id", ids, "d").mapInArrow(_sets(n), "s_id long, set binary").dropDuplicates(["s_id"]), "minhash-sets")
    rare = C.cut(rarest(sets, percent), "minhash-rare")
    lead = rare.groupBy(F.col("h").alias("k")).agg(F.min("doc_id").alias("u"))
    cluster = components(rare.join(lead, F.col("h") == F.col("k")).select("u", F.col("doc_id").alias("v")))
    some = large.select("doc_id", "n", "comp").distinct().join(rare.select(F.col("doc_id").alias("d")).distinct(), F.col("doc_id") == F.col("d"), "left_semi")
    member = some.join(cluster, F.col("doc_id") == F.col("id"), "left").select("doc_id", "comp", F.coalesce("component", "doc_id").alias("cluster"), _class(F.col("n"), percent).alias("class"))
    member = C.cut(member, "minhash-cluster")
    size = member.groupBy(F.col("cluster").alias("x"), F.col("class").alias("y")).agg(F.ceil(F.count("*") / chunk).cast("int").alias("chunks"))
    of = lambda shift, name: size.select(F.col("x").alias(f"x{name}"), (F.col("y") - shift).alias(f"y{name}"), F.col("chunks").alias(name))
    for shift, name in ((0, "own"), (1, "above"), (-1, "below")):
        member = member.join(of(shift, name), (F.col("cluster") == F.col(f"x{name}")) & (F.col("class") == F.col(f"y{name}")), "left").drop(f"x{name}", f"y{name}")
    member = member.withColumn("c", F.pmod(F.xxhash64("doc_id"), F.col("own")).cast("int"))
    to = lambda x: F.sequence(F.lit(0), F.coalesce(F.col(x), F.lit(0)) - 1)
    some = lambda x, f: F.when(F.coalesce(F.col(x), F.lit(0)) > 0, F.transform(to(x), f)).otherwise(F.array().cast("array<struct<a:int,b:int,k:int,side:int>>"))
    row = lambda a, b, k, side: F.struct(a.cast("int").alias("a"), b.cast("int").alias("b"), F.lit(k).alias("k"), side.cast("int").alias("side"))
    # a pair of chunks of one class, with both sides in a chunk's pair with itself; then pairs with the class above
    same = some("own", lambda i: row(F.least(i, F.col("c")), F.greatest(i, F.col("c")), 0, (i < F.col("c")).cast("int")))
    twice = F.array(row(F.col("c"), F.col("c"), 0, F.lit(1)))
    pairs = F.concat(same, twice, some("above", lambda i: row(F.col("c"), i, 1, F.lit(0))), some("below", lambda i: row(i, F.col("c"), 1, F.lit(1))))
    dealt = member.select("doc_id", "comp", "cluster", "class", F.explode(pairs).alias("p"))
    low = F.when((F.col("p.k") == 1) & (F.col("p.side") == 1), F.col("class") - 1).otherwise(F.col("class"))
    dealt = dealt.select("doc_id", "comp", F.xxhash64("cluster", low, "p.k", "p.a", "p.b").alias("pair"), F.col("p.side").alias("side"))
    return dealt.join(sets, F.col("doc_id") == F.col("s_id")).select("pair", "side", "doc_id", "comp", "set").repartition("pair").sortWithinPartitions("pair", "doc_id").mapInArrow(_chunk_pairs(percent), "u long, v long")


def _classify(docs: DataFrame, n: int, percent: int, bands: int = BANDS, rows: int = ROWS, slack: float = SLACK, small: int = SMALL, chunk: int = CHUNK) -> DataFrame:
    """doc_id, n_shingles, component_id, kept for every row of docs(doc_id, text), in which no id has two texts."""
    signed = C.cut(sign(docs, n, bands, rows), "minhash-signed")
    classes = signed.where("n_shingles > 0").groupBy("s1", "s2").agg(F.min("doc_id").alias("rep"))
    member = C.cut(signed.select("doc_id", "n_shingles", "s1", "s2").join(classes, ["s1", "s2"], "left").select("doc_id", "n_shingles", "rep"), "minhash-member")
    first = C.cut(member.where("doc_id = rep").select(F.col("rep").alias("r")).distinct(), "minhash-rep")
    reps = C.cut(C.only(signed.select("doc_id", F.col("n_shingles").alias("n"), "b1", "b2", "band"), "doc_id", first, "r"), "minhash-reps")
    met = C.cut(_meeting(reps.select("doc_id", F.explode("band").alias("key"))), "minhash-met")
    own = C.only(reps, "doc_id", C.cut(met.select(F.col("doc_id").alias("d")).distinct(), "minhash-ids"), "d").select(F.col("doc_id").alias("d"), "n", "b1", "b2")
    size = _class(F.col("n"), percent)
    bucket = C.cut(_meeting(met.join(own, F.col("doc_id") == F.col("d")).select("doc_id", "n", "b1", "b2", F.explode(F.array(F.xxhash64("key", size), F.xxhash64("key", size + 1))).alias("key"))), "minhash-bucket")
    C.drop_cut(reps)
    C.drop_cut(met)
    proposed = C.cut(_stars(bucket, percent), "minhash-pairs")
    found = C.cut(links(proposed, signed, docs, n, percent, slack), "minhash-links")
    comp = _near_labels(found)  # what it misses is only proposed once more
    at = bucket.join(comp, F.col("doc_id") == F.col("id"), "left").withColumn("comp", F.coalesce("component", "doc_id")).drop("id", "component")
    state = at.groupBy(F.col("key").alias("k")).agg(F.count("*").alias("members"), F.min("comp").alias("lo"), F.max("comp").alias("hi")).where("lo < hi and members > 2")
    left = C.cut(at.join(state, F.col("key") == F.col("k")).drop("k", "lo", "hi"), "minhash-open")
    C.drop_cut(bucket)
    x, y = left.where(F.col("members") <= small).alias("x"), left.where(F.col("members") <= small).alias("y")
    across = x.join(y, (F.col("x.key") == F.col("y.key")) & (F.col("x.doc_id") < F.col("y.doc_id")) & (F.col("x.comp") != F.col("y.comp"))).where(_pairs("x", "y", percent))
    across = C.cut(across.select(F.col("x.doc_id").alias("u"), F.col("y.doc_id").alias("v")).distinct().join(proposed, ["u", "v"], "left_anti"), "minhash-pairs")
    edges = found.unionByName(C.cut(links(across, signed, docs, n, percent, slack), "minhash-links"))
    large = left.where(F.col("members") > small)
    if not large.isEmpty():
        edges = edges.unionByName(C.cut(_cluster_links(large, docs, n, percent, chunk), "minhash-links"))
    comp = components(edges)
    named = member.join(comp, F.col("rep") == F.col("id"), "left")
    component = F.coalesce("component", "rep", "doc_id")
    return named.select("doc_id", "n_shingles", component.alias("component_id"), F.col("doc_id").eqNullSafe(component).alias("kept"))


def classify(docs: DataFrame, n: int = 5, percent: int = 80, **options) -> DataFrame:
    """doc_id, n_shingles, component_id, kept for every row of docs(doc_id, text)."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    named, row = C.own_ids(docs, False, False)
    if row == "doc_id":
        return _classify(docs, n, percent, **options)
    # ids of rows are in the order of doc_id, so the least of a component has its least doc_id
    found = _classify(named.select(F.col(row).alias("doc_id"), "text"), n, percent, **options)
    names = C.cut(named.select(F.col(row).alias("r"), F.col("doc_id").alias("own")).distinct(), "minhash-names")
    found = found.join(names, F.col("doc_id") == F.col("r")).drop("r").join(names.select("r", F.col("own").alias("least")), F.col("component_id") == F.col("r"))
    return found.select(F.col("own").alias("doc_id"), "n_shingles", F.col("least").alias("component_id"), F.col("own").eqNullSafe(F.col("least")).alias("kept"))


def dedup(docs: DataFrame, n: int = 5, percent: int = 80, once: bool = False, **options) -> DataFrame:
    """One document of each component, with all columns of docs; with once, rows that repeat id and text are copies too."""
    return C.dedup_rows(docs, lambda d: classify(d, n, percent, **options), False, once)
