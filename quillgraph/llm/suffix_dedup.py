"""Removal of long byte strings that occur more than once, by bounded interval expansion on a Burrows-Wheeler transform.

Every byte that a string of `length` bytes covers is removed if that string also starts anywhere else (in another or
the same document; overlaps count; all is judged on the input).

1. Anchors. Each window of `length` bytes is assigned the k-gram in it with the least hash (winnowing, leftmost of
   equals), so equal windows have equal anchors. A document gives one row for each run of windows with one anchor.
2. Runs whose anchor occurs once in the corpus hold no repeated window and end here. Of the others, the bytes of the
   run's windows (its segment) go to their anchor's group.
3. A task leaves out windows that can't occur twice (by the cores of 4., which are compared byte by byte), packs whole
   groups into blocks of about BLOCK bytes, sorts the suffixes of what is left of a block's distinct segments, takes the
   Burrows-Wheeler transform, and extends intervals backward, breadth first, one character a level: at level v exactly the common prefixes of length v between neighbouring suffixes are found, by increasing value. It
   stops at `length`: where no value was found by then, two neighbours share `length` bytes.
4. An anchor with more than HEAVY runs (a passage that very many documents share) would be one large group. Its
   distinct segments are split by ranges of the window's place relative to the anchor instead: all windows of a range
   share a core of bytes, whose 128-bit hash deals them out; ranges whose core occurs once are done, the others are
   split into finer ranges, until a range is one window. Nothing is capped, and no group is gathered.
5. Repeated windows go back to their documents, where overlapping ones are united and cut out.

Defined cases: null text is empty; texts under `length` bytes lose nothing; a text equal to another loses all of its
bytes if it has `length` of them. Rows that repeat a doc_id are documents of their own (a row is known by its doc_id
and the hash of its text; rows equal in both are copies of each other). An empty table gives an empty result. Extra
columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common as C

LENGTH, GRAM = 400, 32
#: Bytes of distinct segments in one transform.
BLOCK = 1 << 20
#: Runs of an anchor beyond which its group is split by ranges.
HEAVY = 2048
#: Bits of the place relative to the anchor that the ranges of a heavy group leave open, step by step.
STEPS = (7, 5, 3, 2, 1, 0)
#: The same bits for the ranges by which a task looks for windows that can't occur twice before it builds the transform.
FINE = 6


def _window_min(x: np.ndarray, w: int) -> np.ndarray:
    """Minima of x over all windows of w, by running minima from both ends of pieces of w."""
    n = len(x) - w + 1
    if n <= 0:
        return x[:0]
    padded = np.full(-(-len(x) // w) * w, np.iinfo(np.uint64).max, np.uint64)
    padded[: len(x)] = x
    parts = padded.reshape(-1, w)
    ahead = np.minimum.accumulate(parts, axis=1).reshape(-1)
    back = np.minimum.accumulate(parts[:, ::-1], axis=1)[:, ::-1].reshape(-1)
    return np.minimum(back[:n], ahead[w - 1 : w - 1 + n])


def gram_hash(data: np.ndarray, k: int) -> np.ndarray:
    """Hashes of all k-grams. Unequal grams may share one, which only brings their anchors into one group."""
    out, taken, h, size = None, 0, data.astype(np.uint64) + np.uint64(1), 1  # h: hashes of all runs of size bytes
    while True:
        if k & size:
            at = h[taken:]
            out = at if out is None else out[: len(at)] * np.uint64(pow(C.BASE, size, 1 << 64)) + at
            taken += size
        if taken == k:
            return C.mix(out)
        h = h[:-size] * np.uint64(pow(C.BASE, size, 1 << 64)) + h[size:]
        size *= 2


def runs(data: np.ndarray, at: np.ndarray, length: int, gram: int) -> tuple[np.ndarray, ...]:
    """(document, first window, windows, offset of the anchor from the first window, anchor's hash) of each run of a block."""
    none = np.zeros(0, np.int64)
    if len(data) < length:
        return none, none, none, none, none
    h = gram_hash(data, gram)
    place = np.arange(len(h), dtype=np.uint64)
    least = _window_min((h & np.uint64(0xFFFFFFFF00000000)) | place, length - gram + 1)
    doc = np.searchsorted(at, np.arange(len(least)), "right") - 1
    good = np.flatnonzero(np.arange(len(least)) + length <= at[doc + 1])
    if not len(good):
        return none, none, none, none, none
    anchor = (least[good] & np.uint64(0xFFFFFFFF)).astype(np.int64)
    new = np.r_[True, (np.diff(anchor) != 0) | (np.diff(doc[good]) != 0)]
    first = np.flatnonzero(new)
    lo = good[first]
    return doc[lo], lo - at[doc[lo]], np.diff(np.r_[first, len(good)]), anchor[first] - lo, h[anchor[first]].view(np.int64)


def suffix_order(text: np.ndarray, depth: int) -> np.ndarray:
    """Places of the rotations of text, sorted by their first `depth` bytes at least (prefix doubling)."""
    n = len(text)
    key = np.zeros(n, np.uint64)
    for k in range(8):
        key = (key << np.uint64(8)) | np.roll(text, -k).astype(np.uint64)
    k = 8
    while True:
        order = np.argsort(key, kind="stable") if n < 1000 else np.argsort(key)
        s = key[order]
        rank = np.empty(n, np.uint64)
        rank[order] = np.cumsum(np.r_[False, s[1:] != s[:-1]]).astype(np.uint64)
        if k >= depth or rank.max() == n - 1:
            return order
        key = (rank << np.uint64(32)) | np.roll(rank, -k)
        k *= 2


def shared_prefixes(text: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """The suffix order, and for each place i in it whether the suffixes at i - 1 and i share `length` bytes or more."""
    n = len(text)
    order = suffix_order(text, length + 1)
    bwt = text[order - 1].astype(np.int64)  # order 0 takes the last byte: rotations
    step_back = np.empty(n, np.int64)  # the place of the suffix that is one character longer
    by_char = np.argsort(text[order - 1], kind="stable")
    step_back[by_char] = np.arange(n)
    keys = bwt[by_char] * n + by_char  # the rank of c * n + i among them is where the interval of c before i begins
    alphabet = np.unique(bwt)
    open_ = np.ones(n + 1, bool)  # whether the common prefix of i - 1 and i is still unknown
    open_[0] = open_[n] = False
    lb, rb = np.array([0]), np.array([n])
    for _ in range(length):
        width = rb - lb
        wide = width > 2 * len(alphabet)
        to_l, to_r = [], []
        if wide.any():
            c = np.tile(alphabet, int(wide.sum())) * n
            to_l.append(np.searchsorted(keys, c + np.repeat(lb[wide], len(alphabet))))
            to_r.append(np.searchsorted(keys, c + np.repeat(rb[wide], len(alphabet))))
        if not wide.all():
            l, r = lb[~wide], rb[~wide]  # noqa: E741
            alone = r - l == 1  # mostly
            two = np.flatnonzero(~alone)
            one = bwt[l] == bwt[r - 1]
            if len(two):
                w = r[two] - l[two]
                first = np.cumsum(w) - w
                ch = bwt[np.repeat(l[two] - first, w) + np.arange(int(w.sum()))]
                one[two] = np.minimum.reduceat(ch, first) == np.maximum.reduceat(ch, first)
                mixed = np.flatnonzero(~one[two])
                if len(mixed):
                    many = np.repeat(~one[two], w)
                    owner = np.repeat(two, w)[many]
                    pair, at, times = np.unique(owner * 256 + ch[many], return_index=True, return_counts=True)
                    place = (np.repeat(l[two] - first, w) + np.arange(int(w.sum())))[many][at]
                    to_l.append(step_back[place])
                    to_r.append(step_back[place] + times)
            to_l.append(step_back[l[one]])
            to_r.append(step_back[l[one]] + (r - l)[one])
        lb, rb = np.concatenate(to_l), np.concatenate(to_r)
        some = (rb > lb) & open_[rb]
        lb, rb = lb[some], rb[some]
        open_[rb] = False
        if not len(lb):
            break
    return order, open_[:n]


def repeated_starts(segments: list[bytes], counts: list[int], length: int) -> list[np.ndarray]:
    """For each segment, which of its windows occur again: in another segment, elsewhere in itself, or because it occurs twice as a whole."""
    joined = b"\xff".join(segments) + b"\xff"  # no byte of UTF-8
    text = np.frombuffer(joined, np.uint8)
    order, shared = shared_prefixes(text, length)
    again = np.zeros(len(text), bool)
    again[order] = shared | np.r_[shared[1:], False]
    out, at = [], 0
    for s, c in zip(segments, counts, strict=True):
        n = len(s) - length + 1
        out.append(np.ones(n, bool) if c > 1 else again[at : at + n].copy())
        at += len(s) + 1
    return out


def possible(group: list[tuple[bytes, int, int]], length: int, bits: int = FINE) -> list[list[tuple[int, int]]]:
    """For each (segment, count, offset of the anchor) of one anchor, the [from, to) of its windows that could occur again: all windows of a range of places share a core, and ranges whose core no other segment has are left out."""
    cores: dict[tuple[int, bytes], int] = {}
    own = []
    for seg, count, off in group:
        mine = []
        for r in range((off - (len(seg) - length)) >> bits, (off >> bits) + 1):
            lo = off - (r << bits)
            key = (r, seg[lo : max(lo, off - ((r + 1 << bits) - 1) + length)])
            cores[key] = cores.get(key, 0) + min(count, 2)
            mine.append(key)
        own.append(mine)
    out = []
    for (seg, _, off), mine in zip(group, own, strict=True):
        spans: list[tuple[int, int]] = []
        for key in reversed(mine):
            if cores[key] > 1:
                lo, hi = max(0, off - ((key[0] + 1 << bits) - 1)), min(len(seg) - length, off - (key[0] << bits)) + 1
                if spans and spans[-1][1] == lo:
                    spans[-1] = (spans[-1][0], hi)
                else:
                    spans.append((lo, hi))
        out.append(spans)
    return out


def _ranges(flags: np.ndarray) -> list[dict]:
    edge = np.flatnonzero(np.diff(np.r_[False, flags, False].astype(np.int8)))
    return [{"a": int(a), "b": int(b)} for a, b in zip(edge[::2], edge[1::2], strict=True)]


_RANGES = pa.list_(pa.struct([("a", pa.int32()), ("b", pa.int32())]))


def _keyed(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text")).withColumn("key", F.xxhash64("doc_id", "text"))


def _segments(length: int):
    """Each row is a document and its runs; gives a row for each run, with the segment's bytes unless the task gave them twice already."""

    def run(batches):
        seen: dict[tuple[int, int], int] = {}
        for part, data, at in C.blocks(batches):
            col = part.column("runs")
            flat, row = col.flatten(), np.repeat(np.arange(part.num_rows), col.value_lengths().to_numpy(zero_copy_only=False))
            fp, lo, n, off, heavy = (flat.field(i).to_numpy(zero_copy_only=False) for i in range(5))
            start = at[row] + lo
            end = start + n + length - 1
            h1 = C.span_hash(C.prefix_hash(data), start, end).view(np.int64)
            h2 = C.span_hash(C.prefix_hash(data, C.BASE2), start, end, C.BASE2).view(np.int64)
            give = np.zeros(len(row), bool)
            for i, k in enumerate(zip(h1.tolist(), h2.tolist(), strict=True)):
                t = seen.get(k, 0)
                if t < 2:
                    seen[k], give[i] = t + 1, True
            if len(seen) > 300_000:
                seen.clear()
            chars, chars_at = C.gather(data, start[give], end[give])
            raw = C.binary_array(chars, chars_at).take(pa.array(np.where(give, np.cumsum(give) - 1, 0), mask=~give)) if give.any() else pa.nulls(len(row), pa.binary())
            take = pa.array(row)
            yield pa.RecordBatch.from_arrays(
                [pa.array(fp), pa.array(h1), pa.array(h2), part.column("doc_id").take(take), part.column("key").take(take), pa.array(lo), pa.array(n), pa.array(off), pa.array(heavy), raw],
                names=["fp", "h1", "h2", "doc_id", "key", "lo", "n", "off", "heavy", "bytes"],
            )

    return run


def _index(length: int, block: int):
    """Rows sorted by anchor (fp); gives the repeated windows of each distinct segment."""

    def run(batches):
        # pieces of segments that wait for a transform: (h1, h2), first window, bytes, count
        waiting: list[tuple[tuple[int, int], int, bytes, int]] = []
        size, now, group, ready = 0, None, {}, []

        def close():
            nonlocal size
            items = list(group.items())
            if len(items) == 1:  # all segments of the anchor are the same: there is nothing to compare
                (key, (seg, count, _)), *_rest = items
                if count > 1:
                    ready.append((key, [{"a": 0, "b": len(seg) - length + 1}]))
                return
            for (key, (seg, count, _)), spans in zip(items, possible([tuple(x) for _, x in items], length), strict=True):
                if count > 1:
                    ready.append((key, [{"a": 0, "b": len(seg) - length + 1}]))
                for lo, hi in spans:
                    waiting.append((key, lo, seg[lo : hi + length - 1], count))
                    size += hi - lo + length

        def flush():
            nonlocal size
            flags = repeated_starts([w[2] for w in waiting], [1] * len(waiting), length) if waiting else []
            for (key, lo, _, count), f in zip(waiting, flags, strict=True):
                if count == 1 and f.any():
                    ready.append((key, [{"a": r["a"] + lo, "b": r["b"] + lo} for r in _ranges(f)]))
            waiting.clear()
            size = 0

        def made():
            out = pa.RecordBatch.from_arrays([pa.array([k[0] for k, _ in ready], pa.int64()), pa.array([k[1] for k, _ in ready], pa.int64()), pa.array([r for _, r in ready], _RANGES)], names=["g1", "g2", "ranges"])
            ready.clear()
            return out

        for batch in batches:
            fp, h1, h2, off, raw = (batch.column(i).to_pylist() for i in range(5))
            for f, a, b, o, seg in zip(fp, h1, h2, off, raw, strict=True):
                if f != now:
                    close()
                    now, group = f, {}
                    if size >= block:
                        flush()
                have = group.setdefault((a, b), [seg, 0, o])
                have[1] += 1
            yield made()
        close()
        flush()
        yield made()

    return run


def _cores(length: int, bits: int, before: int | None):
    """Heavy segments with the ranges (of `before` bits) that are left of them; gives each finer range of `bits` bits with its windows [a, b), the hash of its core, and that of all its windows' bytes."""

    def run(batches):
        for part, data, at in C.blocks(batches, "bytes"):
            sums, sums2 = C.prefix_hash(data), C.prefix_hash(data, C.BASE2)
            h1, h2, n, off, left = (part.column(c).to_pylist() for c in ("h1", "h2", "n", "off", "left"))
            rows, rng = [], []
            for i in range(part.num_rows):
                high, low = off[i], off[i] - n[i] + 1  # places of the anchor in the segment's windows
                if before is None:
                    fine = range(low >> bits, (high >> bits) + 1)
                else:
                    fine = [x for r in left[i] for x in range(max(low >> bits, (r << before) >> bits), min(high >> bits, ((r + 1 << before) - 1) >> bits) + 1)]
                rows += [i] * len(fine)
                rng += fine
            row, r = np.array(rows, np.int64), np.array(rng, np.int64)
            if not len(row):
                continue
            offs, ns = np.array(off)[row], np.array(n)[row]
            anchor = at[row] + offs
            start, end = anchor - (r << bits), anchor - ((r + 1 << bits) - 1) + length
            a, b = np.maximum(0, offs - ((r + 1 << bits) - 1)), np.minimum(ns, offs - (r << bits) + 1)
            w0, w1 = at[row] + a, at[row] + b - 1 + length
            hashes = [C.span_hash(s, x, y, base).view(np.int64) for x, y in ((start, end), (w0, w1)) for s, base in ((sums, C.BASE), (sums2, C.BASE2))]
            yield pa.RecordBatch.from_arrays([pa.array(np.array(h1)[row]), pa.array(np.array(h2)[row]), pa.array(r), pa.array(a.astype(np.int32)), pa.array(b.astype(np.int32)), *map(pa.array, hashes), part.column("n_same").take(pa.array(row))], names=["h1", "h2", "r", "a", "b", "c1", "c2", "w1", "w2", "n_same"])

    return run


def _heavy(occ: DataFrame, length: int, gram: int) -> DataFrame:
    """g1, g2, ranges of the repeated windows of the segments of heavy anchors."""
    segs = C.cut(occ.where("heavy and bytes is not null").groupBy("h1", "h2").agg(F.count("*").alias("n_same"), F.first("fp").alias("fp"), F.first("n").alias("n"), F.first("off").alias("off"), F.first("bytes").alias("bytes")), "suffix-heavy")
    todo, before, found = segs.withColumn("left", F.lit(None).cast("array<long>")), None, []
    for bits in (b for b in STEPS if (1 << b) <= length - gram):  # a range's windows share some bytes
        cores = C.cut(todo.select("h1", "h2", "n", "off", "left", "bytes", "n_same").mapInArrow(_cores(length, bits, before), "h1 long, h2 long, r long, a int, b int, c1 long, c2 long, w1 long, w2 long, n_same long"), "suffix-cores")
        # all windows of a range occur again if its bytes do; one such range stays, for others to be compared with
        item = F.struct("h1", "h2", "r", "c1", "c2")
        whole = C.cut(cores.groupBy(F.col("w1").alias("x1"), F.col("w2").alias("x2")).agg(F.sum("n_same").alias("times"), F.min(item).alias("one")).where("times > 1"), "suffix-whole")
        same = (F.col("w1") == F.col("x1")) & (F.col("w2") == F.col("x2"))
        found.append(C.cut(cores.join(whole, same, "left_semi").select(F.col("h1").alias("g1"), F.col("h2").alias("g2"), F.struct("a", "b").alias("range")), "suffix-found"))
        alone = C.cut(cores.join(whole, same, "left_anti").select("h1", "h2", "r", "c1", "c2"), "suffix-alone")
        stay = alone.withColumn("open", F.lit(1)).unionByName(whole.select("one.*").withColumn("open", F.lit(0)))
        met = stay.groupBy(F.col("c1").alias("d1"), F.col("c2").alias("d2"), F.col("r").alias("q")).agg(F.count("*").alias("times"), F.max("open").alias("open")).where("times > 1 and open = 1").drop("times", "open")
        kept = stay.join(met, (F.col("c1") == F.col("d1")) & (F.col("c2") == F.col("d2")) & (F.col("r") == F.col("q")), "left_semi")
        kept = C.cut(kept.groupBy(F.col("h1").alias("g1"), F.col("h2").alias("g2")).agg(F.collect_set("r").alias("left")), "suffix-left")
        if kept.isEmpty():
            break
        todo, before = segs.join(kept, (F.col("h1") == F.col("g1")) & (F.col("h2") == F.col("g2"))), bits
    out = found[0]
    for x in found[1:]:
        out = out.unionByName(x)
    return out.groupBy("g1", "g2").agg(F.collect_list("range").alias("ranges"))


def spans(docs: DataFrame, length: int = LENGTH, gram: int = GRAM, block: int = BLOCK, heavy: int = HEAVY) -> DataFrame:
    """doc_id, key, spans: for each row that loses bytes, the [a, b) of its windows that occur again, not yet united."""
    keyed = _keyed(docs)

    def find(batches):
        for part, data, at in C.blocks(batches):
            doc, lo, n, off, fp = runs(data, at, length, gram)
            take = pa.array(doc)
            yield pa.RecordBatch.from_arrays([pa.array(fp), part.column("doc_id").take(take), part.column("key").take(take), pa.array(lo.astype(np.int32)), pa.array(n.astype(np.int32)), pa.array(off.astype(np.int32))], names=["fp", "doc_id", "key", "lo", "n", "off"])

    found = C.cut(keyed.mapInArrow(find, "fp long, doc_id long, key long, lo int, n int, off int"), "suffix-runs")
    often = C.cut(found.groupBy(F.col("fp").alias("f")).agg(F.count("*").alias("times")).where("times > 1"), "suffix-anchors")
    few = often.limit(C.BROADCAST_IDS + 1).count() <= C.BROADCAST_IDS
    again = found.join(F.broadcast(often) if few else often, F.col("fp") == F.col("f"))
    by_doc = C.cut(again.groupBy(F.col("doc_id").alias("d"), F.col("key").alias("k")).agg(F.collect_list(F.struct("fp", "lo", "n", "off", (F.col("times") > heavy).alias("heavy"))).alias("runs")), "suffix-by-doc")
    C.drop_cut(found)
    some = C.only(keyed, "key", by_doc.select(F.col("k").alias("kk")).distinct(), "kk")
    texts = some.join(by_doc, F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("key") == F.col("k"))).select("doc_id", "key", "text", "runs")
    occ = C.cut(texts.mapInArrow(_segments(length), "fp long, h1 long, h2 long, doc_id long, key long, lo int, n int, off int, heavy boolean, bytes binary"), "suffix-segments")
    light = occ.where("not heavy and bytes is not null").select("fp", "h1", "h2", "off", "bytes").repartition("fp").sortWithinPartitions("fp").mapInArrow(_index(length, block), "g1 long, g2 long, ranges array<struct<a:int,b:int>>")
    hot = _heavy(occ, length, gram) if not often.where(F.col("times") > heavy).isEmpty() else None
    got = light.unionByName(hot) if hot is not None else light
    back = occ.select("h1", "h2", "doc_id", "key", "lo").join(got, (F.col("h1") == F.col("g1")) & (F.col("h2") == F.col("g2")))
    each = F.transform("ranges", lambda r: F.struct((r["a"] + F.col("lo")).alias("a"), (r["b"] + F.col("lo") + length - 1).alias("b")))
    return back.select("doc_id", "key", each.alias("spans")).groupBy("doc_id", "key").agg(F.flatten(F.collect_list("spans")).alias("spans"))


def _united(spans: list[dict] | None) -> list[tuple[int, int]]:
    out: list[list[int]] = []
    for a, b in sorted((s["a"], s["b"]) for s in spans or ()):
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return [tuple(x) for x in out]


def _cut_out(text: bytes, spans: list[tuple[int, int]]) -> bytes:
    out, at = [], 0
    for a, b in spans:
        out.append(text[at:a])
        at = b
    return b"".join([*out, text[at:]])


def _with_spans(docs: DataFrame, **options) -> DataFrame:
    keyed = _keyed(docs)
    s = spans(docs, **options).select(F.col("doc_id").alias("d"), F.col("key").alias("k"), "spans")
    return keyed.join(s, F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("key") == F.col("k")), "left").select("doc_id", "text", "spans")


def decide(docs: DataFrame, **options) -> DataFrame:
    """doc_id, n_removed, n_spans, n_bytes, kept_sha256, repeats (whether anything is removed) for every row of docs(doc_id, text)."""

    def run(batches):
        for part, data, at in C.blocks(batches):
            n_removed, n_spans, shas = [], [], []
            for i, s in enumerate(part.column("spans").to_pylist()):
                u = _united(s)
                n_removed.append(sum(b - a for a, b in u))
                n_spans.append(len(u))
                shas.append(hashlib.sha256(_cut_out(data[at[i] : at[i + 1]].tobytes(), u)).hexdigest())
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(n_removed, pa.int64()), pa.array(n_spans, pa.int64()), pa.array(np.diff(at)), pa.array(shas), pa.array([x > 0 for x in n_removed], pa.bool_())], names=["doc_id", "n_removed", "n_spans", "n_bytes", "kept_sha256", "repeats"])

    return _with_spans(docs, **options).mapInArrow(run, "doc_id long, n_removed long, n_spans long, n_bytes long, kept_sha256 string, repeats boolean")


def remove(docs: DataFrame, **options) -> DataFrame:
    """doc_id and the text that is left, as bytes (a cut may fall inside a character)."""

    def run(batches):
        for part, data, at in C.blocks(batches):
            left = [_cut_out(data[at[i] : at[i + 1]].tobytes(), _united(s)) for i, s in enumerate(part.column("spans").to_pylist())]
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(left, pa.binary())], names=["doc_id", "text"])

    return _with_spans(docs, **options).mapInArrow(run, "doc_id long, text binary")
