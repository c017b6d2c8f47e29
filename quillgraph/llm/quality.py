"""Quality classifier: a linear-chain conditional random field over the lines of a text.

Every line has features of its characters, words and repetition, and those of the lines before and after it. The chain
labels each line good or bad; forward-backward marginals, weighted by the lines' lengths, aggregate into the quality
of the document, which two numbers then calibrate. The field is trained here: lines take the label of their document,
on a bounded sample of labelled documents (SAMPLE, LINES and LONGEST, parameters), whose features alone come to the driver.
Scoring reads every whole text, however long, and is one pass without a shuffle.

Defined cases: null text is empty, and an empty text is one empty line. Labels that are null or conflict count by their
largest value, null not at all. Without labelled rows every score is 0.5. Rows that repeat a doc_id are scored one by
one, and of an id the text of fewest lines is learnt from. A null doc_id is not held out. An empty table gives an empty result. Extra columns are ignored by score(), and kept
by keep_good().
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from . import common as C

#: Labelled documents that the field is fitted on, at most, their lines in all, and the lines of each: a longer one isn't learnt from, whatever its place, and is scored like the others.
SAMPLE, LINES, LONGEST = 6000, 300_000, 10_000
_CLASS = np.zeros(256, np.uint8)  # 0 other, 1 lower, 2 upper, 3 digit, 4 sentence punctuation, 5 symbol, 6 white space, 7 beyond ASCII
_CLASS[33:127] = 5
_CLASS[97:123], _CLASS[65:91], _CLASS[48:58], _CLASS[128:] = 1, 2, 3, 7
_CLASS[[ord(c) for c in ".,;:?'\"-()"]] = 4
_CLASS[C.WHITE] = 6
OWN = 20


def lines(data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the lines of a block, and len(at) bounds by document; every document has a line."""
    cuts = np.flatnonzero(data == 10)
    doc = np.searchsorted(at, cuts, "right") - 1
    starts = np.concatenate([at[:-1], cuts + 1])
    owner = np.concatenate([np.arange(len(at) - 1), doc])
    order = np.lexsort((starts, owner))
    starts, owner = starts[order], owner[order]
    ends = np.concatenate([starts[1:] - 1, at[-1:]]) if len(starts) else starts
    last = np.r_[owner[1:] != owner[:-1], True] if len(owner) else np.zeros(0, bool)
    ends[last] = at[1:][owner[last]]
    return starts, ends, np.searchsorted(owner, np.arange(len(at)))


def line_features(data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Features of each line (its own and its neighbours'), the lines' lengths, and their bounds by document."""
    starts, ends, bounds = lines(data, at)
    n = ends - starts
    size = np.maximum(n, 1).astype(float)
    kind = _CLASS[data]
    total = lambda hit: np.concatenate([[0], np.cumsum(hit, dtype=np.int32)])
    per = lambda hit: (lambda s: (s[ends] - s[starts]) / size)(total(hit))
    x = np.zeros((len(n), OWN))
    x[:, 0] = np.log1p(n) / 8
    for k in range(1, 8):
        x[:, k] = per(kind == k)
    same = np.zeros(len(data), bool)
    same[1:] = (data[1:] == data[:-1]) & (kind[1:] != 6)
    x[:, 8] = per(same)
    x[:, 9] = 10 * per(data == 124)
    w0, w1, _ = C.words(data, at)
    first = np.searchsorted(w0, starts)
    count = np.searchsorted(w0, ends) - first
    x[:, 10] = (x[:, 0] > 0) * (1 - x[:, 6]) * size / np.maximum(count, 1) / 10
    h = C.span_hash(C.prefix_hash(data), w0, w1)
    line = np.repeat(np.arange(len(n)), count)
    order = np.lexsort((h, line))
    new = np.r_[True, (h[order][1:] != h[order][:-1]) | (line[order][1:] != line[order][:-1])] if len(h) else np.zeros(0, bool)
    x[:, 11] = np.bincount(line[order][new], minlength=len(n)) / np.maximum(count, 1)
    # lines that occur before in the same document
    owner = np.repeat(np.arange(len(at) - 1), np.diff(bounds))
    text = C.span_hash(C.prefix_hash(data), starts, ends)
    order = np.lexsort((text, owner))
    again = np.r_[False, (text[order][1:] == text[order][:-1]) & (owner[order][1:] == owner[order][:-1])] if len(n) else np.zeros(0, bool)
    x[order, 12] = again
    full = n > 0
    x[full, 13] = np.isin(data[ends[full] - 1], [46, 63, 33, 58])
    x[full, 14] = kind[starts[full]] == 2
    x[:, 15] = count == 0
    x[:, 16] = count < 4
    for k, (f, by) in enumerate(((5, 10), (2, 3), (8, 10))):
        x[:, 17 + k] = np.minimum(x[:, f] * by, 1)
    x[:, 10] = np.minimum(x[:, 10], 3)
    out = np.zeros((len(n), 1 + 3 * OWN))
    out[:, 0] = 1
    out[:, 1 : 1 + OWN] = x
    inner = np.ones(len(n), bool)
    inner[bounds[:-1]] = False
    out[1:, 1 + OWN : 1 + 2 * OWN] = x[:-1] * inner[1:, None]
    out[:-1, 1 + 2 * OWN :] = x[1:] * inner[1:, None]
    return out, n + 1.0, bounds


def marginals(e: np.ndarray, bounds: np.ndarray, t: np.ndarray, pairs: bool = False) -> tuple[np.ndarray, np.ndarray | None]:
    """P(good) of every line, by forward-backward on log-odds of all documents at once; e: the lines' own log-odds, t[a][b]: the score of b after a. With pairs, also the expected transitions."""
    n = np.diff(bounds)
    order = np.argsort(-n, kind="stable")
    head, n = bounds[:-1][order], n[order]
    steps = int(n[0]) if len(n) else 0
    f, b = e.astype(float).copy(), np.zeros(len(e))
    live = [int(np.searchsorted(-n, -k, "left")) for k in range(steps)]  # documents with more than k lines
    for k in range(1, steps):
        at = head[: live[k]] + k
        r = f[at - 1]
        f[at] += np.logaddexp(r + t[1, 1], t[0, 1]) - np.logaddexp(r + t[1, 0], t[0, 0])
    for k in range(steps - 1, 0, -1):
        at = head[: live[k]] + k
        r = e[at] + b[at]
        b[at - 1] = np.logaddexp(r + t[1, 1], t[1, 0]) - np.logaddexp(r + t[0, 1], t[0, 0])
    p = 1 / (1 + np.exp(-np.clip(f + b, -500, 500)))
    if not pairs:
        return p, None
    later = np.ones(len(e), bool)
    later[bounds[:-1]] = False
    at = np.flatnonzero(later)
    r, s = f[at - 1], e[at] + b[at]
    logs = np.stack([np.full(len(at), t[0, 0]), t[0, 1] + s, t[1, 0] + r, t[1, 1] + r + s])
    logs -= logs.max(axis=0) if len(at) else 0
    xi = np.exp(logs)
    return p, (xi / xi.sum(axis=0)).sum(axis=1).reshape(2, 2) if len(at) else np.zeros((2, 2))


def fit(x: np.ndarray, bounds: np.ndarray, size: np.ndarray, y: np.ndarray, rounds: int = 60) -> tuple[np.ndarray, np.ndarray, tuple[float, float]]:
    """Weights, transitions and calibration: logistic regression of the lines, then gradient steps on the chain's likelihood."""
    doc = np.repeat(np.arange(len(y)), np.diff(bounds))
    target = y[doc].astype(float)
    w, t = np.zeros(x.shape[1]), np.zeros((2, 2))
    for _ in range(12):  # Newton steps
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        g = x.T @ (target - p) - 1e-1 * w
        h = (x * (p * (1 - p))[:, None]).T @ x + 1e-1 * np.eye(len(w)) + 1e-6 * np.eye(len(w))
        w += np.linalg.solve(h, g)
    w /= 2  # the chain adds up what its lines say
    later = np.ones(len(x), bool)
    later[bounds[:-1]] = False
    seen = np.zeros((2, 2))
    np.add.at(seen, (target[later].astype(int), target[later].astype(int)), 1)
    theta, m, v = np.r_[w, t.ravel()], 0.0, 0.0
    for i in range(1, rounds + 1):
        w, t = theta[:-4], theta[-4:].reshape(2, 2)
        p, pair = marginals(x @ w, bounds, t, True)
        g = np.r_[x.T @ (target - p) - 0.1 * w, (seen - pair).ravel() - 0.5 * theta[-4:]] / len(x)
        m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g
        theta = theta + 0.05 * (m / (1 - 0.9**i)) / (np.sqrt(v / (1 - 0.99**i)) + 1e-8)
    w, t = theta[:-4], theta[-4:].reshape(2, 2)
    z = _logit(document_quality(x @ w, size, bounds, t))
    a, b = 1.0, 0.0
    for _ in range(25):
        p = 1 / (1 + np.exp(-(a * z + b)))
        q = p * (1 - p)
        g = np.array([((y - p) * z).sum() - 0.01 * (a - 1), (y - p).sum()])
        h = np.array([[(q * z * z).sum() + 0.01, (q * z).sum()], [(q * z).sum(), q.sum() + 1e-6]])
        step = np.linalg.solve(h, g)
        a, b = a + np.clip(step[0], -1, 1), b + np.clip(step[1], -1, 1)
    return w, t, (float(a), float(b))


def _logit(p: np.ndarray) -> np.ndarray:
    p = np.clip(p, 1e-6, 1 - 1e-6)
    return np.log(p / (1 - p))


def document_quality(e: np.ndarray, size: np.ndarray, bounds: np.ndarray, t: np.ndarray) -> np.ndarray:
    """The mean of the lines' marginals, weighted by their lengths."""
    p, _ = marginals(e, bounds, t)
    return np.add.reduceat(p * size, bounds[:-1]) / np.add.reduceat(size, bounds[:-1]) if len(bounds) > 1 else np.zeros(0)


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, m: int = 3, r: int = 1, lines: int = LINES, longest: int = LONGEST):
    """The field fitted on `sample` labelled documents of `longest` lines each and `lines` lines in all at most, of those whose crc32 of the id isn't r modulo m; None without any."""
    C.small_batches(docs.sparkSession)
    known = labels.where("quality is not null and doc_id is not null").groupBy(F.col("doc_id").cast("long").alias("id")).agg(F.max("quality").alias("y")).where(C.crc_mod("id", m) != r)
    chosen = C.cut(C.bounded_sample(known, "id", sample), "quality-sample")

    def run(batches):
        for part, data, at in C.blocks(batches, limit=C.NARROW_BYTES):
            x, size, bounds = line_features(data, at)
            rows = [x[a:b].astype(np.float32).tobytes() for a, b in zip(bounds[:-1], bounds[1:], strict=True)]
            sizes = [size[a:b].astype(np.float32).tobytes() for a, b in zip(bounds[:-1], bounds[1:], strict=True)]
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("y"), pa.array(rows, pa.binary()), pa.array(sizes, pa.binary())], names=["doc_id", "y", "x", "size"])

    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text")).join(F.broadcast(chosen), F.col("doc_id") == F.col("id"))
    texts = texts.select("doc_id", F.col("y").cast("int").alias("y"), "text", F.struct((F.regexp_count("text", F.lit("\n")) + 1).alias("lines"), F.xxhash64("text").alias("tag")).alias("size"))
    # of an id the shortest text; sizes alone meet in one task, `sample` of them at most
    sizes = texts.groupBy(F.col("doc_id").alias("d")).agg(F.min("size").alias("least")).where(F.col("least.lines") <= longest)
    upto = F.sum("least.lines").over(W.orderBy(F.xxhash64("d"), "d"))
    fits = C.cut(sizes.withColumn("upto", upto).where(F.col("upto") <= lines).select("d", "least"), "quality-fits")
    texts = texts.join(F.broadcast(fits), (F.col("doc_id") == F.col("d")) & (F.col("size") == F.col("least"))).groupBy("doc_id", "y").agg(F.min("text").alias("text"))  # one row for each id
    got = texts.mapInArrow(run, "doc_id long, y int, x binary, size binary").toPandas().sort_values(["doc_id", "y", "x"], kind="stable")
    if not len(got):
        return None
    width = 1 + 3 * OWN
    parts = [np.frombuffer(x, np.float32).reshape(-1, width) for x in got["x"]]
    bounds = np.r_[0, np.cumsum([len(p) for p in parts])]
    size = np.frombuffer(b"".join(got["size"]), np.float32).astype(float)
    return fit(np.concatenate(parts).astype(float), bounds, size, (got["y"].to_numpy() > 0).astype(int))


def score(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, m: int = 3, r: int = 1) -> DataFrame:
    """doc_id, held_out, score, predicted for every row of docs(doc_id, text)."""
    model = train(docs, labels, sample, m, r)

    def run(batches):
        for part, data, at in C.blocks(batches, limit=C.NARROW_BYTES):
            ids = part.column("doc_id").to_pylist()
            if model is None:
                p = np.full(len(ids), 0.5)
            else:
                w, t, (a, b) = model
                x, size, bounds = line_features(data, at)
                p = 1 / (1 + np.exp(-(a * _logit(document_quality(x @ w, size, bounds, t)) + b)))
            held = [k is not None and zlib.crc32(str(k).encode()) % m == r for k in ids]
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(held), pa.array(p), pa.array((p >= 0.5).astype(np.int32))], names=["doc_id", "held_out", "score", "predicted"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, held_out boolean, score double, predicted int")


def keep_good(docs: DataFrame, labels: DataFrame, least: float = 0.5, **options) -> DataFrame:
    """The rows of docs that score least or more, with all their columns, in one pass: the texts aren't joined."""
    model = train(docs, labels, **options)
    schema = docs.schema
    text = "text"

    def run(batches):
        for part, data, at in C.blocks(batches, text, C.NARROW_BYTES):
            if model is None:
                yield part
                continue
            w, t, (a, b) = model
            x, size, bounds = line_features(data, at)
            p = 1 / (1 + np.exp(-(a * _logit(document_quality(x @ w, size, bounds, t)) + b)))
            yield part.filter(pa.array(p >= least))

    return docs.mapInArrow(run, schema)
