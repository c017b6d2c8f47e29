"""Language-model scores: marginal likelihood of a text over all segmentations into the pieces of an existing vocabulary.

The vocabulary and its scores come from a tokenizer file (its path is a parameter; the file is read, never trained or
copied). Its scores, which order the pieces, give the starting weights 1 / (1 + rank); rounds of expectation
maximisation over the distinct words of all training documents then turn them into unigram probabilities. A word, with
the mark of its start, has the probability of all ways to put it together from pieces, by a forward recursion in log
space; every byte is a piece, so every text has a probability. One more arc spans each whole word that training saw: it
has the word's discounted count, (c - d) / N, and the lattice of pieces has the mass d * V / N that this leaves, d being
n1 / (n1 + 2 n2) for n1 words seen once and n2 seen twice. Pieces and arcs don't cross words, so a text's
log-probability is the sum over its words and one end token, which has its own count.

As Spark jobs: a pass over the texts gives, for each block of documents, one row for each distinct word in it (its number
in the block and its count in training documents) and one row that holds which document has which word how often. The
word rows meet by word, where counts over the whole corpus are summed, and each distinct word gets its lattice
probability; both go back to the blocks, packed, where they are summed by document. So a frequent word is one row for
each block, not one for each document, and no vocabulary is broadcast or gathered: only sums by piece come to the
driver, bounded by the vocabulary file.

Defined cases: null text is empty; an empty text is its end token. A null doc_id counts as not held out. Rows that
repeat a doc_id are scored and counted each. An empty table gives an empty result; without training documents, N and V
are 0 and the vocabulary's own weights are used. Extra columns are ignored.
"""

from __future__ import annotations

import math
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from . import common as C

#: Bytes of text in a block of documents.
BLOCK = 4 << 20
#: Word rows that a task packs by block at once.
PACK = 200_000
_NULL = -1 << 63
ROUNDS = 2
#: Gain in nats a word under which a round is the last.
SETTLED = 0.02
#: Expected count that every piece has before the corpus is seen.
PRIOR = 0.1


def vocabulary(path: str | None = None) -> tuple[list[bytes], np.ndarray]:
    """Pieces as bytes (a leading space marks a word's start; all 256 bytes are among them) and their starting log-weights."""
    import sentencepiece

    if path is None:
        import public_tokenizers

        path = public_tokenizers.path("piece_bpe_32k.model")
    sp = sentencepiece.SentencePieceProcessor(model_file=path)
    weight: dict[bytes, float] = {}
    for i in range(sp.get_piece_size()):
        if sp.is_control(i) or sp.is_unknown(i):
            continue
        piece = sp.id_to_piece(i)
        b = bytes([int(piece[3:5], 16)]) if sp.is_byte(i) else piece.replace("▁", " ").encode()
        if b and b" " not in b[1:] and b == C.LOWER[np.frombuffer(b, np.uint8)].tobytes():
            weight[b] = weight.get(b, 0.0) + 1.0 / (1.0 + abs(sp.get_score(i)) + (sp.get_piece_size() if sp.is_byte(i) else 0))
    for k in range(256):
        weight.setdefault(bytes([k]), 1.0 / (2 * sp.get_piece_size()))
    pieces = sorted(weight)
    w = np.array([weight[p] for p in pieces])
    return pieces, np.log(w / w.sum())


class Lattice:
    """All segmentations of words into pieces, for many words of one length at once."""

    def __init__(self, pieces: list[bytes], logp: np.ndarray) -> None:
        self.logp, self.by_len = logp, {}
        for n in sorted({len(p) for p in pieces}):
            ids = np.array([i for i, p in enumerate(pieces) if len(p) == n])
            flat = np.frombuffer(b"".join(pieces[i] for i in ids), np.uint8)
            at = np.arange(0, len(flat) + 1, n)
            h = C.span_hash(C.prefix_hash(flat), at[:-1], at[1:])
            order = np.argsort(h)
            self.by_len[n] = (h[order], ids[order])

    def edges(self, chars: np.ndarray) -> dict[int, np.ndarray]:
        """By piece length: the piece's id at each start of each word, -1 where none fits."""
        m, n = chars.shape
        sums = C.prefix_hash(np.ascontiguousarray(chars).reshape(-1))
        base = (np.arange(m) * n)[:, None]
        out = {}
        for k, (h, ids) in self.by_len.items():
            if k > n:
                break
            start = (base + np.arange(n - k + 1)[None, :]).reshape(-1)
            got = C.span_hash(sums, start, start + k)
            at = np.minimum(np.searchsorted(h, got), len(h) - 1)
            out[k] = np.where(h[at] == got, ids[at], -1).reshape(m, n - k + 1)
        return out

    def forward(self, chars: np.ndarray, edges: dict[int, np.ndarray]) -> np.ndarray:
        m, n = chars.shape
        alpha = np.full((m, n + 1), -np.inf)
        alpha[:, 0] = 0.0
        lp = {k: np.where(e >= 0, self.logp[e], -np.inf) for k, e in edges.items()}
        for j in range(1, n + 1):
            terms = np.stack([alpha[:, j - k] + lp[k][:, j - k] for k in lp if k <= j])
            top = terms.max(axis=0)
            alpha[:, j] = top + np.log(np.exp(terms - top).sum(axis=0))
        return alpha

    def expected(self, chars: np.ndarray, counts: np.ndarray, out: np.ndarray) -> float:
        """Adds to out how often each piece is expected in words that occur counts times; the words' log-probability, with their counts."""
        m, n = chars.shape
        edges = self.edges(chars)
        alpha = self.forward(chars, edges)
        beta = np.full((m, n + 1), -np.inf)
        beta[:, n] = 0.0
        lp = {k: np.where(e >= 0, self.logp[e], -np.inf) for k, e in edges.items()}
        for i in range(n - 1, -1, -1):
            terms = np.stack([beta[:, i + k] + lp[k][:, i] for k in lp if i + k <= n])
            top = terms.max(axis=0)
            beta[:, i] = top + np.log(np.exp(terms - top).sum(axis=0))
        for k, e in edges.items():
            has = e >= 0
            post = np.exp(alpha[:, : n - k + 1] + lp[k] + beta[:, k:] - alpha[:, n:]) * counts[:, None]
            out += np.bincount(e[has], weights=post[has], minlength=len(out))
        return float((alpha[:, n] * counts).sum())

    def groups(self, data: np.ndarray, at: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Rows of words of one length, and their characters after a start mark."""
        lens = np.diff(at)
        for n in np.unique(lens):
            rows = np.flatnonzero(lens == n)
            step = max(1, (1 << 15) // int(n + 1))
            for i in range(0, len(rows), step):
                r = rows[i : i + step]
                chars = np.full((len(r), n + 1), 32, np.uint8)
                chars[:, 1:] = data[at[r][:, None] + np.arange(n)[None, :]]
                yield r, chars


def _held(doc_id: int | None, m: int, r: int) -> bool:
    return doc_id is not None and zlib.crc32(str(doc_id).encode()) % m == r


def postings(docs: DataFrame, m: int, r: int) -> DataFrame:
    """block, word, number, n_train: the distinct words of each block, numbered, and their counts in training rows; One more row for each block, of a null word, has ids, docs, numbers and tf: the rows' doc_ids, and the pairs of a row and a word; its n_train are the training rows, as each has an end token."""

    def run(batches):
        for part, data, at in C.blocks(batches, limit=BLOCK):
            data = C.LOWER[data]
            starts, ends, bounds = C.words(data, at)
            ids = part.column("doc_id").to_pylist()
            k = len(ids)
            train = np.array([not _held(x, m, r) for x in ids])
            doc = np.repeat(np.arange(k), np.diff(bounds))
            h = C.span_hash(C.prefix_hash(data), starts, ends)
            order = np.lexsort((doc, h))
            h, doc = h[order], doc[order]
            new_word = np.r_[True, h[1:] != h[:-1]] if len(h) else np.zeros(0, bool)
            new = new_word | np.r_[True, doc[1:] != doc[:-1]] if len(h) else new_word
            first = np.flatnonzero(new)
            tf = np.diff(np.r_[first, len(h)])
            word_at = np.flatnonzero(new_word[first])  # where words begin among the (word, document) pairs
            pair_doc, number = doc[first], np.cumsum(new_word[first]) - 1
            one = order[first[word_at]]
            chars, chars_at = C.gather(data, starts[one], ends[one])
            n_train = np.add.reduceat(tf * train[pair_doc], word_at) if len(word_at) else np.zeros(0, np.int64)
            w = len(word_at)
            valid = np.ones(w + 1, bool)
            valid[-1] = False
            words = C.binary_array(chars, np.r_[chars_at, chars_at[-1]], pa.string())
            words = pa.Array.from_buffers(pa.string(), w + 1, [pa.py_buffer(np.packbits(valid, bitorder="little").tobytes()), *words.buffers()[1:]])
            only = lambda x: pa.array([None] * w + [x.tobytes()], pa.binary())
            block = pa.array(np.full(w + 1, uuid.uuid4().int >> 65, np.int64))
            yield pa.RecordBatch.from_arrays(
                [block, words, pa.array(np.arange(w + 1, dtype=np.int32)), pa.array(np.r_[n_train, train.sum()].astype(np.int64)), only(np.array([_NULL if x is None else x for x in ids], np.int64)), only(pair_doc.astype(np.uint32)), only(number.astype(np.uint32)), only(tf.astype(np.uint32))],
                names=["block", "word", "number", "n_train", "ids", "docs", "numbers", "tf"],
            )

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "block long, word string, number int, n_train long, ids binary, docs binary, numbers binary, tf binary")


def train(words: DataFrame, pieces: list[bytes], logp: np.ndarray, rounds: int, settled: float = SETTLED) -> np.ndarray:
    """Log-probabilities of the pieces after expectation maximisation over words(word, c) with c > 0, each as often as it occurs: until a round gains less than `settled` nats a word, and for `rounds` rounds at most."""
    seen, before = words.where("c > 0").select("word", "c"), None
    for _ in range(rounds):

        def run(batches, logp=logp):
            lattice, total, fit, n = Lattice(pieces, logp), np.zeros(len(pieces)), 0.0, 0
            for batch in batches:
                data, at = C.text_buffers(batch.column(0))
                c = batch.column(1).to_numpy().astype(float)
                for rows, chars in lattice.groups(data, at):
                    fit += lattice.expected(chars, c[rows], total)
                n += int(c.sum())
            some = np.flatnonzero(total)
            yield pa.RecordBatch.from_arrays([pa.array(np.r_[some, -1, -2]), pa.array(np.r_[total[some], fit, n])], names=["piece", "n"])

        sums = seen.mapInArrow(run, "piece long, n double").groupBy("piece").agg(F.sum("n").alias("n")).toPandas()  # a row for each piece
        found = sums[sums["piece"] >= 0]
        if not len(found):
            break
        n = np.full(len(pieces), PRIOR)
        n[found["piece"].to_numpy()] += found["n"].to_numpy()
        logp = np.log(n / n.sum())
        other = dict(zip(sums["piece"], sums["n"], strict=True))
        fit = other[-1] / other[-2]
        if before is not None and fit - before < settled:
            break
        before = fit
    return logp


def score(docs: DataFrame, path: str | None = None, m: int = 7, r: int = 2, rounds: int = ROUNDS, arcs: bool = True) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score for every row of docs(doc_id, text). Without arcs, words have the lattice of pieces alone."""
    post = C.cut(postings(docs, m, r), "lm-postings")
    by_word = W.partitionBy("word")
    met = post.where("word is not null").select("word", "block", "number", F.sum("n_train").over(by_word).alias("c"), (F.col("block") == F.min("block").over(by_word)).alias("first"))
    met = C.cut(met, "lm-words")
    words = met.where("first").select("word", "c")
    count = lambda when, name: F.count(F.when(F.expr(when), 1)).alias(name)
    total = words.agg(F.coalesce(F.sum("c"), F.lit(0)).alias("n"), count("c > 0", "v"), count("c = 1", "n1"), count("c = 2", "n2")).first()
    ends = post.where("word is null").agg(F.coalesce(F.sum("n_train"), F.lit(0))).first()[0]  # of the end token, a word of its own
    n, v = total["n"] + ends, total["v"] + (ends > 0)
    discount = min(0.99, max(0.01, total["n1"] / (total["n1"] + 2 * total["n2"]))) if total["n1"] else 0.5
    pieces, logp = vocabulary(path)
    logp = train(words, pieces, logp, rounds)

    def rate(batches):
        """Rows sorted by word; gives packed (number, c, log10 probability) by block."""
        lattice = Lattice(pieces, logp)
        waiting: list[tuple[np.ndarray, ...]] = []
        rows = 0

        def packed():
            block, number, c, lp = (np.concatenate(x) for x in zip(*waiting, strict=True))
            order = np.argsort(block, kind="stable")
            block, number, c, lp = block[order], number[order], c[order], lp[order]
            begin = np.flatnonzero(np.r_[True, block[1:] != block[:-1]])
            end = np.r_[begin[1:], len(block)]
            waiting.clear()
            col = lambda x: pa.array([x[i:j].tobytes() for i, j in zip(begin, end, strict=True)], pa.binary())
            return pa.RecordBatch.from_arrays([pa.array(block[begin]), col(number.astype(np.uint32)), col(c.astype(np.int64)), col(lp.astype(np.float32))], names=["block", "ids", "numbers", "tf"])

        for batch in batches:
            if not batch.num_rows:
                continue
            data, at = C.text_buffers(batch.column(0))
            c = batch.column(3).to_numpy()
            h = C.span_hash(C.prefix_hash(data[at[0] : at[-1]]), at[:-1] - at[0], at[1:] - at[0])
            one = np.flatnonzero(np.r_[True, h[1:] != h[:-1]])  # the words, each once
            chars, chars_at = C.gather(data, at[one], at[one + 1])
            lp = np.zeros(len(one))
            for some, text in lattice.groups(chars, chars_at):
                lp[some] = lattice.forward(text, lattice.edges(text))[:, -1]
            if n and not arcs:
                lp += math.log1p(-ends / n)
            elif n:
                with np.errstate(divide="ignore"):
                    lp = np.logaddexp(np.log(np.maximum(c[one] - discount, 0) / n), math.log(discount * v / n) + lp)
            waiting.append((batch.column(1).to_numpy(), batch.column(2).to_numpy(), c, np.repeat(lp / math.log(10), np.diff(np.r_[one, len(c)]))))
            rows += batch.num_rows
            if rows >= PACK:
                yield packed()
                rows = 0
        if waiting:
            yield packed()

    rated = met.select("word", "block", "number", "c").mapInArrow(rate, "block long, ids binary, numbers binary, tf binary").select("block", "ids", F.lit(None).cast("binary").alias("docs"), "numbers", "tf")
    heads = post.where("word is null").select("block", "ids", "docs", "numbers", "tf")
    denominator = n + v + 1
    # the end token is none of the lattice's words, so it has its count, or a tenth as long as nothing was learnt
    end_log = math.log10(max(ends - discount, 0.5) / n) if ends else -1.0

    def add(batches):
        """Rows sorted by block, its documents first: one block is held at a time."""
        now, head, tables = None, None, []

        def made():
            own, doc, number, tf = head
            words = int(number.max()) + 1 if len(number) else 0
            counts, logs = np.zeros(words), np.zeros(words)
            for where, c, lp in tables:
                counts[where], logs[where] = c, lp
            k, f, at = len(own), tf.astype(float), counts[number]
            s = [np.bincount(doc, x, k) for x in (f, f * (at > 0), f * np.log10((at + 1) / denominator), f * logs[number])]
            held = [x != _NULL and _held(x, m, r) for x in own.tolist()]
            return pa.RecordBatch.from_arrays(
                [pa.array(own, mask=own == _NULL), pa.array(held), pa.array(np.rint(s[0]).astype(np.int64) + 1), pa.array(np.rint(s[1]).astype(np.int64) + (ends > 0)), pa.array(np.full(k, n, np.int64)), pa.array(s[2] + math.log10((ends + 1) / denominator)), pa.array(s[3] + end_log)],
                names=["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"],
            )

        for batch in batches:
            for block, ids, docs_, numbers, tf in zip(*(x.to_pylist() for x in batch.columns), strict=True):
                if block != now and head is not None:
                    yield made()
                if block != now:
                    now, head, tables = block, None, []
                if docs_ is None:
                    tables.append((np.frombuffer(ids, np.uint32), np.frombuffer(numbers, np.int64), np.frombuffer(tf, np.float32)))
                else:
                    head = (np.frombuffer(ids, np.int64), np.frombuffer(docs_, np.uint32), np.frombuffer(numbers, np.uint32), np.frombuffer(tf, np.uint32))
        if head is not None:
            yield made()

    return rated.unionByName(heads).repartition("block").sortWithinPartitions("block", F.col("docs").isNull()).mapInArrow(add, "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double")
