"""Phrase collocations: phrases of two to five words that come together more often than any cut of them explains, by language.

Each shard, a megabyte of a task's texts, gets a generalised suffix automaton over words, bounded in depth and built
level by level with numpy: the strings of d words are those of d - 1 words with the word after them, so sorting pairs of
numbers gives each its node and the number of its ends. A node's suffix link leads to its string without the first word;
where both have equally many ends they end at the same places and are one state. A task writes its states, as the longest
string, the lengths that share its ends, and their number; Spark spells the shorter strings out and sums by phrase.

A frequent phrase has frequent parts only, so passes over the texts go deeper only where that can be: the first counts
words and pairs, and the pairs that turn out frequent set bits in a filter of fixed size. The second one follows chains of
pairs whose bits are set. A filter that is too full lets chains through that the count then drops; it never loses one.

A phrase inside a longer one that is as frequent goes: chains of links from the longer to the shorter hold phrases at least
as frequent as the longer, so it is enough to follow one link of each phrase, by its first word and by its last.

Words of a shard are told apart by hashes of 62 bits, phrases by their text.

Defined cases: a null or empty text has no words. A null language is `und`. Rows that repeat a doc_id are texts of their
own, and ids, null or not, don't matter. Ties between cuts go to the shortest first part, between phrases as the order
says. An empty table gives an empty result. Extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from . import common as C

LONGEST, LEAST, PERCENT, TOP = 5, 100, 100, 2000
#: Bytes of text of a shard; a longer document is one of its own.
SHARD_BYTES = 1 << 20
#: Bits of the filter of frequent pairs: 8 MB, whatever the corpus.
FILTER_BITS = 1 << 26
#: Strings that a task spells out at once.
BATCH = 1 << 15
#: Languages up to which their numbers of words are broadcast, after counting them; beyond, the join shuffles.
FEW_LANGS = 100_000
#: Parts into which a language's phrases are dealt before the best of each meet.
PARTS = 64
_BREAK = np.zeros(256, bool)
_BREAK[[ord(c) for c in ".,;:!?"] + [10, 11, 12, 13]] = True
_APART = _BREAK.copy()
_APART[[32, 9]] = True


def _slots(lang: np.ndarray, first: np.ndarray, second: np.ndarray, bits: int) -> np.ndarray:
    """The two bits that the filter has for each pair of words of a language, by their hashes."""
    h = C.mix(lang + C.mix(first) * np.uint64(3) + second)
    return np.stack([h % np.uint64(bits), (h >> np.uint64(32)) * np.uint64(0x9E3779B97F4A7C15) % np.uint64(bits)])


def _hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Hashes of the spans, which are in order, some of the bytes at a time: the sums take 32 times their room."""
    out, i = [np.zeros(0, np.uint64)], 0
    while i < len(starts):
        j = max(i + 1, int(np.searchsorted(ends, starts[i] + C.BLOCK_BYTES, "right")))
        first = starts[i]
        out.append(C.span_hash(C.prefix_hash(data[first : ends[j - 1]]), starts[i:j] - first, ends[i:j] - first))
        i = j
    return np.concatenate(out)


def _lang_hashes(langs: list[str]) -> np.ndarray:
    at = np.cumsum([0] + [len(x.encode()) for x in langs])
    return _hashes(np.frombuffer("".join(langs).encode(), np.uint8), at[:-1], at[1:])


def _words(n: str) -> Column:
    """The first n words of a phrase; the last -n if n is negative."""
    return F.expr(f"substring_index(phrase, ' ', {n})")


class Automaton:
    """The strings of up to `depth` words of a shard's texts. levels[d - 1] has the node of d words from each place on (-1: the piece ends before), a place of each node, and the numbers of their ends."""

    def __init__(self, data: np.ndarray, at: np.ndarray, langs: list[str], depth: int, frequent: np.ndarray | None = None) -> None:
        data = C.LOWER[data]
        self.spaced = np.append(data, np.uint8(32))
        self.starts, self.ends, bounds = C.words(data, at, _APART)
        n = len(self.starts)
        names, of_text = np.unique(np.array(langs, object), return_inverse=True)
        self.names = [str(x) for x in names]
        self.lang = np.repeat(of_text, np.diff(bounds))
        hashes = _hashes(data, self.starts, self.ends)
        _, word = np.unique(hashes, return_inverse=True)
        # words of one piece: of one text, without a break between them
        breaks = np.concatenate([[0], np.cumsum(_BREAK[data])])
        piece = breaks[self.starts] + np.repeat(np.arange(len(at) - 1), np.diff(bounds)) if n else np.zeros(0, np.int64)
        together = np.zeros(n, bool)
        together[:-1] = piece[1:] == piece[:-1]
        self.levels = []
        key, alive = self.lang * np.int64(n + 1) + word, np.arange(n)
        for d in range(1, depth + 1):
            if d > 1:
                before, nodes = self.levels[-1][0], len(self.levels[-1][1])
                alive = alive[alive < n - 1]
                alive = alive[together[alive]]  # and from the next place on d - 1 words are in the piece
                alive = alive[before[alive + 1] >= 0]
                key = before[alive] * np.int64(nodes + 1) + before[alive + 1]
            _, place, node, ends = np.unique(key, return_index=True, return_inverse=True, return_counts=True)
            place = alive[place]
            if d == 2 and frequent is not None and len(place):
                slots = _slots(_lang_hashes(self.names)[self.lang[place]], hashes[place], hashes[place + 1], frequent.size * 64)
                may = ((frequent[slots >> np.uint64(6)] >> (slots & np.uint64(63))) & np.uint64(1)).all(0)
                number = np.cumsum(may) - 1
                alive, node = alive[may[node]], number[node[may[node]]]
                place, ends = place[may], ends[may]
            at_place = np.full(n, -1, np.int64)
            at_place[alive] = node
            self.levels.append((at_place, place, ends))

    def states(self, shortest: int) -> Iterator[pa.RecordBatch]:
        """lang, phrase, low, high, n: the longest string of each state, the numbers of words of its strings of `shortest` words or more, and of their ends."""
        lang, at, low, high, count = [], [], [], [], []
        below = None  # by node: the least number of words of its state, and whether a longer string has taken it in
        chain = []
        for d, (_, place, ends) in enumerate(self.levels, 1):
            least = np.full(len(place), d)
            if d > shortest and len(place):
                link = self.levels[d - 2][0][place + 1]
                same = ends == self.levels[d - 2][2][link]
                least[same] = below[link[same]]
                chain[-1][link[same]] = False
            below = least
            chain.append(np.ones(len(place), bool))
            lang.append(self.lang[place])
            at.append(place)
            low.append(least)
            high.append(np.full(len(place), d))
            count.append(ends)
        keep = np.concatenate([x if d >= shortest else np.zeros(len(x), bool) for d, x in enumerate(chain, 1)])
        lang, at, low, high, count = (np.concatenate(x)[keep] for x in (lang, at, low, high, count))
        names = np.array(self.names, object)
        for i in range(0, len(lang), BATCH):  # spelling the strings takes many times their room
            j = slice(i, i + BATCH)
            yield pa.RecordBatch.from_arrays([pa.array(names[lang[j]], pa.string()), self._phrases(at[j], high[j]), pa.array(low[j].astype(np.int32)), pa.array(high[j].astype(np.int32)), pa.array(count[j].astype(np.int64))], names=["lang", "phrase", "low", "high", "n"])

    def _phrases(self, at: np.ndarray, size: np.ndarray) -> pa.Array:
        """The text of `size` words from each of the places on, with one space between words."""
        upto = np.concatenate([[0], np.cumsum(size)])
        word = np.repeat(at - upto[:-1], size) + np.arange(upto[-1])
        text, bounds = C.gather(self.spaced, self.starts[word], self.ends[word] + 1)  # each with the byte after it
        text[bounds[1:] - 1] = 32
        first, last = bounds[upto[:-1]], bounds[upto[1:]] - 1
        whole, offsets = C.gather(text, first, last)
        return C.binary_array(whole, offsets, pa.string())


def counts(texts: DataFrame, depth: int, shortest: int = 1, frequent=None, shard: int = SHARD_BYTES) -> DataFrame:
    """lang, phrase, k, n: how often each phrase of k words, shortest to depth, is in texts(lang, text). k = 0: all words of a language, with an empty phrase. frequent: a broadcast filter of pairs."""

    def run(batches):
        rows, held = [], 0

        def shards():
            nonlocal rows, held
            for batch in batches:
                for part, data, at in C.blocks([batch], limit=shard):
                    if held and held + len(data) > shard:
                        yield rows
                        rows, held = [], 0
                    rows.append((part.column("lang").to_pylist(), data, at))
                    held += len(data)
            if rows:
                yield rows

        for some in shards():
            data = np.concatenate([x[1] for x in some])
            at = np.concatenate([[0], np.cumsum(np.concatenate([np.diff(x[2]) for x in some]))]).astype(np.int64)
            a = Automaton(data, at, [y for x in some for y in x[0]], depth, None if frequent is None else frequent.value)
            yield from a.states(shortest)
            if shortest == 1:
                total = np.bincount(a.lang, minlength=len(a.names))
                zero = pa.array(np.zeros(len(total), np.int32))
                yield pa.RecordBatch.from_arrays([pa.array(a.names, pa.string()), pa.array([""] * len(total), pa.string()), zero, zero, pa.array(total.astype(np.int64))], names=["lang", "phrase", "low", "high", "n"])

    named = texts.select(F.coalesce("lang", F.lit("und")).alias("lang"), "text")
    states = named.mapInArrow(run, "lang string, phrase string, low int, high int, n long")
    k = F.explode(F.sequence("low", "high"))
    each = states.select("lang", "phrase", "high", "n", k.alias("k"))
    ending = F.when(F.col("k") == F.col("high"), F.col("phrase")).otherwise(_words("-k"))
    return each.select("lang", ending.alias("phrase"), "k", "n").groupBy("lang", "phrase", "k").agg(F.sum("n").alias("n"))


def pair_filter(pairs: DataFrame, bits: int = FILTER_BITS) -> np.ndarray:
    """A bit map in which two bits are set for each of pairs(lang, phrase)."""

    def run(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            raw, at = C.text_buffers(batch.column(1))
            data, at = raw[at[0] : at[-1]], at - at[0]
            starts, ends, bounds = C.words(data, at, _APART)
            h = _hashes(data, starts, ends)
            names, of = np.unique(np.array(batch.column(0).to_pylist(), object), return_inverse=True)
            slots = _slots(_lang_hashes([str(x) for x in names])[of], h[bounds[:-1]], h[bounds[:-1] + 1], bits).ravel()
            word, bit = slots >> np.uint64(6), np.uint64(1) << (slots & np.uint64(63))
            yield pa.RecordBatch.from_arrays([pa.array(word.astype(np.int32)), pa.array(bit.view(np.int64))], names=["word", "bits"])

    words = pairs.select("lang", "phrase").mapInArrow(run, "word int, bits long").groupBy("word").agg(F.bit_or("bits").alias("bits")).toArrow()  # bits / 64 rows at most
    out = np.zeros(bits // 64, np.uint64)
    out[words.column("word").to_numpy()] = words.column("bits").to_numpy().view(np.uint64)
    return out


def collocations(docs: DataFrame, longest: int = LONGEST, least: int = LEAST, percent: int = PERCENT, top: int = TOP, bits: int = FILTER_BITS, shard: int = SHARD_BYTES) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score: of each language's phrases the `top` whose worst cut, into parts found l and r times, explains least of how often (a) they are found.

    score is 1000 * a * n / (l * r), rounded down; n: words of the language. Phrases found fewer than `least` times don't
    count, nor those inside a longer one that is found `percent` of 100 times as often or more."""
    spark = docs.sparkSession
    known = C.cut(counts(docs, 2, shard=shard).where((F.col("n") >= least) | (F.col("k") == 0)), "phrase-pairs")
    if longest > 2:
        frequent = spark.sparkContext.broadcast(pair_filter(known.where("k = 2"), bits))  # of a fixed size
        known = known.unionByName(C.cut(counts(docs, longest, 3, frequent, shard).where(F.col("n") >= least), "phrase-long"))
    words = known.where("k = 0").select(F.col("lang").alias("of"), F.col("n").alias("words"))
    if words.limit(FEW_LANGS + 1).count() <= FEW_LANGS:
        words = F.broadcast(words)
    found = known.where("k > 1")
    head, tail = _words("k - 1"), _words("1 - k")
    inner = found.where("k > 2").select("lang", F.explode(F.array(head, tail)).alias("phrase"), "n").groupBy("lang", "phrase").agg(F.max("n").alias("m"))
    inner = inner.select(F.col("lang").alias("in"), F.col("phrase").alias("shorter"), "m")
    alone = found.join(inner, (F.col("lang") == F.col("in")) & (F.col("phrase") == F.col("shorter")) & (F.col("m") * 100 >= F.col("n") * percent), "left_anti")
    cuts = alone.select("lang", "phrase", "k", F.col("n").alias("a"), F.explode(F.sequence(F.lit(1), F.col("k") - 1)).alias("at"))
    cuts = cuts.withColumn("first", _words("at")).withColumn("rest", _words("at - k"))
    part = known.where(f"k between 1 and {longest - 1}")
    side = lambda lang, phrase, n: part.select(F.col("lang").alias(lang), F.col("phrase").alias(phrase), F.col("n").alias(n))
    cuts = cuts.join(side("l1", "p1", "l"), (F.col("lang") == F.col("l1")) & (F.col("first") == F.col("p1"))).join(side("l2", "p2", "r"), (F.col("lang") == F.col("l2")) & (F.col("rest") == F.col("p2")))
    cuts = cuts.join(words, F.col("lang") == F.col("of"))
    score = F.expr("(cast(a as decimal(38,0)) * cast(1000 * words as decimal(38,0))) div (cast(l as decimal(38,0)) * cast(r as decimal(38,0)))")
    best = cuts.withColumn("score", score).groupBy("lang", "phrase").agg(F.min(F.struct("score", "at", "l", "r", "a", "words")).alias("x"))
    best = best.select("lang", "phrase", "x.a", "x.l", "x.r", F.col("x.words").alias("n"), "x.score")
    order = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    # the best of each part first, so that no task sorts all phrases of a language
    part = F.pmod(F.xxhash64("phrase"), F.lit(PARTS))
    some = best.withColumn("part", part).withColumn("place", F.row_number().over(W.partitionBy("lang", "part").orderBy(*order))).where(F.col("place") <= top)
    rank = F.row_number().over(W.partitionBy("lang").orderBy(*order)).cast("long")
    return some.withColumn("rank", rank).where(F.col("rank") <= top).select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
