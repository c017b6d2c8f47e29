"""Benchmark decontamination with DataFrame functions only: SimHash of item-sized windows, multi-index Hamming blocks, exact weighted-shingle similarity.

Words are what white space [\\x20\\x09-\\x0D] separates in the lower-cased text; a shingle is n words (fewer words: all
of them). A shingle weighs as much as it has distinct words, so runs of one word count little. A document leaks an item
if one of its windows of as many words as the item has has a weighted Jaccard similarity of `percent` with it.

1. Shingles of documents that occur in the benchmark (a join that moves no text) give the windows to look at: every
   window that holds so many places of the item's shingles that they could weigh `percent` of the item, in whatever
   order they come. An item of fewer than n words is one shingle, and is looked for at its own length.
2. Each of these windows gets a 64-bit SimHash of its weighted shingles: 64 sums, which slide. Where a shingle comes into
   the windows or leaves them its weight is added or taken off, so a document's windows cost as much as its words do, and
   no row holds more than a number of them.
3. Multi-index Hamming: 8 blocks of 8 bits. Two fingerprints within RADIUS = 8 * 3 - 1 = 23 bits have a block that
   differs in 2 bits at most, so an index of the items' blocks with all such differences finds each of them.
4. Exact weighted similarity decides, by sums that slide in the same way.

The benchmark's tables of fixed width are broadcast only after their rows are counted. Windows are worked on in groups of
as many starts as the item has shingles, so a document of any length is many groups, and no pair of documents is ever made.

Defined cases: null or empty texts leak nothing; an item without words is leaked by nothing. Rows that repeat a doc_id
are judged one by one, and its leaks united. Rows that repeat an item_id are items of their own, united in the result.
An empty table gives an empty result. Extra columns are ignored by leaks(), and kept by clean().
"""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .common import cut, fresh, only

N, PERCENT = 5, 80
BLOCKS, BITS, NEAR = 8, 8, 2
RADIUS = BLOCKS * (NEAR + 1) - 1
#: Rows of benchmark tables up to which they are broadcast.
FEW = 1_000_000


def word_array(text: Column) -> Column:
    return F.split(F.btrim(F.lower(F.coalesce(text, F.lit(""))), F.lit(" \t\n\x0b\x0c\r")), r"[\x20\x09-\x0D]+")


def _bound(value: Column, use) -> Column:
    """use(value), with value computed once."""
    return F.element_at(F.transform(F.array(value), use), 1)


def shingle_array(words: Column, n: int) -> Column:
    """Hashes of the shingles of an array of words, in order."""

    def each(ws: Column) -> Column:
        h = F.transform(ws, lambda w, i: F.xxhash64(w, *[F.get(ws, i + k) for k in range(1, n)]))
        return F.slice(h, 1, F.greatest(F.size(ws) - (n - 1), F.lit(1)))

    return _bound(words, each)


def weighted_places(words: Column, n: int) -> Column:
    """The shingles of an array of words, in order: hashes whose lowest three bits are the weight."""

    def each(ws: Column) -> Column:
        h = F.transform(ws, lambda w, i: F.xxhash64(w, *[F.get(ws, i + k) for k in range(1, n)]).bitwiseAND(F.lit(-8)) + F.size(F.array_distinct(F.slice(ws, i + 1, F.lit(n)))))
        return F.slice(h, 1, F.greatest(F.size(ws) - (n - 1), F.lit(1)))

    return _bound(words, each)


def _spans(words: Column, m: int) -> Column:
    """Hashes of the runs of m words of an array of words, in order; fewer words have none."""
    return _bound(words, lambda ws: F.slice(F.transform(ws, lambda w, i: F.xxhash64(w, *[F.get(ws, i + k) for k in range(1, m)])), 1, F.greatest(F.size(ws) - (m - 1), F.lit(0))))


def _starts() -> Column:
    """Of the n_places starts of group g: those whose n_places places hold at least `need` of the sorted places ps."""
    first = F.col("g") * F.col("n_places")

    def each(i: Column) -> Column:  # windows whose first place is ps[i]
        low = F.greatest(first, F.get("ps", i + F.col("need") - 1) - F.col("n_places") + 1, F.get("ps", i - 1) + 1)
        high = F.least(first + F.col("n_places") - 1, F.get("ps", i))
        return F.when(low <= high, F.sequence(low, high)).otherwise(F.array().cast("array<int>"))

    return F.flatten(F.transform(F.sequence(F.lit(0), F.size("ps") - F.col("need")), each))


def weight_of(shingles: Column) -> Column:
    return F.aggregate(shingles, F.lit(0), lambda a, x: a + x.bitwiseAND(F.lit(7)).cast("int"))


#: A fingerprint's 64 sums, as two counters of 32 bits in each of 32 longs.
_PACKS = 32


def _packs(shingle: Column, weight: Column) -> list[Column]:
    """The weight in the counter of each bit of the shingle's hash; sums of these, negative weights among them, are sums by counter."""
    bit = lambda b: F.shiftrightunsigned(F.xxhash64(shingle), b).bitwiseAND(F.lit(1))
    return [(bit(2 * k) + F.shiftleft(bit(2 * k + 1), 32)) * weight for k in range(_PACKS)]


def _print(own: Column) -> Column:
    """The 64-bit SimHash of what the packs c0, c1 ... sum up, of the weight `own` in all."""
    on = lambda k, j: F.when(F.shiftrightunsigned(f"c{k}", 32 * j).bitwiseAND(F.lit(0xFFFFFFFF)) * 2 > own, F.shiftleft(F.lit(1).cast("long"), 2 * k + j)).otherwise(F.lit(0).cast("long"))
    parts = [on(k, j) for k in range(_PACKS) for j in range(2)]
    while len(parts) > 1:
        parts = [a.bitwiseOR(b) for a, b in zip(parts[::2], parts[1::2], strict=True)]
    return parts[0]


def simhash(df: DataFrame, keys: list[str], shingles: str) -> DataFrame:
    """keys, fp (the 64-bit SimHash) and own (the weight) of each row's distinct weighted shingles."""
    one = df.select(*keys, F.explode(shingles).alias("_x")).distinct()
    weight = F.col("_x").bitwiseAND(F.lit(7))
    sums = one.groupBy(*keys).agg(F.sum(weight).alias("own"), *[F.sum(c).alias(f"c{k}") for k, c in enumerate(_packs(F.col("_x"), weight))])
    return sums.select(*keys, _print(F.col("own")).alias("fp"), "own")


def slide(places: DataFrame, starts: DataFrame, keys: list[str], values) -> DataFrame:
    """Sums over the distinct shingles of windows, for the wanted starts(keys, s): keys, s and the columns of values(x, weight).

    places(keys, n_places, g, p, x) has the shingles of group g: those that its starts g * n_places to (g + 1) * n_places - 1
    can hold. A shingle is in the windows that begin after its last place before, and not n_places before its own: it is
    added where these begin and taken off behind them, and running sums give every window, in a time that grows with the
    places alone. A group has as many rows as an item has words, times four at most."""
    # dealt by group once, while rows are narrow; sums of many columns are never shuffled
    places, starts = places.repartition(*keys), starts.repartition(*keys)
    n, g, p = F.col("n_places"), F.col("g"), F.col("p")
    before = F.lag("p").over(W.partitionBy(*keys, "x").orderBy("p"))
    ends = places.select(*keys, "x", (F.greatest(p - n, g * n - 1, before) + 1).alias("low"), (F.least(p, (g + 1) * n - 1) + 1).alias("past")).where("low < past")
    events = ends.select(*keys, "x", F.explode(F.array(*[F.struct(F.col(c).alias("s"), F.lit(sign).alias("sign")) for c, sign in (("low", 1), ("past", -1))])).alias("e"))
    weight = F.col("x").bitwiseAND(F.lit(7)) * F.col("sign")
    named = values(F.col("x"), weight)
    sums = events.select(*keys, "x", "e.s", "e.sign").groupBy(*keys, "s").agg(F.lit(False).alias("wanted"), *[F.sum(c).alias(k) for k, c in named.items()])
    probes = starts.select(*keys, "s", F.lit(True).alias("wanted"), *[F.lit(0).cast("long").alias(k) for k in named])
    upto = W.partitionBy(*keys).orderBy("s", "wanted").rowsBetween(W.unboundedPreceding, W.currentRow)
    return sums.unionByName(probes).select(*keys, "s", "wanted", *[F.sum(k).over(upto).alias(k) for k in named]).where("wanted").drop("wanted")


def _block(fp: Column, k: int) -> Column:
    return F.shiftrightunsigned(fp, BITS * k).bitwiseAND(F.lit((1 << BITS) - 1)).cast("int")


def _masks() -> list[int]:
    return [sum(1 << b for b in some) for k in range(NEAR + 1) for some in combinations(range(BITS), k)]


def _small(df: DataFrame) -> DataFrame:
    """df, broadcast if it is small: its rows are counted first."""
    return F.broadcast(df) if df.limit(FEW + 1).count() <= FEW else df


def leaks(docs: DataFrame, benchmark: DataFrame, n: int = N, percent: int = PERCENT) -> DataFrame:
    """doc_id, item_id, similarity, at: the items that each document leaks, and the first word of the most similar window."""
    items = benchmark.select(F.xxhash64("item_id", "text").alias("item"), F.col("item_id").cast("long").alias("item_id"), word_array(F.col("text")).alias("words")).where("words[0] <> ''")
    items = cut(items.dropDuplicates(["item"]).select("item", "item_id", F.size("words").alias("n_words"), shingle_array(F.col("words"), n).alias("places"), F.array_distinct(weighted_places(F.col("words"), n)).alias("b")), "leak-items")
    long = items.where(F.col("n_words") >= n).withColumn("w_item", weight_of(F.col("b"))).withColumn("n_places", F.size("places"))
    index = _small(long.select("item", "n_words", "w_item", "n_places", F.explode(F.array_distinct("places")).alias("h")))
    keyed = docs.select(F.struct(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("doc_id", "text").alias("key")).alias("doc"), "text")
    words = word_array(F.col("text"))
    hits = keyed.select("doc", F.posexplode(shingle_array(words, n)).alias("p", "h2")).join(index, F.col("h2") == F.col("h"))
    by = ["doc", "item", "n_words", "n_places", "w_item"]
    # a group of n_places starts, with the places of the item's shingles that their windows can hold
    need = F.greatest(F.lit(1), F.ceil(F.col("w_item") * percent / (100 * n))).cast("int")
    own = F.floor(F.col("p") / F.col("n_places")).cast("int")
    near = hits.select(*by, "p", F.explode(F.array(own, own - 1)).alias("g")).where("g >= 0").groupBy(*by, "g").agg(F.array_sort(F.collect_set("p")).alias("ps"))
    near = cut(near.withColumn("need", need).where(F.size("ps") >= F.col("need")), "leak-hits")
    window = ["doc", "n_words", "g"]
    starts = near.select(*window, F.explode(_starts()).alias("s")).distinct()
    # the shingles of the documents in question, of these only what the groups' windows can hold; they stay where the texts are
    keys = near.select(F.col("doc.key").alias("of")).distinct()
    texts = only(keyed.withColumn("key", F.col("doc.key")), "key", keys, "of").dropDuplicates(["doc"])
    groups = near.select(*window, "n_places").distinct()
    begin = F.col("g") * F.col("n_places")
    inside = texts.select("doc", weighted_places(words, n).alias("xs")).join(groups, "doc").select(*window, "n_places", begin.alias("begin"), F.posexplode(F.slice("xs", begin + 1, F.col("n_places") * 2)).alias("k", "x"))
    held = cut(inside.select(*window, "n_places", (F.col("begin") + F.col("k")).alias("p"), "x"), "leak-places")
    sums = slide(held, starts, window, lambda x, w: {"own": w} | {f"c{k}": c for k, c in enumerate(_packs(x, w))})
    prints = cut(sums.select(*window, "s", "own", _print(F.col("own")).alias("fp")), "leak-prints")
    # Hamming neighbours: the items' blocks with all small differences, against the windows' blocks
    blocks = F.explode(F.array(*[F.struct(F.lit(k).alias("block"), _block(F.col("fp"), k).alias("value")) for k in range(BLOCKS)])).alias("x")
    item_prints = simhash(long, ["item", "item_id", "n_words"], "b").select("item", "item_id", "n_words", F.col("fp").alias("item_fp"), F.col("own").alias("w_item"), blocks)
    variants = item_prints.select("item", "item_id", "n_words", "item_fp", "w_item", F.col("x.block").alias("block"), F.explode(F.transform(F.array(*map(F.lit, _masks())), lambda mask: F.col("x.value").bitwiseXOR(mask))).alias("value"))
    met = prints.select(*window, "s", "own", "fp", blocks).select(*window, "s", "own", "fp", "x.*").join(_small(cut(variants, "leak-index")), ["n_words", "block", "value"])
    pairs = cut(met.where(F.bit_count(F.col("fp").bitwiseXOR(F.col("item_fp"))) <= RADIUS).select("doc", "item", "item_id", "g", "s", "own", "w_item").distinct(), "leak-pairs")
    # exact: the weight that window and item share, from the places of the item's shingles
    both = ["doc", "item", "g"]
    asked = near.select(*both, "n_words", F.explode("ps").alias("p")).join(pairs.select(*both).distinct(), both, "left_semi")
    shared = asked.join(held, [*window, "p"]).select(*both, "n_places", "p", "x")
    judged = slide(shared, pairs.select(*both, "s").distinct(), both, lambda x, w: {"shared": w}).join(pairs, [*both, "s"])
    union = F.col("own") + F.col("w_item") - F.col("shared")
    found = judged.where(F.col("shared") * 100 >= union * percent).select("doc.doc_id", "item_id", "s", (F.col("shared") / union).alias("similarity"))
    for m in sorted(r[0] for r in items.where(F.col("n_words") < n).select("n_words").distinct().collect()):
        # fewer words than n are one shingle, whose fingerprint is that of a window or isn't
        few = keyed.select("doc", F.posexplode(_spans(words, m)).alias("s", "h2"))
        short = _small(items.where(F.col("n_words") == m).select("item_id", F.col("places")[0].alias("h")))
        equal = few.join(short, F.col("h2") == F.col("h")).groupBy("doc.doc_id", "item_id").agg(F.min("s").alias("s"))
        found = found.unionByName(equal.withColumn("similarity", F.lit(1.0)))
    return found.groupBy("doc_id", "item_id").agg(F.max("similarity").alias("similarity"), F.max_by(F.col("s"), F.struct("similarity", -F.col("s"))).cast("long").alias("at"))


def clean(docs: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """The rows of docs that leak nothing, with all their columns."""
    (key,) = fresh(docs, "leaking_id")
    bad = cut(leaks(docs, benchmark, **options).select(F.col("doc_id").alias(key)).distinct(), "leak-docs")
    return docs.join(_small(bad), docs["doc_id"].eqNullSafe(F.col(key)), "left_anti")
