"""Corpus operators against brute force on small tables, and their defined edge cases."""

import collections
import hashlib
import itertools
import math
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from quillgraph.llm import chat, decontaminate, exact_dedup, html_text, licenses, lm, minhash, mixing, quality, suffix_dedup
from quillgraph.llm.components import components

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
AZ = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def words(t):
    return re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate(AZ))


def corpus(seed=5, n=60):
    """Random texts with exact and near copies, odd texts, nulls, and a repeated row."""
    r = random.Random(seed)
    vocab = ["".join(r.choice("abcdeéß") for _ in range(r.randint(1, 7))) for _ in range(200)]
    texts = [" ".join(r.choice(vocab) for _ in range(r.randint(0, 80))) for _ in range(n)]
    passage = " ".join(r.choice(vocab) for _ in range(90))
    for i in range(0, n, 5):
        w = texts[(i + 7) % n].split()
        if w:
            w[r.randrange(len(w))] = "changed"
        texts[i] = " ".join(w)
    texts[3], texts[9], texts[11] = texts[2].upper(), texts[2], passage + " one"
    texts[12], texts[13] = "two " + passage, passage + passage
    texts += [None, "", " \n\t ", "x", "x", "One two three", "é" * 3000, "a b " * 900, "line\n\nline\n"]
    rows = [(i, t, "en", None if i % 9 == 0 else f"s{i % 4}", 0) for i, t in enumerate(texts)]
    return rows


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(corpus(), DOCS).repartition(3).cache()


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], DOCS)


def odd(spark):
    """Nulls, repeated rows and clashing names."""
    rows = [(None, None, 1, 2), (1, "a b c d e f", 1, 2), (1, "a b c d e f", 1, 2), (2, "", None, None)]
    return spark.createDataFrame(rows, "doc_id long, text string, key int, kept_id int")


def test_exact(spark, docs, none):
    groups = collections.defaultdict(list)
    for i, t, *_ in corpus():
        groups[(t or "").translate(AZ)].append(i)
    expected = {i: (max(g), len(g), i == max(g), hashlib.sha256(k.encode()).hexdigest()) for k, g in groups.items() for i in g}
    for budget in (1, 1 << 20):
        got = {r["doc_id"]: (r["keep_id"], r["group_size"], r["kept"], r["text_sha256"]) for r in exact_dedup.decide(docs, trie_bytes=budget).collect()}
        assert got == expected
    assert {r["doc_id"] for r in exact_dedup.dedup(docs, "smallest").collect()} == {min(g) for g in groups.values()}
    assert exact_dedup.decide(none).count() == 0
    left = exact_dedup.dedup(odd(spark))
    assert left.columns == ["doc_id", "text", "key", "kept_id"] and sorted(str(r["doc_id"]) for r in left.collect()) == ["1", "1", "2"]


def test_patricia():
    t = exact_dedup.Patricia()
    keys = [b"", b"a", b"ab", b"abc", b"b", b"abd", b"ab" * 50]
    nodes = [id(t.terminal(k)) for k in keys]
    assert len(set(nodes)) == len(keys) and nodes == [id(t.terminal(k)) for k in keys]


def near_classes(rows, n, percent=80):
    sets = {}
    for i, t, *_ in rows:
        w = words(t)
        sets[i] = {tuple(w[k : k + n]) for k in range(len(w) - n + 1)} if len(w) >= n else ({tuple(w)} if w else set())
    low = {i: i for i in sets}

    def find(x):
        while low[x] != x:
            x = low[x]
        return x

    for a in sets:
        for b in sets:
            if a < b and sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]):
                x, y = find(a), find(b)
                low[max(x, y)] = min(x, y)
    return {i: (len(sets[i]), find(i)) for i in sets}


@pytest.mark.parametrize("small", [64, 1])
def test_minhash(docs, small):
    expected = near_classes(corpus(), 4)
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in minhash.classify(docs, n=4, small=small, chunk=2).collect()}
    assert got == expected


def test_minhash_cases(spark, none):
    assert minhash.classify(none).count() == 0
    left = minhash.dedup(odd(spark))
    assert left.columns == ["doc_id", "text", "key", "kept_id"]
    assert sorted(str(r["doc_id"]) for r in left.collect()) == ["1", "1", "2", "None"]


def test_minhash_repeated_ids(spark):
    """Rows that share an id, or have none, and differ in text are documents of their own."""
    a, b = (" ".join(f"{c}{i}" for i in range(50)) for c in "ab")
    near = lambda t: t + " more"
    rows = [(1, a), (1, b), (2, near(a)), (3, near(b)), (None, near(b) + " still"), (None, "alone here with few words"), (1, a)]
    got = minhash.classify(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted((str(r["doc_id"]), str(r["component_id"]), r["kept"]) for r in got) == sorted([("1", "1", True)] * 3 + [("2", "1", False), ("3", "1", False), ("None", "1", False), ("None", "None", True)])


def test_long_texts(spark):
    """A text of a million words and its near copy, beside short ones, through the operators on texts."""
    long = " ".join(f"w{i * 7919 % 100003}" for i in range(300_000))
    rows = [(1, long), (2, long + " end"), (3, "short one"), (4, "x" * 3_000_000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert {r["doc_id"]: r["component_id"] for r in minhash.classify(docs).collect()} == {1: 1, 2: 1, 3: 3, 4: 4}
    assert {r["doc_id"]: r["group_size"] for r in exact_dedup.decide(docs).collect()} == {1: 1, 2: 1, 3: 1, 4: 1}
    assert {r["doc_id"]: r["n_tokens"] for r in lm.score(docs.where("doc_id < 4")).collect()} == {1: 300_001, 2: 300_002, 3: 3}
    item = " ".join(long.split()[1000:1040])
    bench = spark.createDataFrame([(9, item)], "item_id long, text string")
    assert {(r["doc_id"], r["at"]) for r in decontaminate.leaks(docs, bench).collect()} >= {(1, 1000), (2, 1000)}
    labels = spark.createDataFrame([(1, 1), (2, 1), (3, 0), (4, 0)], "doc_id long, quality int")
    assert quality.score(docs.unionByName(spark.createDataFrame([(5, "line\n" * 400_000)], "doc_id long, text string")), labels).count() == 5


def test_hash_of_thue_morse_words():
    """Words whose hashes would be equal modulo 2**64 under every base."""
    a = b"a"
    for _ in range(11):
        a += a.translate(bytes.maketrans(b"ab", b"ba"))
    data = np.frombuffer(a + a.translate(bytes.maketrans(b"ab", b"ba")) + a, np.uint8)
    at = np.arange(4) * len(a)
    h = licenses.C.span_hash(licenses.C.prefix_hash(data), at[:-1], at[1:])
    assert h[0] == h[2] != h[1]


def test_cluster_path_is_exact(spark):
    """Many texts around one passage: large open buckets, whose chunks are solved by matrices."""
    r = random.Random(1)
    core = [f"w{i}" for i in range(60)]
    rows = []
    for i in range(90):
        w = core + [f"o{i}x{k}" for k in range(r.choice([3, 9, 12, 14, 16]))]
        rows.append((i, " ".join(w), "en", "s", 0))
    got = {x["doc_id"]: (x["n_shingles"], x["component_id"]) for x in minhash.classify(spark.createDataFrame(rows, DOCS), n=4, small=4, chunk=16).collect()}
    assert got == near_classes(rows, 4)


def test_rarest_are_shared(spark):
    """Every two sets of similarity 0.8 have one of their rarest in common, and texts that only share a passage have none."""
    r = random.Random(12)
    base = [r.getrandbits(60) for _ in range(100)]
    sets = {i: {*r.sample(base, r.randint(80, 100)), *(r.getrandbits(60) for _ in range(r.randint(0, 20)))} for i in range(40)}
    sets |= {100 + i: {*base[:60], *(r.getrandbits(60) for _ in range(40))} for i in range(20)}
    rows = [(i, np.sort(np.array(list(x), np.int64)).tobytes()) for i, x in sets.items()]
    rare = collections.defaultdict(set)
    for x in minhash.rarest(spark.createDataFrame(rows, "s_id long, set binary"), 80).collect():
        rare[x["doc_id"]].add(x["h"])
    pairs = [(a, b) for a in sets for b in sets if a < b and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])]
    assert len(pairs) > 10 and all(rare[a] & rare[b] for a, b in pairs)
    assert not any(rare[100 + i] for i in range(20))


def test_components(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, 101), (101, 102), (200, 100)]
    got = {r["id"]: r["component"] for r in components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert got == {i: 0 for i in range(1, 41)} | {101: 100, 102: 100, 200: 100}
    assert components(spark.createDataFrame([], "u long, v long")).count() == 0


def removed(rows, length):
    texts = [(i, (t or "").encode()) for i, t, *_ in rows]
    seen = collections.Counter(b[k : k + length] for _, b in texts for k in range(len(b) - length + 1))
    out = {}
    for i, b in texts:
        gone = bytearray(len(b))
        for k in range(len(b) - length + 1):
            if seen[b[k : k + length]] > 1:
                gone[k : k + length] = b"\x01" * length
        spans = sum(1 for k in range(len(b)) if gone[k] and not (k and gone[k - 1]))
        out[i] = (len(b), sum(gone), spans, hashlib.sha256(bytes(x for x, g in zip(b, gone) if not g)).hexdigest())
    return out


@pytest.mark.parametrize("heavy", [2048, 1])
def test_suffix(docs, heavy):
    expected = removed(corpus(), 60)
    got = {r["doc_id"]: (r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in suffix_dedup.decide(docs, length=60, gram=16, heavy=heavy).collect()}
    assert got == expected and sum(x[1] for x in expected.values()) > 1000


def test_suffix_cases(spark, none):
    assert suffix_dedup.decide(none).count() == 0
    got = suffix_dedup.decide(odd(spark), length=5, gram=3).collect()
    assert sorted((str(r["doc_id"]), r["n_removed"]) for r in got) == [("1", 11), ("1", 11), ("2", 0), ("None", 0)]
    assert {bytes(r["text"]) for r in suffix_dedup.remove(odd(spark), length=5, gram=3).collect()} == {b""}


def test_bounded_expansion():
    r = random.Random(3)
    for _ in range(20):
        segs = list({bytes(r.choice(b"ab") for _ in range(r.randint(8, 40))) for _ in range(r.randint(1, 5))})
        seen = collections.Counter(s[i : i + 8] for s in segs for i in range(len(s) - 7))
        got = suffix_dedup.repeated_starts(segs, [1] * len(segs), 8)
        assert [g.tolist() for g in got] == [[seen[s[i : i + 8]] > 1 for i in range(len(s) - 7)] for s in segs]


def test_decontaminate(spark, none):
    r = random.Random(2)
    vocab = [f"w{i}" for i in range(300)]
    items = [(k, " ".join(r.choice(vocab) for _ in range(r.randint(3, 40)))) for k in range(12)] + [(90, ""), (91, None)]
    rows = []
    for i in range(50):
        w = [r.choice(vocab) for _ in range(r.randint(5, 60))]
        if i % 2:
            leak = items[i % 12][1].upper().split()
            for _ in range(i % 4):
                leak[r.randrange(len(leak))] = "edit"
            w[5:5] = leak
        rows.append((i, " ".join(w), "en", "s", 0))
    rows += [(60, None, "en", "s", 0), (61, "", "en", "s", 0), (1, rows[1][1], "en", "s", 0), (62, (items[0][1] + " ") * 30, "en", "s", 0)]

    def sets(w):
        s = {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))}
        return s, sum(len(set(x)) for x in s)

    expected = set()
    for i, t, *_ in rows:
        w = (t or "").lower().split()
        for k, item in items:
            v = (item or "").lower().split()
            if not v:
                continue
            b, wb = sets(v)
            for s in range(len(w)):
                a, wa = sets(w[s : s + len(v)])
                both = sum(len(set(x)) for x in a & b)
                if 100 * both >= 80 * (wa + wb - both):
                    expected.add((i, k))
                    break
    bench = spark.createDataFrame(items, "item_id long, text string")
    docs = spark.createDataFrame(rows, DOCS)
    got = decontaminate.leaks(docs, bench)
    assert "Python" not in got._jdf.queryExecution().executedPlan().toString()
    assert {(r["doc_id"], r["item_id"]) for r in got.collect()} == expected and len(expected) > 4
    assert {r["doc_id"] for r in decontaminate.clean(docs, bench).collect()} == {r[0] for r in rows} - {i for i, _ in expected}
    assert decontaminate.leaks(none, bench).count() == 0 and decontaminate.leaks(docs, bench.limit(0)).count() == 0
    assert decontaminate.clean(odd(spark), bench).count() == 4


def test_decontaminate_any_order(spark):
    """Items whose parts change order, and items of fewer words than a shingle, against brute force."""
    r = random.Random(6)
    vocab = [f"v{i}" for i in range(4000)]
    some = lambda n: [r.choice(vocab) for _ in range(n)]
    a, b = some(24), some(24)
    x, y, z = some(30), some(20), some(25)
    items = {1: a + b, 2: x + y + z, 3: ["tiny", "leak", "here"], 4: ["one"], 5: ["p", "q", "r", "s"]}
    docs = {1: some(60) + b + a + some(30), 2: b + a, 3: some(9) + z + y + x, 4: some(20) + y + x + z + some(4), 5: some(50) + items[3] + some(7)}
    docs |= {6: some(8) + items[3], 7: ["one"], 8: ["p", "q", "r"], 9: ["o", *items[5]], 10: some(70), 11: [*items[3], "x"] * 3, 12: a[:12] + b + a[12:]}

    def sets(w):
        s = {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))}
        return s, sum(len(set(t)) for t in s)

    best = {}
    for i, w in docs.items():
        for k, v in items.items():
            t, wt = sets(v)
            for s in range(len(w)):
                u, wu = sets(w[s : s + len(v)])
                both = sum(len(set(g)) for g in t & u)
                if 100 * both >= 80 * (wt + wu - both) and both / (wt + wu - both) > best.get((i, k), (0, 0))[0]:
                    best[i, k] = both / (wt + wu - both), s
    got = decontaminate.leaks(spark.createDataFrame([(i, " ".join(w)) for i, w in docs.items()], "doc_id long, text string"), spark.createDataFrame([(k, " ".join(v)) for k, v in items.items()], "item_id long, text string"))
    assert {(g["doc_id"], g["item_id"]): (g["similarity"], g["at"]) for g in got.collect()} == best
    assert {(1, 1), (2, 1), (5, 3), (6, 3), (7, 4), (9, 5), (11, 3)} <= set(best)


def test_decontaminate_long(spark):
    """A document of nothing but copies of an item, and an item of more words than a 16-bit counter holds."""
    r = random.Random(1)
    vocab = [f"w{i}" for i in range(5000)]
    some = lambda n: [r.choice(vocab) for _ in range(n)]
    item, big = some(200), some(50_000)
    edited = some(3000) + big[:20_000] + ["edit"] + big[20_001:] + some(500)
    docs = [(1, " ".join(item * 1500)), (2, " ".join(edited)), (3, " ".join(edited[:30_000])), (4, " ".join(some(20_000)))]
    items = [(5, " ".join(item)), (6, " ".join(big))]
    got = decontaminate.leaks(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"))
    assert {(g["doc_id"], g["item_id"]): g["at"] for g in got.collect()} == {(1, 5): 0, (2, 6): 3000}


def test_lm(spark, docs, none):
    rows = corpus()
    held = lambda i: zlib.crc32(str(i).encode()) % 7 == 2
    count = collections.Counter(w for i, t, *_ in rows if not held(i) for w in [*words(t), None])
    n, v = sum(count.values()), len(count)
    got = {r["doc_id"]: r for r in lm.score(docs).collect()}
    for i, t, *_ in rows:
        w = [*words(t), None]
        r = got[i]
        assert (r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"]) == (held(i), len(w), sum(count[x] > 0 for x in w), n)
        assert math.isclose(r["base_score"], sum(math.log10((count[x] + 1) / (n + v + 1)) for x in w), rel_tol=1e-9)
        assert r["score"] < 0 and math.isfinite(r["score"])
    assert lm.score(none).count() == 0
    assert lm.score(odd(spark)).count() == 4


def test_lm_score(spark):
    """Scores put together again from the lattice, the counts and the discount, word by word."""
    rows = [(i, t) for i, t, *_ in corpus(n=30)]
    held = lambda i: zlib.crc32(str(i).encode()) % 7 == 2
    count = collections.Counter(w for i, t in rows if not held(i) for w in words(t))
    ends = sum(not held(i) for i, _ in rows)
    n, v = sum(count.values()) + ends, len(count) + 1
    once, twice = (sum(c == k for c in count.values()) for k in (1, 2))
    d = once / (once + 2 * twice)
    pieces, logp = lm.vocabulary()
    spell = lambda w: np.frombuffer(b" " + w.encode(), np.uint8)[None, :]
    fits = []
    for _ in range(lm.ROUNDS):
        lattice, total = lm.Lattice(pieces, logp), np.full(len(pieces), lm.PRIOR)
        fits.append(sum(lattice.expected(spell(w), np.array([float(c)]), total) for w, c in count.items()) / sum(count.values()))
        logp = np.log(total / total.sum())
        if len(fits) > 1 and fits[-1] - fits[-2] < lm.SETTLED:
            break
    assert fits == sorted(fits) and len(fits) > 1
    lattice = lm.Lattice(pieces, logp)

    def log10(w):
        mass = math.exp(lattice.forward(spell(w), lattice.edges(spell(w)))[0, -1])
        return math.log10(max(count[w] - d, 0) / n + d * v / n * mass)

    got = {r["doc_id"]: r["score"] for r in lm.score(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    for i, t in rows:
        assert math.isclose(got[i], sum(map(log10, words(t))) + math.log10((ends - d) / n), rel_tol=1e-5), i


def test_lattice():
    """The forward recursion is the sum over all segmentations, and expected counts are those of the posterior."""
    pieces = sorted([b" ", b"a", b"b", b" a", b"ab", b"ba", b"aba"])
    logp = np.log(np.arange(1, 8) / 28)
    p = dict(zip(pieces, np.exp(logp), strict=True))

    def paths(s):
        return [[]] if not s else [[x, *rest] for x in pieces if s.startswith(x) for rest in paths(s[len(x) :])]

    lattice = lm.Lattice(pieces, logp)
    for word in (b" aba", b" baab", b" bbbb"):
        chars = np.frombuffer(word, np.uint8)[None, :]
        weight = [math.prod(p[x] for x in path) for path in paths(word)]
        assert math.isclose(lattice.forward(chars, lattice.edges(chars))[0, -1], math.log(sum(weight)))
        out = np.zeros(len(pieces))
        lattice.expected(chars, np.array([2.0]), out)
        for k, x in enumerate(pieces):
            assert math.isclose(out[k], 2 * sum(w * path.count(x) for w, path in zip(weight, paths(word), strict=True)) / sum(weight), abs_tol=1e-9)


def test_quality(spark, none):
    r = random.Random(4)
    rows, labels = [], []
    for i in range(300):
        good = i % 3 > 0
        text = "\n".join(" ".join(r.choice(["the", "of", "house", "River.", "and", "sees"]) + ("" if good else "%%% BUY!!") for _ in range(8)) for _ in range(r.randint(1, 9)))
        rows.append((i, text, "en", "s", 0))
        labels.append((i, int(good), 0))
    docs, labels = spark.createDataFrame(rows, DOCS), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    got = {x["doc_id"]: x for x in quality.score(docs, labels).collect()}
    held = [i for i in got if zlib.crc32(str(i).encode()) % 3 == 1]
    assert all(got[i]["held_out"] == (i in held) and 0 <= got[i]["score"] <= 1 for i in got)
    assert np.mean([got[i]["predicted"] == (i % 3 > 0) for i in held]) > 0.97
    assert {x["doc_id"] % 3 for x in quality.keep_good(docs, labels).collect()} >= {1, 2}
    assert quality.score(none, labels).count() == 0
    assert {x["score"] for x in quality.score(odd(spark), labels.limit(0)).collect()} == {0.5}
    assert quality.score(odd(spark), labels).count() == 4
    assert quality.keep_good(odd(spark), labels.limit(0)).columns == ["doc_id", "text", "key", "kept_id"]


def test_quality_long_documents(spark):
    """A labelled document past the bound on lines is not learnt from, wherever its hash puts it, and changes no other score."""
    r = random.Random(6)
    rows = [(i, "\n".join(" ".join(r.choice(["the", "of", "house", "River."]) + ("" if i % 3 else "%%% BUY!!") for _ in range(6)) for _ in range(4))) for i in range(60)]
    labels = [(i, int(i % 3 > 0)) for i in range(60)]
    first = spark.range(1000, 1400).where("pmod(crc32(cast(id as string)), 3) <> 1").orderBy(F.xxhash64("id")).first()["id"]
    assert spark.range(60).select(F.min(F.xxhash64("id"))).first()[0] > spark.range(first, first + 1).select(F.xxhash64("id")).first()[0]
    schema = "doc_id long, text string"
    score = lambda rows, labels, **o: {x["doc_id"]: x["score"] for x in quality.score(spark.createDataFrame(rows, schema), spark.createDataFrame(labels, "doc_id long, quality int"), **o).collect()}
    plain = score(rows, labels)
    long = score(rows + [(first, "x\n" * 1_000_000)], labels + [(first, 1)])
    assert len(set(plain.values())) > 10 and {k: long[k] for k in plain} == plain and 0 <= long[first] <= 1
    # of an id with several texts the shortest is learnt from, once, however often it comes
    assert {k: v for k, v in score(rows + [(0, "y\n" * 50)] + [rows[0]] * 3, labels).items() if k} == {k: v for k, v in plain.items() if k}


def test_chain():
    """Marginals and expected transitions against all labellings."""
    import itertools

    rng = np.random.default_rng(1)
    e, t = rng.normal(size=4), rng.normal(size=(2, 2))
    p, pair = quality.marginals(e, np.array([0, 4]), t, True)
    every = [(y, math.exp(sum(e[k] for k in range(4) if y[k]) + sum(t[y[k], y[k + 1]] for k in range(3)))) for y in itertools.product((0, 1), repeat=4)]
    z = sum(w for _, w in every)
    assert np.allclose(p, [sum(w for y, w in every if y[k]) / z for k in range(4)])
    assert np.allclose(pair, [[sum(w * sum(y[k] == a and y[k + 1] == b for k in range(3)) for y, w in every) / z for b in (0, 1)] for a in (0, 1)])


def test_licenses(spark, none):
    filler = "the river and the house of the old town where people see\nanother line about nothing"
    rows = [(k, f"{filler}\n{notice}\n{filler}", "en", "s", 0) for k, notice in enumerate(n[0] for n in licenses.TEMPLATES.values())]
    rows += [(100 + i, filler + f" {i}\nthe licence of love is free", "en", "s", 0) for i in range(30)] + [(200, None, "en", "s", 0), (201, "", "en", "s", 0)]
    got = licenses.scan(spark.createDataFrame(rows, DOCS)).where("confirmed").collect()
    names = list(licenses.TEMPLATES)
    assert {(r["doc_id"], r["paragraph"]) for r in got} == {(k, 2) for k in range(len(names))}
    assert np.mean([r["family"] == names[r["doc_id"]] for r in got]) > 0.9
    assert licenses.scan(none).count() == 0


def test_licenses_wrapped(spark):
    """Notices that are wrapped, commented, or share a line with another one; long texts; and what only looks like one."""
    import textwrap

    mit, bsd, gpl = licenses.TEMPLATES["mit"][2], licenses.TEMPLATES["bsd"][2], licenses.TEMPLATES["gpl-3.0"][2]
    plain = "the river and the house of the old town where people see another line about nothing at all"
    long = "\n".join(plain for _ in range(20000))
    rows = [
        (1, "\n".join(textwrap.wrap(mit, 60))),
        (2, "/*\n" + "\n".join(" * " + x for x in textwrap.wrap(gpl, 50)) + "\n */\n" + plain),
        (3, f"{plain} {mit} {plain} {bsd} {plain}"),
        (4, "\n".join("# " + x for x in ["The MIT License (MIT)", "", *textwrap.wrap(mit, 70)])),
        (5, plain + "\nSPDX-License-Identifier: MIT\n" + plain),
        (6, f"{long}\n{bsd}\n{long}"),
        (7, "permission is granted to any person to deal in software and conditions without any restriction " + plain),
        (8, " - -- \n --"),
    ] + [(k, f"{plain} {k}") for k in range(20, 60)]
    got = collections.defaultdict(set)
    for r in licenses.scan(spark.createDataFrame(rows, "doc_id long, text string")).where("confirmed").collect():
        got[r["doc_id"]].add((r["family"], r["paragraph"]))
    assert {i: {f for f, _ in x} for i, x in got.items()} == {1: {"mit"}, 2: {"gpl-3.0"}, 3: {"mit", "bsd"}, 4: {"mit"}, 5: {"mit"}, 6: {"bsd"}}
    assert ("gpl-3.0", 1) in got[2] and ("mit", 1) in got[5] and ("bsd", 20000) in got[6]


def test_licenses_confirm():
    """The share of a notice's bigrams against all stretches of its length and a quarter."""
    r = random.Random(3)
    notice = [f"n{i}" for i in range(12)]
    grams, n = licenses._template_sets_of([" ".join(notice)])[0]
    for _ in range(60):
        w = [r.choice(["x", "y", *notice]) if r.random() < 0.6 else notice[k % 12] for k in range(r.randint(2, 40))]
        h = licenses._hash_each([" ".join(w)])[0]
        own = licenses.C.mix(h[:-1] * np.uint64(licenses.C.BASE) + h[1:]).tolist()
        span = n + n // 4 + 1
        want = max(len({x for x in own[i : i + span + 1] if x in grams}) / len(grams) for i in range(len(own)))
        assert math.isclose(licenses.confirm(h, 0, len(h), 0, len(h), [(grams, n)])[0], want)


def test_licenses_held_out():
    """Notices and paragraphs that a training doesn't see: most are told apart."""
    r = random.Random(5)
    vocab = ["river", "house", "the", "of", "and", "town", "people", "see", "old", "line", "free", "use", "this", "is"]
    z, y = licenses.held_out_logits([" ".join(r.choice(vocab) for _ in range(30)) for _ in range(300)], 50)
    top = z.argmax(axis=1)
    assert np.mean(top[y == 0] == 0) > 0.9 and np.mean(top[y > 0] > 0) > 0.3
    z, y = licenses.held_out_logits([" ".join(r.choice(vocab) for _ in range(30)) for _ in range(300)], 50, varied=True)
    assert np.mean(z.argmax(axis=1) == y) > 0.7


@pytest.mark.parametrize("chunk", [4, 4096])
def test_mixing(docs, chunk):
    rows = corpus()
    size = {i: len(words(t)) for i, t, *_ in rows}
    per = collections.Counter()
    for i, _, _, s, _ in rows:
        per[s] += size[i]
    names = sorted((s for s in per if s is not None)) + [None]
    weight = {s: (3, 1, 2)[k % 3] for k, s in enumerate(names)}
    total, capped, target = 1.5 * sum(per.values()), set(), {}
    while True:
        rest = total - sum(2 * per[s] for s in capped)
        target = {s: 2 * per[s] if s in capped else rest * weight[s] / sum(weight[x] for x in names if x not in capped) for s in names}
        over = {s for s in names if target[s] > 2 * per[s] + 1e-9}
        if not over:
            break
        capped |= over
    got = mixing.mix(docs, chunk=chunk).collect()
    taken = collections.Counter()
    for r in got:
        assert r["size"] == size[r["doc_id"]] and r["source_size"] == per[r["source"]] and math.isclose(r["target"], target[r["source"]], rel_tol=1e-9)
        assert 0 <= r["taken"] <= 2 * r["size"] and (not r["size"] or r["taken"] % r["size"] == 0)
        taken[r["source"]] += r["taken"]
    assert len(got) == len(rows)
    for s in names:
        assert abs(taken[s] - target[s]) <= max(size.values())
    again = mixing.mix(docs.repartition(5), chunk=chunk).collect()
    assert sorted((r["doc_id"], r["taken"]) for r in got) == sorted((r["doc_id"], r["taken"]) for r in again)


def test_mixing_by_row(docs):
    """Every row's decision, recomputed in exact fractions: sources of one chunk, units by id, three at a time."""
    from fractions import Fraction

    got = mixing.mix(docs).collect()
    by = collections.defaultdict(list)
    for r in got:
        by[r["source"]].append(r)
    for own in by.values():
        own.sort(key=lambda r: (r["doc_id"], r["size"]))
        ratio = own[0]["target"] / own[0]["source_size"] if own[0]["source_size"] else 0.0
        whole = math.floor(ratio + 1e-12)
        p = [Fraction(max(0.0, ratio - whole))] * len(own)
        size = [r["size"] for r in own]
        while len(live := [i for i, x in enumerate(p) if 0 < x < 1][:3]) == 3:
            i, j, k = live
            u = dict(zip(live, (size[j] - size[k], size[k] - size[i], size[i] - size[j]), strict=True))
            if not any(u.values()):
                u = {i: 1, j: -1}
            step = min((1 - p[m]) / x if x > 0 else p[m] / -x for m, x in u.items() if x)
            for m, x in u.items():
                p[m] += step * x
        rest = [i for i, x in enumerate(p) if 0 < x < 1]
        goal = sum(p[i] * size[i] for i in rest)
        near = {c: abs(goal - sum(size[i] for i, y in zip(rest, c, strict=True) if y)) for c in itertools.product((0, 1), repeat=len(rest))}
        best = [c for c, d in near.items() if d - min(near.values()) < 1e-6]
        fixed = [(whole + int(p[i])) * size[i] for i in range(len(own)) if i not in rest]
        assert [r["taken"] for i, r in enumerate(own) if i not in rest] == fixed
        assert tuple(own[i]["taken"] for i in rest) in [tuple((whole + y) * size[i] for i, y in zip(rest, c, strict=True)) for c in best]


def test_mixing_shared_ids(spark):
    """An id of a third of all rows, a text of another third without ids: chunks stay small and totals near the target."""
    rows = [(7 if k % 3 == 0 else None if k % 3 == 1 else k, "same text here" if k % 3 == 1 else " ".join(["w"] * (1 + k % 5)), "s") for k in range(6000)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    from quillgraph.llm.common import cut

    sized = cut(df.select("doc_id", "source", F.length("text").alias("size"), F.monotonically_increasing_id().alias("row"), F.coalesce("doc_id", F.xxhash64("text")).alias("spread")))
    largest = mixing._dealt(sized, 64).groupBy(F.pmod("spread", F.lit(-(-6000 // 64)))).count().agg({"count": "max"}).first()[0]
    assert largest < 128
    got = mixing.mix(df, chunk=64).collect()
    assert len(got) == 6000 and abs(sum(r["taken"] for r in got) - got[0]["target"]) <= 5
    assert collections.Counter((r["doc_id"], r["size"]) for r in got) == collections.Counter((i, len(words(t))) for i, t, _ in rows)
    assert abs(mixing.repeat(df, chunk=64).select(F.size(F.split("text", " "))).agg({"size(split(text,  , -1))": "sum"}).first()[0] - got[0]["target"]) <= 5


def test_mixing_cases(spark, none, docs):
    assert mixing.mix(none).count() == 0
    assert mixing.mix(spark.createDataFrame([(1, None, "en", None, 0), (2, " ", "en", "a", 0)], DOCS)).agg({"taken": "sum"}).first()[0] == 0
    out = mixing.repeat(docs)
    assert out.columns == docs.columns and out.count() > 0


def test_repeat_takes_rows(spark):
    """Rows without an id, rows that share one, rows of size 0, and columns named as the plan's."""
    ids = [None, 7, 7, 7, None] * 8 + list(range(20, 60))
    rows = [(i, "" if k % 9 == 4 else " ".join(f"t{k}x{j}" for j in range(4 + k % 3)), f"s{k % 2}", k, k, k) for k, i in enumerate(ids)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, _id long, row long, mix_row long").repartition(3)
    out = mixing.repeat(df)
    assert out.columns == df.columns
    got = collections.Counter(tuple(r) for r in out.collect())
    assert set(got) <= set(rows) and max(got.values()) <= 2
    assert {r[0] for r in got} >= {None, 7} and any(not r[1] for r in got)
    for s in ("s0", "s1"):
        target = mixing.mix(df).where(f"source = '{s}'").first()["target"]
        assert abs(sum(n * len(words(r[1])) for r, n in got.items() if r[2] == s) - target) <= 6
    kept = {r[3]: n for r, n in got.items()}
    units = mixing._plan(df, df["_id"]).collect()
    assert sum(kept.values()) == sum(r["copies"] for r in units)


def test_flight_keeps_totals():
    r = random.Random(8)
    p, s = [r.random() for _ in range(300)], [float(r.randint(0, 50)) for _ in range(300)]
    q = mixing.flight(p, s)
    assert sum(0 < x < 1 for x in q) <= 2
    assert math.isclose(sum(p), sum(q), abs_tol=1e-6) and math.isclose(sum(a * b for a, b in zip(p, s)), sum(a * b for a, b in zip(q, s)), abs_tol=1e-5)


def test_html():
    page = "<head><title>no</title></head><h1>T &amp; x</h1><p>one<p>two <b>bold</b><ul><li>a<li>b<ol><li>x<li>y</ol></ul><table><tr><td>aa<td>b<tr><td>c<td>dddd</table>tail<div style='display:none'>no</div><pre> k\n  l</pre>end<br>x<script>var a='</p>'</script><!-- no -->z"
    assert html_text.render(page) == "T & x\n\none\n\ntwo bold\n\n- a\n- b\n  1. x\n  2. y\n\naa | b\nc  | dddd\n\ntail\n\n k\n  l\n\nend\nxz"
    assert html_text.render(None) == html_text.render("") == html_text.render("<p hidden>x") == ""
    assert html_text.render("a < b & c") == "a < b & c"
    assert html_text.render("<div>" * 5000 + "x") == "x" and "x" in html_text.render("<table><tr><td>" * 200 + "x")


def test_html_visible():
    assert html_text.render("<table><tr><th colspan=2>head over<th>z<tr><td>a<td>b<td>c<tr><td rowspan=2>tall<td>1<td>2<tr><td>3<td>4</table>") == "head over | z\na    | b  | c\ntall | 1  | 2\n     | 3  | 4"
    assert html_text.render("<head><title>no</title></head>") == "" and html_text.render("<head>text") == "text"
    assert html_text.render("<p style='visibility:hidden'>no<b style='visibility: visible'>yes</b>no</p>x") == "yes\n\nx"
    assert html_text.render("<select><option>a<option selected>b</select> t<i aria-hidden=true>s</i>") == "b ts"
    assert html_text.render("<svg><title>no</title><text>in svg</text></svg><math><mi>m</mi></math><xmp><b>raw</b></xmp>u") == "in svg\nm\n\n<b>raw</b>\n\nu"
    assert html_text.render("<ul hidden><li>x</ul>y<td hidden>z</td>w") == "yw"
    assert html_text.render("<p class=it's>ok<a href='q>r'>s</a>") == "oks"


def test_html_trees():
    """Generated trees: every visible word comes out once and in order, and no hidden one."""
    r = random.Random(9)

    def tree(depth, seen):
        out, said = "", []
        for _ in range(r.randint(1, 4)):
            w = f"w{r.randrange(10**9)}"
            if depth and r.random() < 0.6:
                name = r.choice(["div", "p", "ul", "li", "b", "table", "section", "span", "blockquote"])
                how = r.choice(["", "", "", " hidden", " style='display:none'", " style='visibility:hidden'", " style='visibility:visible'"])
                shown = {" style='visibility:hidden'": False, " style='visibility:visible'": seen is not None}.get(how, seen)
                inner, words_ = tree(depth - 1, None if how in (" hidden", " style='display:none'") or seen is None else shown)
                cell, end = ("<tr><td>", "</table>") if name == "table" else ("", f"</{name}>" if name != "p" else "")
                if name == "p":
                    inner, words_ = f"<i>{w}</i>", [w] if seen is not None and shown and not how.startswith((" hidden", " style='display")) else []
                    end = "</p>"
                around = ("<ul>", "</ul>") if name == "li" else ("", "")
                out, said = out + f"{around[0]}<{name}{how}>{cell}{inner}{end}{around[1]}", said + words_
            else:
                out += f" {w} "
                said += [w] if seen else []
        return out, said

    for _ in range(200):
        page, said = tree(4, True)
        assert re.findall(r"w\d+", html_text.render(page)) == said, page


@pytest.mark.parametrize("piece", ["<div>", "<ul><li>", "<ul><li>x", "<a ", "<a \">\" ", "<table><tr><td>x", "<select><option>x", "<![CDATA[>", "<p>", "<td colspan=1000 rowspan=60000>x<tr>"])
def test_html_takes_time_in_proportion(piece):
    """Four times as much page in at most ten times the time."""
    import time

    took = []
    for size in (100_000, 400_000):
        start = time.process_time()
        html_text.render("<table>" * piece.startswith("<td") + piece * (size // len(piece)))
        took.append(time.process_time() - start)
    assert took[1] < 10 * took[0] + 0.5


def test_html_tables_are_aligned():
    """Random tables with spans: what begins in a column of the grid begins at one place of its line, whatever its width."""
    r = random.Random(10)
    for _ in range(150):
        page, grid, where, n, lines_of = "", set(), {}, 0, []
        rows, columns = r.randint(1, 6), r.randint(1, 6)
        for y in range(rows):
            page, high = page + "<tr>", 1
            for x in range(columns):
                if (x, y) in grid:
                    continue
                wide = 1 + (x + 1 < columns and (x + 1, y) not in grid and r.random() < 0.2)
                tall = r.choice((1, 1, 1, 2, 3))
                cell = [f"w{n + k:05d}" + "x" * r.choice((0, 3, 9, 120)) for k in range(r.randint(1, 3))]
                n += len(cell)
                grid |= {(x + i, y + j) for i in range(wide) for j in range(tall)}
                where |= {w: (x, y, k) for k, w in enumerate(cell)}
                high = max(high, len(cell))
                page += f"<td colspan={wide} rowspan={tall}>" + "<br>".join(cell)
            lines_of += [(y, k) for k in range(high)]
        page = re.sub(r"<tr>(?=<tr>|$)", "<tr><td>", page)  # a row without cells of its own would be none
        got = html_text.render(f"<table>{page}</table>").split("\n")
        at = {w: (i, m.start()) for i, text in enumerate(got) for m in re.finditer(r"w\d+x*", text) for w in [m.group()]}
        assert at.keys() == where.keys()
        place = {}
        for w, (x, y, k) in where.items():
            i, offset = at[w]
            assert place.setdefault(x, offset) == offset, (page, got)
            assert offset == 0 or got[i][offset - 3 : offset] == " | "
        assert sorted(place.values()) == [place[x] for x in sorted(place)]


def test_html_layout_has_room():
    """Depth and width are laid out whole; past a page's room words stay, in order."""
    deep = html_text.render("".join(f"<ul><li>v{i}" for i in range(90))).split("\n")
    assert deep == [f"{'  ' * i}- v{i}" for i in range(90)]
    nested = html_text.render("<table><tr><td>a<td>b<tr><td>" * 20 + "c")
    assert nested.count("a | b") >= 1 and len(re.findall("a +\\| b", nested)) == 20
    tall = "<table>" + "".join(f"<tr><td rowspan=3>h{i}" + "".join(f"<td>c{i}x{j}" for j in range(60)) + f"<tr><td>d{i}<tr><td>e{i}" for i in range(4)) + "</table>"
    lines = html_text.render(tall).split("\n")
    assert all(lines[3 * i + 1].index(f"d{i}") == lines[3 * i].index(f"c{i}x0") for i in range(4))
    wide = "<table>" + "".join(f"<tr><td>{'y' * (5000 if i == 7 else 4 + i % 5)}<td>z{i}" for i in range(2000)) + "</table>"
    lines = html_text.render(wide).split("\n")
    assert {x.index("z") for i, x in enumerate(lines) if i != 7} == {11} and re.findall(r"z\d+", " ".join(lines)) == [f"z{i}" for i in range(2000)]
    for page in ("<table><tr><td>q<td>" * 9000, "<ul><li>q" * 9000, "<table>" + "<tr><td colspan=900 rowspan=900>q" * 9000, "<table>" + "<tr><td rowspan=60000>q" * 9000):
        words_ = [f"w{i}" for i in range(page.count("q"))]
        it = iter(words_)
        assert re.findall(r"w\d+", html_text.render(re.sub("q", lambda m: next(it), page))) == words_


def test_html_table(spark):
    got = html_text.extract(spark.createDataFrame([(1, "<p>x", "u"), (1, "<p>x", "u"), (None, None, None)], "page_id long, html string, url string"))
    assert sorted((str(r["page_id"]), r["text"]) for r in got.collect()) == [("1", "x"), ("1", "x"), ("None", "")]
    assert html_text.extract(spark.createDataFrame([], "page_id long, html string")).count() == 0


def test_chat(spark):
    texts = ["</s>[INST] ok [/INST]", r"<\s> [\INST] \ <\\/s>", "", None, "plain\n", "[ROLE 41] x", "<", "[", "é" * 9]
    rows = [(1, i, ("user", "assistant", "system", "tool", None)[i % 5], t) for i, t in enumerate(texts)]
    rows += [(None, 3, "assistant", "b"), (None, 1, "user", "a"), (2, 0, "user", "x"), (2, 0, "user", "x")] + [(3, i, "assistant", f"t{i}") for i in range(70)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumnRenamed("x", "x")
    made = chat.format_paths(chat.linear(df))
    got = {r["conv_id"]: r for r in chat.digests(made).collect()}
    assert "Python" not in made._jdf.queryExecution().executedPlan().toString()
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    for c in (1, 2, 3, None):
        own = sorted(((t, r or "", x or "") for k, t, r, x in rows if k == c))
        assert got[c]["n_turns"] == len(own) and got[c]["turns_sha256"] == sha("".join(f"{r}\n{x}\n" for _, r, x in own))
        loss = "".join(x for _, r, x in own if r == "assistant")
        assert (got[c]["loss_chars"], got[c]["loss_sha256"]) == (len(loss), sha(loss))
    assert chat.digests(chat.format_paths(chat.linear(df.limit(0)))).count() == 0


def test_chat_branches(spark):
    rows = [(1, 1, None, "user", "q", 0.0), (1, 2, 1, "assistant", "bad", 1.0), (1, 3, 1, "assistant", "good", 2.0), (1, 4, 3, "user", "more", 0.5), (1, 5, 9, "user", "orphan", 0.0)]
    tree = spark.createDataFrame(rows, "conv_id long, node long, parent long, role string, text string, score double")
    got = chat.format_paths(tree, top=2).orderBy("rank").collect()
    assert [r["text"] for r in got] == ["<s>[INST] q</s><s>[OUT] good</s><s>[INST] more</s>", "<s>[INST] q</s><s>[OUT] bad</s>"]
    assert [[tuple(s) for s in r["loss_spans"]] for r in got] == [[(24, 28)], [(24, 27)]]


def test_decontamination_writes_the_places_near_an_item_only(spark, monkeypatch):
    """Of a document of 5,000 words, what windows around its leak can hold; all of its places were written and joined before."""
    words = [f"w{i}" for i in range(5000)]
    item = [f"i{i}" for i in range(20)]
    written, real = {}, decontaminate.cut

    def counting(df, name):
        out = real(df, name)
        written[name] = out.count()
        return out

    monkeypatch.setattr(decontaminate, "cut", counting)
    docs = spark.createDataFrame([(1, " ".join(words[:3000] + item + words[3000:])), (2, " ".join(words))], "doc_id long, text string")
    got = decontaminate.leaks(docs, spark.createDataFrame([(7, " ".join(item))], "item_id long, text string")).collect()
    assert [tuple(r) for r in got] == [(1, 7, 1.0, 3000)]
    assert 0 < written["leak-places"] <= 4 * 20
