r"""Secret scans with DataFrame functions only: fixed patterns, and a battery of randomness tests for what no pattern knows.

Patterns (leftmost matches of a kind, which don't overlap; kinds may): `assign`, a name such as password or api_key with a
value of six characters or more; `access`, AKIA and 16 or more capitals and digits; `hex`, 24 or more lower-case hex digits.

Battery: runs of 20 or more of A-Z a-z 0-9 + / - _ are tokens. A token's encoding is the narrowest alphabet that holds it:
hexadecimal, base 32, base 36 (one case) or base 64; digits alone are numbers and left out. Its symbols are tested in three
ways, each as a standard deviate under "every symbol is equally likely":

- uniformity: the chi-squared of the symbols' counts over the alphabet, by the number of pairs of equal symbols;
- runs: how often the class of symbols (capital, small letter, digit, sign) changes from one to the next;
- serial correlation: products of the neighbouring symbols' places in the alphabet.

Random tokens pass all three: the squares' sum stays under the chi-squared quantile of three degrees at 0.001. Ordinary
tokens, which are words joined together, fail them, unless they are too short to tell. So the null hypothesis whose false
rejections are controlled is "an ordinary token": letters as uneven as those of English text, and classes that change as
seldom. Uniformity and runs against it give one p-value, and the rejections at a false discovery rate of ALPHA are taken
by Benjamini and Hochberg's rule within each encoding and band of lengths, since short tokens are many and say little.
p-values are counted in steps of a twentieth of their logarithm, so that a table of fixed size settles the thresholds,
over all documents.

Texts are read whole and once, in a pass without a shuffle; the second pass reads what the first has written of each
document, its spans. Positions come from the pieces between matches, added up in log2(matches) steps, not by a loop.

Defined cases: null or empty texts have no spans. Rows that repeat a doc_id, null ones too, are rows of their own. Equal
spans of two kinds are both given. An empty table gives an empty result. Extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .common import cut

# The patterns of the base kinds.
ASSIGN = r"""([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS, HEX, TOKEN = "AKIA[A-Z0-9]{16,}", "[0-9a-f]{24,}", "[A-Za-z0-9+/_-]{20,}"
LEAST_VALUE = 6
KINDS = ("assign", "access", "hex", "random")

_DIGITS, _SMALL, _CAPITAL = "0123456789", "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
#: Encodings from the narrowest on: alphabet in the order of its values, and how many symbols each class has.
ENCODINGS = [
    (_DIGITS + "abcdef", (10, 6)),
    (_CAPITAL + "234567", (26, 6)),
    (_DIGITS + _SMALL, (10, 26)),
    (_CAPITAL + _SMALL + _DIGITS + "+/", (26, 26, 10, 2)),
]
#: The rate of false discoveries, and the chi-squared quantile that a random token stays under (three degrees, 0.001).
ALPHA, RANDOM = 0.01, 16.266
#: Ordinary text: 26 times the chance that two letters of English are equal, 676 times that of three, and how often the class changes.
PAIRS, TRIPLES, CHANGES = 1.73, 3.58, 0.15
STEPS, MOST = 20, 400
BANDS = 16


def _sums(lengths: Column) -> Column:
    """Prefix sums of an array, each step adding what lies 1, 2, 4 ... places before."""

    def step(a: Column, k: Column) -> Column:
        gap = F.pow(F.lit(2), k).cast("int")
        return F.zip_with(a, F.slice(F.concat(F.array_repeat(F.lit(0), gap), a), 1, F.size(a)), lambda x, y: x + y)

    return F.aggregate(F.sequence(F.lit(0), F.ceil(F.log2(F.size(lengths).cast("double"))).cast("int")), lengths, step)


def _bound(value: Column, use) -> Column:
    """use(value), with value computed once."""
    return F.element_at(F.transform(F.array(value), use), 1)


def places(text: Column, pattern: str, empty: str = "array<struct<start:int,end:int,text:string>>") -> Column:
    """start, end, text of the matches of a pattern that matches nothing empty, in code points."""

    def located(found: Column) -> Column:
        pieces = F.split(text, pattern, -1)
        lengths = F.flatten(F.zip_with(F.slice(pieces, 1, F.size(found)), found, lambda p, m: F.array(F.length(p), F.length(m))))
        spans = _bound(_sums(lengths), lambda at: F.transform(found, lambda m, i: F.struct(F.get(at, 2 * i).alias("start"), F.get(at, 2 * i + 1).alias("end"), m.alias("text"))))
        return F.when(F.size(found) > 0, spans).otherwise(F.array().cast(empty))

    return _bound(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), located)


def _assigned(text: Column) -> Column:
    """The places of ASSIGN whose value is long enough; a match that isn't takes its text all the same."""
    values = F.regexp_extract_all(text, F.lit(ASSIGN), F.lit(2))
    both = F.zip_with(places(text, ASSIGN), values, lambda s, v: F.struct(s["start"].alias("start"), s["end"].alias("end"), F.length(v).alias("n")))
    return F.filter(both, lambda x: x["n"] >= LEAST_VALUE)


def _of(code: Column, values: list) -> Column:
    return F.element_at(F.array(*map(F.lit, values)), code)


def _change_moments(sizes: tuple[int, ...]) -> tuple[float, float]:
    """The chance that two neighbouring symbols are of different classes, and the covariance of two such changes in a row."""
    k = sum(sizes)
    p = [x / k for x in sizes]
    q = 1 - sum(x * x for x in p)
    return q, sum(x * (1 - x) ** 2 for x in p) - q * q


def _named(s: Column) -> Column:
    """The encoding of a token as a number from 1 on (0: a number), and its text as symbols of that alphabet."""
    t = s["text"]
    code = F.when(F.rlike(t, F.lit("^[0-9]+$")), 0).when(F.rlike(t, F.lit("^([0-9a-f]+|[0-9A-F]+)$")), 1).when(F.rlike(t, F.lit("^[A-Z2-7]+$")), 2).when(F.rlike(t, F.lit("^([0-9a-z]+|[0-9A-Z]+)$")), 3).otherwise(4)
    return F.struct(s["start"].alias("start"), s["end"].alias("end"), code.alias("code"), t.alias("text"))


def _counted(s: Column) -> Column:
    """Pairs of equal symbols, changes of class, and the sum of products of neighbours' doubled distances from the middle."""
    code, k = s["code"], _of(s["code"], [len(a) for a, _ in ENCODINGS])
    alphabet = _of(code, [a for a, _ in ENCODINGS])
    text = F.when(code.isin(1, 3), F.lower(s["text"])).when(code == 4, F.translate(s["text"], "-_", "+/")).otherwise(s["text"])

    def stats(x: Column) -> Column:
        t, abc = x["t"], x["abc"]
        times = F.transform(F.sequence(F.lit(1), F.length(abc)), lambda i: F.length(t) - F.length(F.replace(t, F.substr(abc, i, F.lit(1)), F.lit(""))))
        pairs = F.aggregate(times, F.lit(0).cast("long"), lambda a, c: a + c.cast("long") * (c - 1)) / 2
        classes = F.translate(t, _CAPITAL + _SMALL + _DIGITS + "/", "A" * 26 + "a" * 26 + "0" * 10 + "+")
        values = F.transform(F.split(t, ""), lambda c: (2 * F.position(c, abc) - F.length(abc) - 1).cast("long"))
        product = _bound(values, lambda v: F.aggregate(F.zip_with(F.slice(v, 1, F.size(v) - 1), F.slice(v, 2, F.size(v) - 1), lambda a, b: a * b), F.lit(0).cast("long"), lambda a, b: a + b))
        return F.struct(F.length(t).cast("double").alias("n"), k.cast("double").alias("k"), pairs.cast("double").alias("pairs"), (F.regexp_count(classes, F.lit(r"A+|a+|0+|\++")) - 1).cast("double").alias("changes"), product.cast("double").alias("product"))

    return F.struct(s["start"].alias("start"), s["end"].alias("end"), code.alias("code"), _bound(F.struct(text.alias("t"), alphabet.alias("abc")), stats).alias("c"))


def _tested(s: Column) -> Column:
    """key: encoding and band of length; step: the p-value of "an ordinary token", in twentieths of its logarithm; random: the token passes the battery."""
    code, c = s["code"], s["c"]
    n, k = c["n"], c["k"]
    of_two = n * (n - 1) / 2
    moments = [_change_moments(sizes) for _, sizes in ENCODINGS]
    q, cov = _of(code, [m[0] for m in moments]), _of(code, [m[1] for m in moments])
    uniform = (c["pairs"] - of_two / k) / F.sqrt(of_two / k * (1 - 1 / k))
    runs = (c["changes"] - (n - 1) * q) / F.sqrt((n - 1) * q * (1 - q) + 2 * (n - 2) * cov)
    serial = c["product"] / ((k * k - 1) / 3 * F.sqrt(n - 1))
    # an ordinary token has letters of one or two cases: uneven by as much as 26 letters are, or the alphabet if that is narrower
    letters = F.least(k, F.lit(26.0))
    two, three = PAIRS / letters, TRIPLES / (letters * letters)
    even = (of_two * two - c["pairs"]) / F.sqrt(of_two * two * (1 - two) + n * (n - 1) * (n - 2) * (three - two * two))
    mixed = (c["changes"] - (n - 1) * CHANGES) / F.sqrt((n - 1) * (CHANGES * (1 - CHANGES)))
    z = (even + mixed) / F.sqrt(F.lit(2.0))
    tail = (z * z / 2 + F.log(0.656 * z + 0.344 * F.sqrt(z * z + 5.334)) + 0.918938533204673) / 2.302585092994046  # of the normal tail, to 0.3 %
    step = F.when(z > 0, F.least(F.lit(MOST), F.floor(tail * STEPS))).otherwise(0).cast("int")
    band = F.least(F.lit(BANDS - 1), F.floor(2 * F.log2(n / 20))).cast("int")
    return F.struct(s["start"].alias("start"), s["end"].alias("end"), (code * BANDS + band).alias("key"), step.alias("step"), (uniform * uniform + runs * runs + serial * serial < RANDOM).alias("random"))


def thresholds(tests: DataFrame, alpha: float = ALPHA) -> DataFrame:
    """key, least: the step from which on Benjamini and Hochberg's rule rejects; tests(key, step) is counted by step first, of which there are MOST + 1 at most."""
    steps = tests.groupBy("key", "step").agg(F.count("*").alias("n"))
    deeper = F.sum("n").over(W.partitionBy("key").orderBy(F.desc("step")))
    every = F.sum("n").over(W.partitionBy("key"))
    ruled = steps.select("key", "step", deeper.alias("deeper"), every.alias("every"))
    return ruled.where(F.pow(F.lit(10.0), -F.col("step") / STEPS) * F.col("every") <= F.col("deeper") * alpha).groupBy("key").agg(F.min("step").alias("least"))


def scan(docs: DataFrame, alpha: float = ALPHA) -> DataFrame:
    """doc_id and spans (kind, start, end; code points, end exclusive), by start and then in the order of KINDS, for every row of docs(doc_id, text)."""
    text = F.coalesce("text", F.lit(""))
    base = [_assigned(text), places(text, ACCESS), places(text, HEX)]
    plain = lambda spans, kind: F.transform(spans, lambda s: F.struct(s["start"].alias("start"), F.lit(kind).alias("kind"), s["end"].alias("end")))
    tokens = F.transform(F.transform(F.filter(F.transform(places(text, TOKEN), _named), lambda s: s["code"] > 0), _counted), _tested)
    seen = cut(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.concat(*[plain(b, k) for k, b in enumerate(base)]).alias("base"), tokens.alias("tokens")), "secret-spans")
    least = {r["key"]: r["least"] for r in thresholds(seen.select(F.explode("tokens").alias("t")).select("t.key", "t.step"), alpha).collect()}  # one for each encoding and band
    limit = F.create_map(*[F.lit(x) for pair in (least or {-1: 0}).items() for x in pair])
    random = F.filter("tokens", lambda t: t["random"] & (t["step"] >= F.coalesce(F.element_at(limit, t["key"]), F.lit(MOST + 1))))
    spans = F.array_sort(F.concat("base", plain(random, len(base))))
    return seen.select("doc_id", F.transform(spans, lambda s: F.struct(_of(s["kind"] + 1, list(KINDS)).alias("kind"), s["start"].alias("start"), s["end"].alias("end"))).alias("spans"))


def written(spans: Column) -> Column:
    """kind:start:end of each span, comma-joined."""
    return F.concat_ws(",", F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])))


def digests(found: DataFrame) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base_sha256, spans of scan()'s rows."""
    some = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    base = F.filter("spans", lambda s: s["kind"] != KINDS[-1])
    return found.select("doc_id", *[some(k) for k in KINDS[:-1]], F.sha2(written(base).cast("binary"), 256).alias("base_sha256"), written(F.col("spans")).alias("spans"))
