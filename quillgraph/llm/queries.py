"""The operators of this subpackage applied to their whole tables, with production parameters, and SQL where it can say the same."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from . import chat, collocations, decontaminate, exact_dedup, html_text, licenses, lm, minhash, mixing, quality, resample, secrets, suffix_dedup
from .common import table


def op1_minhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.classify(table(spark, sf_dir, "documents"), n=4)


def op2_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.score(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op3_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.decide(table(spark, sf_dir, "documents"), keep="largest")


def op4_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.decide(table(spark, sf_dir, "documents"))


def op5_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op6_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm.score(table(spark, sf_dir, "documents"))


def op7_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(table(spark, sf_dir, "documents")).where("confirmed")


def op8_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents"))


def op9_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.extract(table(spark, sf_dir, "pages"))


def op10_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    extra = spark.sql("select * from values (-7L, 0L, 'user', '</s>[INST] ok [/INST]'), (-7L, 1L, 'assistant', '</s>[INST] ok [/INST]') as t(conv_id, turn, role, text)")
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(extra)
    return chat.digests(chat.format_paths(chat.linear(rows)))


def op11_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.digests(secrets.scan(table(spark, sf_dir, "documents")))


def op12_resample(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resample.resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")).select("doc_id", "n_features", "weight", "score", "rank")


def op13_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations.collocations(table(spark, sf_dir, "documents"))


def mix_targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What op8_mixing aims at: the sizes and targets of the sources, to a millionth."""
    return mixing.source_targets(table(spark, sf_dir, "documents")).selectExpr("source", "source_size", "round(target, 6) target")


QUERIES = {f.__name__: f for f in (op1_minhash_dedup, op2_quality, op3_exact_dedup, op4_suffix_dedup, op5_decontaminate, op6_lm_scoring, op7_licenses, op8_mixing, op9_html_text, op10_chat, op11_secrets, op12_resample, op13_collocations, mix_targets)}

#: Hashes of all strings of 400 bytes, put together from those of 1, 2, 4 ... 256 bytes: a window frame each.
_DOUBLED = "".join(f"h{2 * n} AS MATERIALIZED (SELECT k, i, c, hash(h, lead(h, {n}) OVER w) AS h, coalesce(lead(g, {n}) OVER w, true) OR g AS g FROM h{n} WINDOW w AS (PARTITION BY k ORDER BY i)),\n" for n in (1, 2, 4, 8, 16, 32, 64, 128))
_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"


def _places(kind: int, pattern: str, group: int = 0) -> str:
    """SQL for the matches of a pattern in texts d: their kind, number, and the pieces that they lie between."""
    return f"SELECT k, {kind} AS kind, regexp_extract_all(text, '{pattern}') AS found, regexp_extract_all(text, '{pattern}', {group}) AS value, regexp_split_to_array(text, '{pattern}') AS pieces FROM d"


def _each(values: list, of: str = "code") -> str:
    return "[" + ", ".join(repr(float(v)) if isinstance(v, float) else repr(v) for v in values) + f"][{of}]"


_MOMENTS = [secrets._change_moments(sizes) for _, sizes in secrets.ENCODINGS]
_QUOTED = secrets.ASSIGN.replace("'", "''")
_SECRETS = rf"""WITH d AS MATERIALIZED (SELECT row_number() OVER () AS k, doc_id, coalesce(text, '') AS text FROM documents),
m AS ({_places(0, _QUOTED, 2)} UNION ALL {_places(1, secrets.ACCESS)} UNION ALL {_places(2, secrets.HEX)} UNION ALL {_places(3, secrets.TOKEN)}),
i AS (SELECT k, kind, found, value, pieces, unnest(range(1, len(found) + 1)) AS i FROM m),
s AS MATERIALIZED (SELECT k, kind, found[i] AS t, len(value[i]) AS n_value, CAST(list_sum(list_transform(pieces[1:i], lambda x: len(x))) + coalesce(list_sum(list_transform(found[1:i - 1], lambda x: len(x))), 0) AS BIGINT) AS first FROM i),
e AS (SELECT *, CASE WHEN regexp_full_match(t, '[0-9]+') THEN 0 WHEN regexp_full_match(t, '[0-9a-f]+|[0-9A-F]+') THEN 1 WHEN regexp_full_match(t, '[A-Z2-7]+') THEN 2 WHEN regexp_full_match(t, '[0-9a-z]+|[0-9A-Z]+') THEN 3 ELSE 4 END AS code FROM s WHERE kind = 3),
a AS (SELECT k, first, t, code, {_each([x for x, _ in secrets.ENCODINGS])} AS abc, CASE WHEN code IN (1, 3) THEN lower(t) WHEN code = 4 THEN translate(t, '-_', '+/') ELSE t END AS u, translate(CASE WHEN code IN (1, 3) THEN lower(t) WHEN code = 4 THEN translate(t, '-_', '+/') ELSE t END, '{secrets._CAPITAL + secrets._SMALL + secrets._DIGITS}/', '{"A" * 26 + "a" * 26 + "0" * 10}+') AS classes FROM e WHERE code > 0),
v AS (SELECT *, list_transform(string_split(u, ''), lambda c: 2 * instr(abc, c) - len(abc) - 1) AS v, list_transform(string_split(abc, ''), lambda c: len(u) - len(replace(u, c, ''))) AS times FROM a),
c AS (SELECT k, first, t, code, len(u)::DOUBLE AS n, len(abc)::DOUBLE AS size, list_sum(list_transform(times, lambda x: x * (x - 1))) / 2.0 AS pairs, (len(regexp_extract_all(classes, 'A+|a+|0+|\++')) - 1)::DOUBLE AS changes, list_sum(list_transform(range(1, len(v)), lambda i: v[i] * v[i + 1]))::DOUBLE AS product, {_each([m[0] for m in _MOMENTS])}::DOUBLE AS q, {_each([m[1] for m in _MOMENTS])}::DOUBLE AS cov, least(len(abc)::DOUBLE, 26.0::DOUBLE) AS letters FROM v),
o AS (SELECT *, n * (n - 1) / 2 AS of_two, {secrets.PAIRS}::DOUBLE / letters AS two, {secrets.TRIPLES}::DOUBLE / (letters * letters) AS three FROM c),
z AS (SELECT *, pow((pairs - of_two / size) / sqrt(of_two / size * (1 - 1 / size)), 2) + pow((changes - (n - 1) * q) / sqrt((n - 1) * q * (1 - q) + 2 * (n - 2) * cov), 2) + pow(product / ((size * size - 1) / 3 * sqrt(n - 1)), 2) < {secrets.RANDOM} AS random,
((of_two * two - pairs) / sqrt(of_two * two * (1 - two) + n * (n - 1) * (n - 2) * (three - two * two)) + (changes - (n - 1) * {secrets.CHANGES}::DOUBLE) / sqrt((n - 1) * ({secrets.CHANGES}::DOUBLE * (1 - {secrets.CHANGES}::DOUBLE)))) / sqrt(2.0::DOUBLE) AS z FROM o),
p AS MATERIALIZED (SELECT k, first, t, random, code * {secrets.BANDS} + least({secrets.BANDS - 1}, CAST(floor(2 * log2(n / 20)) AS INT)) AS key, CASE WHEN z > 0 THEN least({secrets.MOST}, CAST(floor((z * z / 2 + ln(0.656::DOUBLE * z + 0.344::DOUBLE * sqrt(z * z + 5.334::DOUBLE)) + 0.918938533204673::DOUBLE) / 2.302585092994046::DOUBLE * {secrets.STEPS}) AS INT)) ELSE 0 END AS step FROM z),
h AS (SELECT key, step, sum(count(*)) OVER (PARTITION BY key ORDER BY step DESC) AS deeper, sum(count(*)) OVER (PARTITION BY key) AS every FROM p GROUP BY key, step),
l AS (SELECT key, min(step) AS least FROM h WHERE pow(10.0::DOUBLE, -step / {float(secrets.STEPS)}::DOUBLE) * every <= deeper * {secrets.ALPHA}::DOUBLE GROUP BY key),
w AS (SELECT k, kind, first, first + len(t) AS past FROM s WHERE kind IN (1, 2) OR kind = 0 AND n_value >= {secrets.LEAST_VALUE} UNION ALL SELECT k, 3, first, first + len(t) FROM p JOIN l USING (key) WHERE random AND step >= least),
x AS (SELECT k, kind, first, {_each(list(secrets.KINDS), "kind + 1")} || ':' || first || ':' || past AS x FROM w),
g AS (SELECT k, count(*) FILTER (WHERE kind = 0) AS n_assign, count(*) FILTER (WHERE kind = 1) AS n_access, count(*) FILTER (WHERE kind = 2) AS n_hex, string_agg(x, ',' ORDER BY first, kind) FILTER (WHERE kind < 3) AS base, string_agg(x, ',' ORDER BY first, kind) AS spans FROM x GROUP BY k)
SELECT doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex, sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans FROM d LEFT JOIN g USING (k)"""
ORACLES: dict[str, str] = {
    "op11_secrets": _SECRETS,
    "op4_suffix_dedup": f"""WITH t AS MATERIALIZED (SELECT doc_id, row_number() OVER () AS k, hex(encode(coalesce(text, ''))) AS x FROM documents),
h1 AS MATERIALIZED (SELECT k, unnest(range(len(l))) AS i, unnest(l) AS c, hash(unnest(l)) AS h, false AS g FROM (SELECT k, regexp_extract_all(x, '..') AS l FROM t)),
{_DOUBLED}s AS MATERIALIZED (SELECT k, i, c, hash(h, lead(h, 144) OVER w) AS h, coalesce(lead(g, 144) OVER w, true) OR g AS g FROM h256 WINDOW w AS (PARTITION BY k ORDER BY i)),
r AS (SELECT h FROM s WHERE NOT g GROUP BY h HAVING count(*) > 1),
f AS (SELECT k, i, c, NOT g AND r.h IS NOT NULL AS again FROM s LEFT JOIN r ON s.h = r.h),
c AS (SELECT k, i, c, bool_or(again) OVER (PARTITION BY k ORDER BY i ROWS BETWEEN 399 PRECEDING AND CURRENT ROW) AS gone FROM f),
e AS (SELECT *, gone AND NOT coalesce(lag(gone) OVER (PARTITION BY k ORDER BY i), false) AS starts FROM c),
a AS (SELECT k, count(*) FILTER (WHERE gone) AS n_removed, count(*) FILTER (WHERE starts) AS n_spans, string_agg(c, '' ORDER BY i) FILTER (WHERE NOT gone) AS kept FROM e GROUP BY k)
SELECT doc_id, len(x) // 2 AS n_bytes, coalesce(n_removed, 0) AS n_removed, coalesce(n_spans, 0) AS n_spans, sha256(unhex(coalesce(kept, ''))) AS kept_sha256, coalesce(n_removed, 0) > 0 AS repeats FROM t LEFT JOIN a USING (k)""",
    "op5_decontaminate": r"""WITH d AS (SELECT row_number() OVER () AS k, doc_id, list_filter(regexp_split_to_array(lower(coalesce(text, '')), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
i AS (SELECT row_number() OVER () AS q, item_id, list_filter(regexp_split_to_array(lower(coalesce(text, '')), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM benchmark),
ds AS MATERIALIZED (SELECT k, doc_id, w, len(w) AS n, list_transform(range(1, len(w) - 3), lambda x: w[x:x + 4]) AS s FROM d),
bs AS MATERIALIZED (SELECT q, item_id, w, len(w) AS n, list_distinct(list_transform(range(1, len(w) - 3), lambda x: w[x:x + 4])) AS s FROM i WHERE len(w) > 0),
bw AS MATERIALIZED (SELECT *, list_sum(list_transform(s, lambda g: len(list_distinct(g)))) AS weight FROM bs),
c AS MATERIALIZED (SELECT DISTINCT k, q FROM (SELECT k, unnest(s) AS g FROM ds) JOIN (SELECT q, unnest(s) AS g FROM bs) USING (g)),
v AS (SELECT doc_id, item_id, weight, bw.s AS b, p, list_distinct(list_slice(ds.s, p + 1, p + bw.n - 4)) AS a FROM c JOIN ds USING (k) JOIN bw USING (q), unnest(range(ds.n)) AS r(p)),
j AS (SELECT doc_id, item_id, p, weight, list_sum(list_transform(list_intersect(a, b), lambda g: len(list_distinct(g)))) AS shared, list_sum(list_transform(a, lambda g: len(list_distinct(g)))) AS own FROM v WHERE list_has_any(a, b)),
f AS (SELECT doc_id, item_id, p, shared / (own + weight - shared) AS similarity FROM j WHERE shared * 100 >= (own + weight - shared) * 80
UNION ALL SELECT doc_id, item_id, p, 1.0 FROM bs JOIN ds ON bs.n < 5 AND list_has_all(ds.w, bs.w), unnest(range(ds.n - bs.n + 1)) AS r(p) WHERE ds.w[p + 1:p + bs.n] = bs.w)
SELECT doc_id, item_id, max(similarity) AS similarity, arg_max(p, (similarity, -p)) AS "at" FROM f GROUP BY doc_id, item_id""",
    "op12_resample": rf"""WITH RECURSIVE bits(i, k, c) AS (SELECT i, 0, i FROM range(256) r(i) UNION ALL SELECT i, k + 1, CASE WHEN c & 1 = 1 THEN xor(3988292384, c >> 1) ELSE c >> 1 END FROM bits WHERE k < 8),
crc AS MATERIALIZED (SELECT list(c ORDER BY i) AS t FROM bits WHERE k = 8),
d AS (SELECT row_number() OVER () AS k, doc_id, text FROM documents),
texts AS (SELECT k, text FROM d UNION ALL SELECT -1, text FROM benchmark),
w AS (SELECT k, regexp_extract_all({_LOWER}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM texts),
f AS MATERIALIZED (SELECT k, unnest(list_concat(w, list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]))) AS x FROM w),
h AS MATERIALIZED (SELECT x, CAST(xor(list_reduce(list_prepend(CAST(4294967295 AS BIGINT), list_transform(regexp_extract_all(hex(encode(x)), '..'), lambda b: CAST('0x' || b AS BIGINT))), lambda s, b: xor(t[(xor(s, b) & 255) + 1], s >> 8)), 4294967295) % 10000 AS BIGINT) AS b FROM (SELECT DISTINCT x FROM f), crc),
c AS (SELECT b, count(*) FILTER (WHERE k >= 0) AS s, count(*) FILTER (WHERE k < 0) AS t FROM f JOIN h USING (x) GROUP BY b),
n AS (SELECT sum(s) AS s_all, sum(t) AS t_all FROM c),
g AS (SELECT b, CAST(floor(1000 * ln((t + 1)::DOUBLE * (s_all + 10000)::DOUBLE / ((s + 1)::DOUBLE * (t_all + 10000)::DOUBLE))) AS BIGINT) AS gain FROM c, n),
m AS (SELECT k, count(*) AS n_features, CAST(floor(sum(gain)::DOUBLE / count(*)) AS BIGINT) AS weight FROM f JOIN h USING (x) JOIN g USING (b) WHERE k >= 0 GROUP BY k),
z AS (SELECT k, doc_id, coalesce(n_features, 0) AS n_features, coalesce(weight, 0) AS weight, coalesce(weight, 0) + CAST(floor(-1000 * ln(-ln((CAST('0x' || sha256('7:' || coalesce(CAST(doc_id AS VARCHAR), ''))[1:8] AS BIGINT) + 0.5) / 4294967296))) AS BIGINT) AS score FROM d LEFT JOIN m USING (k)),
r AS (SELECT k, row_number() OVER (ORDER BY score DESC, doc_id NULLS LAST, n_features) AS rank, count(*) OVER () AS n FROM z WHERE n_features >= 39)
SELECT doc_id, n_features, weight, score, CASE WHEN rank <= n * 25 // 100 THEN rank END AS rank FROM z LEFT JOIN r USING (k)""",
    "op13_collocations": rf"""WITH p AS (SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array({_LOWER}, '[.,;:!?\x0A-\x0D]')) AS t FROM documents),
w AS MATERIALIZED (SELECT lang, list_filter(regexp_split_to_array(t, '[\x20\x09]+'), lambda x: x <> '') AS w FROM p),
g AS (SELECT lang, k, unnest(list_transform(range(1, len(w) - k + 2), lambda i: array_to_string(w[i:i + k - 1], ' '))) AS phrase FROM w, range(1, 6) r(k)),
f AS MATERIALIZED (SELECT lang, k, phrase, count(*) AS f FROM g GROUP BY ALL HAVING count(*) >= 100),
n AS (SELECT lang, CAST(sum(len(w)) AS BIGINT) AS n FROM w GROUP BY lang),
c AS (SELECT * FROM f WHERE k > 1),
gone AS (SELECT c.lang, c.phrase FROM c JOIN c b ON b.lang = c.lang AND b.k > c.k AND contains(' ' || b.phrase || ' ', ' ' || c.phrase || ' ') AND b.f >= c.f),
alone AS (SELECT * FROM c ANTI JOIN gone USING (lang, phrase)),
x AS (SELECT lang, k, phrase, f AS a, j, array_to_string(string_split(phrase, ' ')[1:j], ' ') AS p1, array_to_string(string_split(phrase, ' ')[j + 1:], ' ') AS p2 FROM alone, range(1, 5) r(j) WHERE j < k),
y AS (SELECT x.lang, x.phrase, a, l.f AS l, r.f AS r, n, j, CAST(1000::HUGEINT * a * n // (l.f::HUGEINT * r.f) AS BIGINT) AS score FROM x JOIN f l ON l.lang = x.lang AND l.phrase = p1 JOIN f r ON r.lang = x.lang AND r.phrase = p2 JOIN n ON n.lang = x.lang),
b AS (SELECT *, row_number() OVER (PARTITION BY lang, phrase ORDER BY score, j) AS cut FROM y),
o AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM b WHERE cut = 1)
SELECT lang, rank, phrase, a, l, r, n, score FROM o WHERE rank <= 2000""",
    "mix_targets": r"""WITH d AS (SELECT source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS size FROM documents),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM d GROUP BY source),
w AS (SELECT *, 2.0 * source_size AS cap, [3, 1, 2][(row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1] AS weight FROM s),
o AS (SELECT *, row_number() OVER (ORDER BY cap / weight, source NULLS LAST) AS k FROM w),
l AS (SELECT *, (1.5 * sum(source_size) OVER () - coalesce(sum(cap) OVER b, 0)) / (sum(weight) OVER () - coalesce(sum(weight) OVER b, 0)) AS level FROM o WINDOW b AS (ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
m AS (SELECT coalesce(arg_min(level, k), 'infinity'::DOUBLE) AS level FROM l WHERE level <= cap / weight)
SELECT source, source_size, round(least(cap, weight * m.level), 6) AS target FROM o, m""",
    "op3_exact_dedup": f"""WITH t AS (SELECT doc_id, sha256({_LOWER}) AS text_sha256 FROM documents)
SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size, doc_id = max(doc_id) OVER w AS kept, text_sha256 FROM t WINDOW w AS (PARTITION BY text_sha256)""",
    "op1_minhash_dedup": f"""WITH RECURSIVE w AS (SELECT doc_id, list_filter(regexp_split_to_array({_LOWER}, '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws FROM documents),
s AS (SELECT doc_id, list_distinct(CASE WHEN len(ws) = 0 THEN []::VARCHAR[] WHEN len(ws) < 4 THEN [array_to_string(ws, ' ')] ELSE list_transform(range(1, len(ws) - 2), lambda i: array_to_string(ws[i:i+3], ' ')) END) AS sh FROM w),
c AS MATERIALIZED (SELECT doc_id, len(sh) AS n, min(doc_id) OVER (PARTITION BY list_sort(sh)) AS rep, sh FROM s),
x AS MATERIALIZED (SELECT doc_id, n, unnest(sh) AS h FROM c WHERE doc_id = rep),
f AS MATERIALIZED (SELECT h, count(*) AS df FROM x GROUP BY h HAVING count(*) > 1),
r AS MATERIALIZED (SELECT doc_id, n, x.h, row_number() OVER (PARTITION BY doc_id ORDER BY coalesce(df, 1), x.h) AS k FROM x LEFT JOIN f USING (h)),
p AS MATERIALIZED (SELECT DISTINCT a.doc_id AS u, b.doc_id AS v FROM r a JOIN r b ON a.h = b.h AND a.doc_id < b.doc_id WHERE 5 * (a.k - 1) <= a.n AND 5 * (b.k - 1) <= b.n AND 5 * a.n >= 4 * b.n AND 5 * b.n >= 4 * a.n),
i AS (SELECT u, v, count(*) AS common FROM p JOIN x a ON a.doc_id = u JOIN x b ON b.doc_id = v AND a.h = b.h GROUP BY u, v),
l AS MATERIALIZED (SELECT u, v FROM i JOIN (SELECT doc_id AS du, n AS nu FROM c) ON du = u JOIN (SELECT doc_id AS dv, n AS nv FROM c) ON dv = v WHERE 100 * common >= 80 * (nu + nv - common)),
e AS MATERIALIZED (SELECT u, v FROM l UNION ALL SELECT v, u FROM l),
z(a, b) AS (SELECT u, u FROM e UNION SELECT z.a, e.v FROM z JOIN e ON z.b = e.u),
m AS (SELECT a, min(b) AS low FROM z GROUP BY a)
SELECT c.doc_id, CAST(c.n AS BIGINT) AS n_shingles, CASE WHEN c.n = 0 THEN c.doc_id ELSE coalesce(m.low, c.rep) END AS component_id, c.doc_id = CASE WHEN c.n = 0 THEN c.doc_id ELSE coalesce(m.low, c.rep) END AS kept FROM c LEFT JOIN m ON m.a = c.rep""",
    "op10_chat": r"""WITH c AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations UNION ALL SELECT -7, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -7, 1, 'assistant', '</s>[INST] ok [/INST]'),
e AS (SELECT *, regexp_replace(text, '([<\[])(\\*)(/?(?:s>|INST\]|SYS\]|OUT\]|ROLE))', '\1\2\\\3', 'g') AS esc FROM c)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
length(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (WHERE role = 'assistant'), '')) AS loss_chars,
sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
CAST(sum(length(esc) + 3 + 4 + CASE role WHEN 'user' THEN 7 WHEN 'system' THEN 6 WHEN 'assistant' THEN 6 ELSE 8 + length(hex(encode(role))) END) AS BIGINT) AS formatted_chars FROM e GROUP BY conv_id""",
}
