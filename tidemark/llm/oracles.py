"""DuckDB SQL for the corpus operators that SQL can express."""

from __future__ import annotations

from tidemark.llm import quality
from tidemark.llm.common import WORD

_BLANK = r"[\x20\x09-\x0D]"

TOP_K = """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(1024 * CAST(x AS DOUBLE))) AS v FROM embeddings WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
  AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0),
p AS (SELECT q.vec_id AS query_id, c.vec_id, CAST(list_dot_product(q.v, c.v) AS BIGINT) AS score FROM v q JOIN v c ON q.vec_id % 100 = 0 AND c.vec_id <> q.vec_id),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM p)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM r WHERE rank <= 10
"""

_QUARTILES = ", ".join(f"CAST(min(bucket) FILTER (WHERE seen > floor({p} * (n - 1))) AS DOUBLE) AS q{i}" for i, p in enumerate((0.25, 0.75)))
_DRAWN = ", ".join(f"(o.n * o.q{i} + 100 * ((g.n * g.q{i} + 100 * a.q{i}) / (g.n + 100))) / (o.n + 100) AS q{i}" for i in range(2))

QUALITY = rf"""
WITH d AS (SELECT doc_id, coalesce(lang, '') AS l, coalesce(source, '') AS s, coalesce(text, '') AS t FROM documents),
w AS (SELECT *, regexp_extract_all(t, '{WORD}') AS words, list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '{WORD}')) AS lines FROM d),
e AS (SELECT doc_id, unnest(words) AS word, generate_subscripts(words, 1) AS i FROM w),
g AS (SELECT doc_id, i, word || ' ' || lead(word, 1) OVER o || ' ' || lead(word, 2) OVER o AS g FROM e WINDOW o AS (PARTITION BY doc_id ORDER BY i)),
c AS (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, g) AS n FROM g WHERE g IS NOT NULL),
r AS (SELECT doc_id, count(DISTINCT pos) AS n FROM (SELECT doc_id, unnest([i, i + 1, i + 2]) AS pos FROM c WHERE n > 1) GROUP BY 1),
m AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM (SELECT w.doc_id, l, s, len(words) AS n_words, length(regexp_replace(t, '{_BLANK}', '', 'g')) AS word_chars, length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) AS n_symbols,
    len(lines) - len(list_distinct(lines)) AS n_dup_lines, coalesce(r.n, 0) AS n_repeat_words, len(lines) AS n_lines FROM w LEFT JOIN r USING (doc_id))),
x AS (SELECT doc_id, l, s, unnest(['word_len', 'symbol_share', 'dup_line_share', 'repeat_share']) AS measure,
    unnest([word_chars / n_words, (n_symbols + 0.5::DOUBLE) / (n_words + 1), (n_dup_lines + 0.5::DOUBLE) / (n_lines + 1), (n_repeat_words + 0.5::DOUBLE) / (n_words + 1)]) AS x FROM m WHERE NOT base_failed),
k AS (SELECT doc_id, l, s, measure, CAST(ceil(round(ln(x) / CAST({quality.BUCKET!r} AS DOUBLE), 6)) AS INTEGER) AS bucket FROM x),
lv AS (SELECT 0 AS level, l, s, measure, bucket FROM k UNION ALL SELECT 1, l, '', measure, bucket FROM k UNION ALL SELECT 2, '', '', measure, bucket FROM k),
b AS (SELECT level, l, s, measure, bucket, count(*) AS n FROM lv GROUP BY ALL),
u AS (SELECT level, l, s, measure, bucket, sum(n) OVER (PARTITION BY level, l, s, measure ORDER BY bucket) AS seen, CAST(sum(n) OVER (PARTITION BY level, l, s, measure) AS BIGINT) AS n FROM b),
q AS (SELECT level, l, s, measure, n, {_QUARTILES} FROM u GROUP BY level, l, s, measure, n),
f AS (SELECT o.l, o.s, o.measure, 3.0::DOUBLE * (1 + 100 / a.n) AS wide, {_DRAWN} FROM q o JOIN q g ON o.level = 0 AND g.level = 1 AND g.l = o.l AND g.measure = o.measure JOIN q a ON a.level = 2 AND a.measure = o.measure),
z AS (SELECT l, s, measure, q1 + wide * (q1 - q0 + 1) AS high, CASE WHEN measure = '{quality.TWO_SIDED}' THEN q0 - wide * (q1 - q0 + 1) END AS low FROM f),
o AS (SELECT doc_id FROM k JOIN z USING (l, s, measure) WHERE bucket > high OR bucket < low)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND doc_id NOT IN (SELECT doc_id FROM o) AS kept FROM m
"""

_ENTROPY = "ln(list_sum(list_transform(p, lambda x: exp({a} * ln(x))))) - {a} * list_sum(list_transform(p, lambda x: exp({a} * ln(x)) * ln(x))) / list_sum(list_transform(p, lambda x: exp({a} * ln(x))))"
_OFTEN = "list_max(list_transform(p, lambda x: exp(({a} - 1) * ln(x)))) / list_sum(list_transform(p, lambda x: exp({a} * ln(x))))"
_TOO_FLAT = {"e": f"{_ENTROPY} > 0.95 * ln(len(p))", "o": f"{_OFTEN} > 4.0"}


def _bisected(name: str) -> str:
    flat = _TOO_FLAT[name].format(a="mid")
    return f"""b{name}(i, low, high) AS (SELECT 0, 0.0::DOUBLE, 1.0::DOUBLE UNION ALL
    SELECT i + 1, CASE WHEN flat THEN mid ELSE low END, CASE WHEN flat THEN high ELSE mid END FROM (SELECT i, low, high, mid, {flat} AS flat FROM (SELECT *, (low + high) / 2 AS mid FROM b{name} WHERE i < 50), shares)),
  a{name} AS (SELECT CASE WHEN {_TOO_FLAT[name].format(a='0.0::DOUBLE')} THEN high ELSE 0.0 END AS a FROM b{name}, shares WHERE i = 50)"""


_HASH = "CAST('0x' || substr(md5({text}), 1, 15) AS BIGINT)"
MIXTURE = rf"""
WITH RECURSIVE tok AS (SELECT doc_id, coalesce(source, '') AS s, len(regexp_extract_all(coalesce(text, ''), '{WORD}')) AS n FROM documents),
  tot AS (SELECT s, CAST(sum(n) AS BIGINT) AS tokens, count(*) AS docs FROM tok GROUP BY 1),
  every AS (SELECT CAST(sum(tokens) AS BIGINT) AS total FROM tot),
  shares AS (SELECT list(CAST(tokens AS DOUBLE) / total ORDER BY s) AS p FROM tot, every WHERE tokens > 0),
  {_bisected("e")},
  {_bisected("o")},
  mix AS (SELECT greatest(ae.a, ao.a) AS a, list_sum(list_transform(p, lambda x: exp(greatest(ae.a, ao.a) * ln(x)))) AS z FROM ae, ao, shares),
  goal AS (SELECT s, tokens, CAST(ceil(docs / 1024) AS BIGINT) AS blocks, CASE WHEN tokens > 0 THEN CAST(floor(exp(a * ln(tokens / CAST(total AS DOUBLE))) / z * CAST(total AS DOUBLE) + 1e-6) AS BIGINT) ELSE 0 END AS goal FROM tot, every, mix),
  full_ AS (SELECT *, CASE WHEN tokens > 0 THEN goal // tokens ELSE 1 END AS fully, CASE WHEN tokens > 0 THEN goal % tokens ELSE 0 END AS rest FROM goal),
  dealt AS (SELECT tok.*, {_HASH.format(text="'mix|' || tok.s || '|' || coalesce(CAST(doc_id AS VARCHAR), '~')")} AS h FROM tok),
  own AS (SELECT dealt.*, h % blocks AS block, fully, rest FROM dealt JOIN full_ USING (s)),
  sums AS (SELECT s, block, fully, rest, CAST(sum(n) AS BIGINT) AS n, {_HASH.format(text="'mix|' || s || '|' || fully || '|' || block")} AS o FROM own GROUP BY 1, 2, 3, 4),
  ranked AS (SELECT *, row_number() OVER w - 1 AS place, rest - (sum(n) OVER w - n) AS room FROM sums WINDOW w AS (PARTITION BY s ORDER BY o, block)),
  part AS (SELECT own.*, place, room, sums_n, sum(own.n) OVER (PARTITION BY own.s, own.block ORDER BY h) AS upto FROM own JOIN (SELECT s, block, place, room, n AS sums_n FROM ranked) USING (s, block)),
  copies AS (SELECT *, fully + CASE WHEN room > 0 AND (room >= sums_n OR upto <= room) THEN 1 ELSE 0 END AS times FROM part)
SELECT doc_id, s AS source, n AS n_tokens, e AS epoch, block, CAST(CASE WHEN e = fully THEN place END AS INTEGER) AS place FROM (SELECT *, unnest(range(CAST(times AS BIGINT))) AS e FROM copies)
"""

#: CRC-32 by its table of 256 words, over the distinct features; the benchmark's texts are the rows without a place.
RESAMPLING = r"""
WITH d AS (SELECT row_number() OVER () AS i, doc_id, text FROM documents), a AS (SELECT i, doc_id, text FROM d UNION ALL SELECT NULL, NULL, text FROM benchmark),
w AS (SELECT i, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM a),
f AS (SELECT i, f, count(*) AS n FROM (SELECT i, unnest(list_concat(w, list_transform(range(1, len(w)), lambda j: concat_ws(' ', w[j], w[j + 1])), list_transform(range(1, len(w) - 1), lambda j: concat_ws(' ', w[j], w[j + 1], w[j + 2])))) AS f FROM w) GROUP BY 1, 2),
slots AS (SELECT list_transform(range(256), lambda b: list_reduce(list_concat([b], range(8)), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)) AS slot),
h AS (SELECT f, hex(encode(f)) AS h, slot FROM (SELECT DISTINCT f FROM f), slots),
b AS (SELECT f, xor(list_reduce(list_concat([4294967295], list_transform(range(len(h) // 2), lambda j: CAST('0x' || substr(h, 2 * j + 1, 2) AS BIGINT))), lambda c, x: xor(c >> 8, slot[1 + (xor(c, x) & 255)])), 4294967295) % 10000 AS bucket FROM h),
g AS (SELECT i, bucket, sum(n) AS n FROM f JOIN b USING (f) GROUP BY 1, 2),
st AS (SELECT bucket, coalesce(sum(n) FILTER (WHERE i IS NOT NULL), 0) AS s, coalesce(sum(n) FILTER (WHERE i IS NULL), 0) AS t FROM g GROUP BY 1),
gain AS (SELECT bucket, CAST(floor(1000.0::DOUBLE * ln(CAST(t + 1 AS DOUBLE) * CAST(all_s + 10000 AS DOUBLE) / (CAST(s + 1 AS DOUBLE) * CAST(all_t + 10000 AS DOUBLE)))) AS BIGINT) AS gain FROM st, (SELECT sum(s) AS all_s, sum(t) AS all_t FROM st)),
u AS (SELECT i, CAST(sum(n) AS BIGINT) AS n_features, CAST(sum(n * gain) AS BIGINT) AS weight FROM g JOIN gain USING (bucket) WHERE i IS NOT NULL GROUP BY 1),
v AS (SELECT w.i, w.doc_id, len(w.w) >= 20 AS able, coalesce(n_features, 0) AS n_features, coalesce(weight, 0) AS weight,
  coalesce(weight, 0) + CAST(floor(-1000.0::DOUBLE * ln(-ln((CAST(CAST('0x' || substr(sha256('42:' || coalesce(CAST(w.doc_id AS VARCHAR), '')), 1, 8) AS BIGINT) AS DOUBLE) + 0.5::DOUBLE) / 4294967296.0::DOUBLE))) AS BIGINT) AS score FROM w LEFT JOIN u USING (i) WHERE w.i IS NOT NULL),
r AS (SELECT i, row_number() OVER (ORDER BY score DESC, doc_id NULLS LAST, i) AS rank, count(*) OVER () AS n FROM v WHERE able)
SELECT doc_id, n_features, weight, score, CASE WHEN rank <= 5 * n // 100 THEN rank END AS rank FROM v LEFT JOIN r USING (i)
"""
