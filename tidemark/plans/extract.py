"""Registered extraction, merging and rule queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.functions import extract as X
from tidemark import registry
from tidemark.session import table


def _texts(s, d):
    """Every document as it is, and a notice of each order with dates, amounts, addresses and names, which the documents seldom hold."""
    orders, customer = table(s, d, "orders"), table(s, d, "customer")
    told = orders.join(customer, F.col("o_custkey") == F.col("c_custkey"))
    notice = F.concat(
        F.lit("Order of "), F.date_format("o_orderdate", "d.M.yyyy"), F.lit(", due 45.13.2020 or "), F.date_format("o_orderdate", "yyyy-MM-dd"), F.lit(": $"), F.format_number("o_totalprice", 2), F.lit(" or "),
        F.translate(F.format_number("o_totalprice", 2), ",.", ".,"), F.lit(" EUR. Ship to "), F.col("o_custkey"), F.lit(" Main Street, Springfield, IL 62701 or Bahnhofstraße "), F.col("c_nationkey"), F.lit(", 10115 Berlin. C"), F.col("c_custkey"), F.lit(" works for M"), F.col("c_mktsegment"), F.lit(" and owns it."),
    )
    return table(s, d, "documents").select(F.concat(F.lit("d"), "doc_id").alias("id"), "text").unionByName(told.select(F.concat(F.lit("o"), "o_orderkey").alias("id"), notice.alias("text")))


TEXTS = """SELECT 'd' || doc_id AS id, text FROM documents UNION ALL SELECT 'o' || o_orderkey, 'Order of ' || day(o_orderdate) || '.' || month(o_orderdate) || '.' || year(o_orderdate) || ', due 45.13.2020 or ' || strftime(o_orderdate, '%Y-%m-%d') || ': $' || format('{:,.2f}', o_totalprice)
    || ' or ' || translate(format('{:,.2f}', o_totalprice), ',.', '.,') || ' EUR. Ship to ' || o_custkey || ' Main Street, Springfield, IL 62701 or Bahnhofstraße ' || c_nationkey || ', 10115 Berlin. C' || c_custkey || ' works for M' || c_mktsegment || ' and owns it.' FROM orders JOIN customer ON o_custkey = c_custkey"""


def query(name, run, sql=None):
    registry.query(name, run, sql and sql.replace("{TEXTS}", TEXTS))


_numbers = "[" + ", ".join(repr(w) for w in X.ONES) + "]"
_tens = "[" + ", ".join(repr(w) for w in X.TENS) + "]"
_said = f"CASE WHEN n < 20 THEN ({_numbers})[n + 1] ELSE ({_tens})[n // 10 - 1] || CASE WHEN n % 10 > 0 THEN '-' || ({_numbers})[n % 10 + 1] ELSE '' END END"
#: Pieces of a text: what a pattern matches, and what lies between; odd places hold the gaps.
_pieces = lambda p: f"SELECT doc_id, list_concat(flatten(list_transform(range(1, len(g)), lambda i: [g[i], m[i]])), [g[-1]]) AS l FROM (SELECT doc_id, string_split_regex(text, '{p}') AS g, regexp_extract_all(text, '{p}') AS m FROM documents)"
query(
    "h13_spoken_numbers",
    lambda s, d: table(s, d, "documents").select("doc_id", F.md5(X.spoken_numbers(F.col("text"))).alias("text_md5")),
    rf"WITH p AS ({_pieces(X.SHORT_NUMBER)}), e AS (SELECT doc_id, unnest(l) AS x, generate_subscripts(l, 1) AS i FROM p), w AS (SELECT *, CASE WHEN i % 2 = 0 THEN CAST(x AS BIGINT) END AS n FROM e) SELECT doc_id, md5(string_agg(CASE WHEN n IS NULL THEN x ELSE {_said} END, '' ORDER BY i)) AS text_md5 FROM w GROUP BY 1",
)
_months = "[" + ", ".join(repr(m) for m in X.MONTHS) + "]"
query(
    "h14_spoken_dates",
    lambda s, d: table(s, d, "orders").select("o_orderkey", X.spoken_dates(F.concat(F.lit("on "), F.date_format("o_orderdate", "M/d/yyyy"), F.lit("!"))).alias("text")),
    "SELECT o_orderkey, 'on ' || strftime(o_orderdate, '%B ') || CAST(day(o_orderdate) AS VARCHAR) || ', ' || CAST(year(o_orderdate) AS VARCHAR) || '!' AS text FROM orders",
)
query(
    "h19_balanced_tags",
    lambda s, d: table(s, d, "pages").select("page_id", X.tags_balance(F.col("html")).alias("balanced")),
    r"""WITH RECURSIVE d AS (SELECT page_id, regexp_extract_all(html, '<(/?[A-Za-z][\w:-]*)(?:[^>]*[^>/])?>', 1) AS t FROM pages),
    r(page_id, i, open, good) AS (SELECT page_id, 0, []::VARCHAR[], true FROM d UNION ALL
      SELECT page_id, i + 1, CASE WHEN x NOT LIKE '/%' THEN list_append(open, x) WHEN len(open) > 0 AND open[-1] = substr(x, 2) THEN open[1:len(open) - 1] ELSE open END, good AND (x NOT LIKE '/%' OR (len(open) > 0 AND open[-1] = substr(x, 2))) FROM (SELECT r.*, t[r.i + 1] AS x FROM r JOIN d USING (page_id) WHERE r.i < len(t)))
    SELECT page_id, good AND len(open) = 0 AS balanced FROM r JOIN d USING (page_id) WHERE i = len(t)""",
)
_iso = "CASE WHEN day BETWEEN 1 AND 31 AND month BETWEEN 1 AND 12 AND year >= 1900 THEN format('{:04d}-{:02d}-{:02d}', year, month, day) END"
query(
    "h21_iso_dates",
    lambda s, d: _texts(s, d).select("id", F.explode(X.dates(F.col("text"))).alias("day")),
    rf"""WITH t AS ({{TEXTS}}), m AS (SELECT id, unnest(regexp_extract_all(text, '\d{{4}}-\d{{1,2}}-\d{{1,2}}|\d{{1,2}}[.-]\d{{1,2}}[.-]\d{{4}}')) AS m FROM t),
    f AS (SELECT id, CASE WHEN regexp_matches(m, '^\d{{4}}') THEN list_reverse(f) ELSE f END AS f FROM (SELECT id, m, list_transform(regexp_split_to_array(m, '[.-]'), lambda x: CAST(x AS INTEGER)) AS f FROM m)),
    p AS (SELECT id, f[1] AS day, f[2] AS month, f[3] AS year FROM f) SELECT id, {_iso} AS day FROM p WHERE {_iso} IS NOT NULL""",
)
_amount = r"\$\s*\d{1,3}(?:,\d{3})*\.\d{2}|\d{1,3}(?:[.,]\d{3})*[.,]\d{2}\s*(?:€|Euro\b|[A-Z]{3}\b)"
query(
    "h22_amounts",
    lambda s, d: _texts(s, d).select("id", F.explode(X.amounts(F.col("text"))).alias("a")).select("id", "a.*"),
    f"""WITH t AS ({{TEXTS}}), m AS (SELECT id, unnest(regexp_extract_all(text, '{_amount}')) AS a FROM t)
    SELECT id, CAST(regexp_replace(a, '[^0-9]', '', 'g') AS BIGINT) / 100 AS value, CASE WHEN contains(a, '$') THEN 'USD' WHEN regexp_matches(a, '€|Euro') THEN 'EUR' ELSE regexp_extract(a, '([A-Z]{{3}})', 1) END AS currency FROM m""",
)
query("h25_addresses", lambda s, d: _texts(s, d).select("id", F.explode(X.addresses(F.col("text"))).alias("address")), f"WITH t AS ({{TEXTS}}) SELECT id, unnest(list_concat(regexp_extract_all(text, '{X.GERMAN_ADDRESS}'), regexp_extract_all(text, '{X.US_ADDRESS}'))) AS address FROM t")
query(
    "h94_structure",
    lambda s, d: table(s, d, "documents").select("doc_id", X.structure(F.col("text")).alias("s")).select("doc_id", "s.title", "s.paragraphs"),
    "SELECT doc_id, CASE WHEN length(trim(l[1], ' ')) < 100 AND trim(l[1], ' ') <> '' THEN trim(l[1], ' ') END AS title, CAST(len(list_filter(l, lambda x: length(x) > 100)) AS INTEGER) AS paragraphs FROM (SELECT doc_id, string_split(text, chr(10)) AS l FROM documents)",
)
query(
    "d08_syntactic_pairs",
    lambda s, d: _texts(s, d).select("id", F.explode(X.syntactic_pairs(F.col("text"))).alias("p")).select("id", "p.*"),
    "WITH t AS ({TEXTS}) " + " UNION ALL ".join(f"SELECT id, '{k}' AS kind, unnest(regexp_extract_all(text, '{p}', 1)) AS source, unnest(regexp_extract_all(text, '{p}', 2)) AS target FROM t" for k, p in X.SYNTAX.items()),
)
query(
    "d28_filled_properties",
    lambda s, d: table(s, d, "part").select("p_partkey", X.filled(F.when(F.col("p_size") > 25, F.create_map(F.lit("size"), F.lit("large"))).otherwise(F.create_map(F.lit("brand"), F.lit("own"))), F.create_map(F.lit("brand"), F.col("p_brand"), F.lit("size"), F.lit("small"))).alias("m")).select("p_partkey", F.col("m")["brand"].alias("brand"), F.col("m")["size"].alias("size")),
    "SELECT p_partkey, CASE WHEN p_size > 25 THEN p_brand ELSE 'own' END AS brand, CASE WHEN p_size > 25 THEN 'large' ELSE 'small' END AS size FROM part",
)
query(
    "h41_property_similarity",
    lambda s, d: table(s, d, "lineitem").select("l_orderkey", "l_linenumber", F.round(X.property_similarity(F.create_map(F.lit("q"), F.col("l_quantity"), F.lit("t"), F.col("l_tax")), F.create_map(F.lit("q"), F.lit(25.0), F.lit("x"), F.lit(1.0))), 9).alias("similarity")),
    "SELECT l_orderkey, l_linenumber, round(1 - abs(l_quantity - 25) / greatest(abs(l_quantity), 25), 9) AS similarity FROM lineitem",
)
query(
    "c18_configured_providers",
    lambda s, d: table(s, d, "events").select("event_id", X.configured(F.when(F.col("event_type") == "click", "api").when(F.col("event_type") == "view", "files").otherwise("none"), F.replace("props", F.lit('"k"'), F.lit('"path"'))).alias("ready")),
    "SELECT event_id, event_type <> 'click' AS ready FROM events",
)
query(
    "h82_preprocessing",
    lambda s, d: table(s, d, "part").select("p_partkey", X.preprocessing(F.col("p_size") / 50, F.col("p_retailprice") / 2000, (F.col("p_size") % 10) / 10).alias("p")).select("p_partkey", F.array_join("p.issues", ",").alias("issues"), "p.strategy"),
    "WITH i AS (SELECT p_partkey, list_filter([CASE WHEN p_size / 50 < 0.5 THEN 'sharpen' END, CASE WHEN p_retailprice / 2000 < 0.4 THEN 'raise_contrast' END, CASE WHEN (p_size % 10) / 10 > 0.3 THEN 'denoise' END], lambda x: x IS NOT NULL) AS l FROM part) SELECT p_partkey, coalesce(array_to_string(l, ','), '') AS issues, CASE len(l) WHEN 0 THEN 'none' WHEN 1 THEN 'light' ELSE 'full' END AS strategy FROM i",
)
