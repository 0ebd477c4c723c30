"""Registered text queries over documents, benchmark, pages, conversations and the star schema."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tidemark.functions import text as T
from tidemark.registry import query
from tidemark.session import table
from tidemark.sources import readers


def _column(name: str, source: str, key: str, column, sql: str, label: str = "out") -> None:
    run = lambda spark, sf: table(spark, sf, source).select(key, column().alias(label))
    query(name, run, f"SELECT {key}, {sql} AS {label} FROM {source}")


_text = lambda: F.col("text")
_column(
    "h01_snippet",
    "documents",
    "doc_id",
    lambda: T.snippet(_text(), "tion"),
    "CASE WHEN strpos(lower(text), 'tion') > 0 THEN CASE WHEN strpos(lower(text), 'tion') - 1 - 100 > 0 THEN '...' ELSE '' END || substr(text, CAST(greatest(0, strpos(lower(text), 'tion') - 101) + 1 AS BIGINT), CAST(least(length(text), strpos(lower(text), 'tion') + 103) - greatest(0, strpos(lower(text), 'tion') - 101) AS BIGINT)) || CASE WHEN strpos(lower(text), 'tion') + 103 < length(text) THEN '...' ELSE '' END WHEN length(text) > 200 THEN substr(text, 1, 200) || '...' ELSE text END",
)
query(
    "h02_file_score",
    lambda spark, sf: table(spark, sf, "documents").select("doc_id", F.round(T.file_score(F.col("source"), _text(), "the"), 6).alias("score")).orderBy(F.desc("score"), "doc_id").limit(50),
    "SELECT doc_id, round(CASE WHEN contains(lower(source), 'the') THEN 3.0 ELSE 0.0 END + least(1.0, ((length(lower(text)) - length(replace(lower(text), 'the', ''))) // 3) / 10) + (1.0 - (strpos(lower(text), 'the') - 1) / greatest(1, length(text))), 6) AS score FROM documents ORDER BY score DESC, doc_id LIMIT 50",
)
query(
    "h03_highlights",
    lambda spark, sf: table(spark, sf, "documents")
    .select("doc_id", F.explode(F.array(*map(F.lit, ("thing", "une")))).alias("term"), F.lower("text").alias("low"))
    .select("doc_id", "term", F.size(F.split("low", F.col("term"), -1)).alias("n"), F.instr("low", F.col("term")).alias("first"))
    .filter("n > 1")
    .select("doc_id", "term", (F.col("n") - 1).alias("hits"), (F.col("first") - 1).alias("first_start")),
    """SELECT doc_id, term, CAST((length(lower(text)) - length(replace(lower(text), term, ''))) // length(term) AS INTEGER) AS hits, CAST(strpos(lower(text), term) - 1 AS INTEGER) AS first_start
    FROM documents, (VALUES ('thing'), ('une')) t(term) WHERE contains(lower(text), term)""",
)
query(
    "h04_key_terms",
    lambda spark, sf: table(spark, sf, "documents").select(F.explode(T.key_terms(_text())).alias("term")).groupBy("term").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "term").limit(100),
    f"WITH t AS (SELECT unnest(regexp_extract_all(lower(text), '{T.WORD}')) AS term FROM documents) SELECT term, count(*) AS n FROM t WHERE length(term) > 2 AND term NOT IN ({', '.join(repr(w) for w in T.STOP_WORDS)}) GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 100",
)
query(
    "h05_capitalised_runs",
    lambda spark, sf: table(spark, sf, "customer").select("c_custkey", F.explode(T.capitalised_runs(F.concat_ws(" ", "c_name", "c_mktsegment"))).alias("mention")),
    r"SELECT c_custkey, unnest(regexp_extract_all(concat_ws(' ', c_name, c_mktsegment), '\b[A-Z][a-zA-Z]*(?:\s+[A-Z][a-zA-Z]*)*\b')) AS mention FROM customer",
)


def _passages(spark, sf):
    """Sentences of ten characters or more by their share of the query's words, the best three of each document."""
    wanted = F.array(*map(F.lit, ("and", "for", "the", "thing")))
    each = table(spark, sf, "documents").select("doc_id", F.posexplode(T.sentences(_text())).alias("pos", "sentence")).filter(F.length(F.trim("sentence")) >= 10)
    scored = each.withColumn("score", F.size(F.array_intersect(T.terms(F.col("sentence")), wanted)) / 4)
    w = Window.partitionBy("doc_id").orderBy(F.desc("score"), "pos")
    return scored.withColumn("rank", F.row_number().over(w)).filter("rank <= 3").select("doc_id", "rank", "sentence", "score")


query(
    "h06_key_passages",
    _passages,
    r"""WITH s AS (SELECT doc_id, string_split(regexp_replace(text, '([.!?])\s+', '\1' || chr(1), 'g'), chr(1)) AS l FROM documents),
    e AS (SELECT doc_id, unnest(l) AS sentence, generate_subscripts(l, 1) AS pos FROM s),
    r AS (SELECT *, len(list_intersect(list_distinct(regexp_split_to_array(lower(sentence), '\s+')), ['and', 'for', 'the', 'thing'])) / 4 AS score FROM e WHERE length(trim(sentence, ' ')) >= 10),
    k AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY score DESC, pos) AS rank FROM r)
    SELECT doc_id, CAST(rank AS INTEGER) AS rank, sentence, score FROM k WHERE rank <= 3""",
)
query(
    "h08_relevant_chunks",
    lambda spark, sf: table(spark, sf, "documents").select("doc_id", F.round(T.chunk_score(_text(), "thing with this there", F.col("doc_id") % 2 == 0), 6).alias("score")).orderBy(F.desc("score"), "doc_id").limit(10),
    "SELECT doc_id, round((CAST(contains(lower(text), 'there') AS INTEGER) + CAST(contains(lower(text), 'thing') AS INTEGER) + CAST(contains(lower(text), 'this') AS INTEGER) + CAST(contains(lower(text), 'with') AS INTEGER)) * CASE WHEN doc_id % 2 = 0 THEN 1.2::DOUBLE ELSE 1.0::DOUBLE END, 6) AS score FROM documents ORDER BY score DESC, doc_id LIMIT 10",
)
_column("h11_normalised", "documents", "doc_id", lambda: F.md5(T.normalised(_text())), r"md5(trim(regexp_replace(nfc_normalize(lower(text)), '\s+', ' ', 'g'), ' '))")
_expanded_sql = "text"
for _short, _full in (T.ABBREVIATIONS | {"the": "THE one"}).items():
    _expanded_sql = f"replace({_expanded_sql}, '{_short}', '{_full}')"
_column("h12_expanded", "documents", "doc_id", lambda: F.md5(T.expanded(_text(), {"the": "THE one"})), f"md5({_expanded_sql})")
query("h20_cache_key", lambda spark, sf: table(spark, sf, "conversations").select("conv_id", "turn", T.cache_key(_text(), F.col("role"), "rate=1").alias("key")), r"SELECT conv_id, turn, md5(trim(regexp_replace(lower(text), '\s+', ' ', 'g'), ' ') || '|' || role || '|rate=1') AS key FROM conversations")
_first = lambda patterns: "coalesce(" + ", ".join(f"nullif(regexp_extract(text, '{p}', 1), '')" for p in patterns) + ")"
_column("h23_invoice_number", "documents", "doc_id", lambda: T.first_match(_text(), T.INVOICE), _first(T.INVOICE))
_column("h24_vat_number", "documents", "doc_id", lambda: T.first_match(_text(), T.VAT), _first(T.VAT))


def _contains(word: str) -> str:
    quoted = word.replace("'", "''")
    return f"CAST(contains(lower(text), '{quoted}') AS INTEGER)"


_kinds = ", ".join(f"({i}, '{k}', {' + '.join(map(_contains, words))})" for i, (k, words) in enumerate(T.KINDS.items()))
query(
    "h26_document_kind",
    lambda spark, sf: table(spark, sf, "documents").select("doc_id", T.document_kind(_text()).alias("k")).select("doc_id", "k.*"),
    f"""WITH s AS (SELECT doc_id, (SELECT arg_max(k, n * 10 - i) FROM (VALUES {_kinds}) v(i, k, n)) AS kind, (SELECT max(n) FROM (VALUES {_kinds}) v(i, k, n)) AS best FROM documents)
    SELECT doc_id, CASE WHEN best = 0 THEN 'unknown' ELSE kind END AS kind, round(least(1.0, best / ({sum(map(len, T.KINDS.values()))} * 0.2)), 6) AS confidence FROM s""",
)
_column("h29_text_confidence", "documents", "doc_id", lambda: T.text_confidence(_text(), 5000), "(CASE WHEN trim(text, ' ') <> '' THEN 4 ELSE 0 END + CASE WHEN length(text) BETWEEN 10 AND 5000 THEN 3 ELSE 0 END + CASE WHEN contains(text, '.') THEN 3 ELSE 0 END) / 10")


def _against_next(spark, sf, score):
    """Each document against the one with the next number: an equi-join."""
    docs = table(spark, sf, "documents").select("doc_id", "text")
    return docs.join(docs.select((F.col("doc_id") - 1).alias("doc_id"), F.col("text").alias("reference")), "doc_id").select("doc_id", score.alias("s"))


_words = lambda c: rf"list_filter(list_distinct(regexp_split_to_array(lower({c}), '\s+')), lambda w: w <> '')"
_joined = "FROM documents d JOIN documents b ON b.doc_id = d.doc_id + 1"
_kept = lambda c: f"list_filter({_words(c)}, lambda w: w NOT IN ({', '.join(map(repr, T.OVERLAP_STOP_WORDS))}))"
query(
    "h33_token_jaccard",
    lambda spark, sf: _against_next(spark, sf, F.round(T.token_jaccard(_text(), F.col("reference")), 6)).withColumnRenamed("s", "jaccard"),
    f"SELECT doc_id, round(coalesce(len(list_intersect(a, b)) / nullif(len(list_distinct(list_concat(a, b))), 0), 0.0::DOUBLE), 6) AS jaccard FROM (SELECT d.doc_id, {_kept('d.text')} AS a, {_kept('b.text')} AS b {_joined})",
)
query(
    "h38_lexical_quality",
    lambda spark, sf: _against_next(spark, sf, T.lexical_quality(_text(), F.col("reference"))).select("doc_id", "s.*"),
    f"""WITH w AS (SELECT d.doc_id, {_words('d.text')} AS a, {_words('b.text')} AS b {_joined}), q AS (SELECT doc_id, len(list_intersect(a, b)) / greatest(1, len(a)) AS p, len(list_intersect(a, b)) / greatest(1, len(b)) AS r FROM w)
    SELECT doc_id, round(p, 6) AS precision, round(r, 6) AS recall, round(2 * p * r / greatest(0.001, p + r), 6) AS f1 FROM q""",
)
query("h31_edit_distance", lambda spark, sf: table(spark, sf, "part").select("p_partkey", F.levenshtein("p_name", "p_type").alias("distance")), "SELECT p_partkey, CAST(levenshtein(p_name, p_type) AS INTEGER) AS distance FROM part")
query("h32_character_error_rate", lambda spark, sf: table(spark, sf, "part").select("p_partkey", F.round(T.character_error_rate(F.col("p_name"), F.col("p_type")), 6).alias("cer")), r"SELECT p_partkey, round(levenshtein(regexp_replace(p_name, '\s', '', 'g'), regexp_replace(p_type, '\s', '', 'g')) / length(regexp_replace(p_type, '\s', '', 'g')), 6) AS cer FROM part")
query(
    "h35_first_number",
    lambda spark, sf: table(spark, sf, "events").select("event_id", T.first_number(F.when(F.col("event_id") % 2 == 0, F.lit("twelve pears")).otherwise(F.col("props"))).alias("number")),
    "SELECT event_id, CASE WHEN event_id % 2 = 0 THEN 12 ELSE CAST(regexp_extract(props, '([0-9]+)', 1) AS BIGINT) END AS number FROM events",
)
_column("h36_category", "part", "p_partkey", lambda: T.category(F.when(F.col("p_partkey") % 2 == 0, F.concat(F.lit("The category is: "), F.col("p_brand"))).otherwise(F.concat(F.lit("This image shows "), F.col("p_name")))), r"CASE WHEN p_partkey % 2 = 0 THEN trim(regexp_extract('the category is: ' || lower(p_brand), 'category\s+is\s*:?\s*([\w\s]+)', 1)) ELSE string_split(lower(p_name), ' ')[1] END")
_column("h39_estimated_tokens", "documents", "doc_id", lambda: F.floor(F.length("text") / 4), "length(text) // 4")
_column("h83_content_hash", "customer", "c_custkey", lambda: T.content_hash(F.col("c_name"), F.col("c_mktsegment"), F.col("c_nationkey")), "sha256(c_name || '|' || c_mktsegment || '|' || c_nationkey)")
_column("h85_combined_query", "part", "p_partkey", lambda: T.combined_query(F.col("p_brand"), F.col("p_name"), F.col("p_size") / 50, "append"), "CASE WHEN p_size / 50 < 0.6 THEN p_brand ELSE p_brand || '. Context: ' || p_name END")
_column("h101_cut_window", "documents", "doc_id", lambda: F.md5(T.cut_window(_text(), 500, "middle")), "md5(CASE WHEN length(text) > 500 THEN substr(text, 1, 250) || right(text, 250) ELSE text END)")
_repair_sql = "text"
for _wrong, _right in T.REPAIRS.items():
    _repair_sql = f"replace({_repair_sql}, '{_wrong}', '{_right}')"
_column("c27_repaired", "documents", "doc_id", lambda: F.md5(T.repaired(_text())), f"md5(array_to_string(list_filter(string_split({_repair_sql}, chr(10)), lambda x: length(trim(x, ' ')) > 2), chr(10)))")
_places = lambda p: f"list_sum(list_transform(string_split_regex(text, '{p}')[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(m[1:i - 1], lambda x: length(x))), 0)"
query(
    "h93_entities",
    lambda spark, sf: table(spark, sf, "documents").select("doc_id", F.explode(T.entities(_text())).alias("e")).select("doc_id", "e.*"),
    " UNION ALL ".join(f"SELECT doc_id, '{k}' AS kind, m[i] AS text, CAST({_places(p)} AS INTEGER) AS position FROM (SELECT doc_id, text, m, unnest(range(1, len(m) + 1)) AS i FROM (SELECT doc_id, text, regexp_extract_all(text, '{p}') AS m FROM documents))" for k, p in T.ENTITIES.items()),
)
query(
    "f40_common_openings",
    lambda spark, sf: table(spark, sf, "documents")
    .select(F.explode(T.sentences(_text())).alias("s"))
    .select(F.filter(F.split("s", r"\s+"), lambda w: w != "").alias("w"))
    .filter(F.size("w") >= 5)
    .groupBy(F.array_join(F.slice("w", 1, 8), " ").alias("opening"))
    .agg(F.count("*").alias("n"))
    .filter("n >= 10")
    .orderBy(F.desc("n"), "opening")
    .limit(100),
    r"""WITH s AS (SELECT unnest(string_split(regexp_replace(text, '([.!?])\s+', '\1' || chr(1), 'g'), chr(1))) AS s FROM documents), w AS (SELECT list_filter(regexp_split_to_array(s, '\s+'), lambda w: w <> '') AS w FROM s)
    SELECT array_to_string(w[1:8], ' ') AS opening, count(*) AS n FROM w WHERE len(w) >= 5 GROUP BY 1 HAVING count(*) >= 10 ORDER BY n DESC, opening LIMIT 100""",
)
# Pages.
query(
    "a13_links",
    lambda spark, sf: table(spark, sf, "pages").select("page_id", F.explode(F.regexp_extract_all("html", F.lit(r'<a[^>]*href="([^"]*)"'), F.lit(1))).alias("url")).groupBy("page_id", "url").agg(F.count("*").alias("n")),
    """SELECT page_id, url, count(*) AS n FROM (SELECT page_id, unnest(regexp_extract_all(html, '<a[^>]*href="([^"]*)"', 1)) AS url FROM pages) GROUP BY 1, 2""",
)
query(
    "a14_images",
    lambda spark, sf: table(spark, sf, "pages").select("page_id", F.explode(F.regexp_extract_all("html", F.lit(r'<img[^>]*src="([^"]*)"'), F.lit(1))).alias("src")).groupBy("page_id", "src").agg(F.count("*").alias("n")),
    """SELECT page_id, src, count(*) AS n FROM (SELECT page_id, unnest(regexp_extract_all(html, '<img[^>]*src="([^"]*)"', 1)) AS src FROM pages) GROUP BY 1, 2""",
)
query(
    "a16_structure",
    lambda spark, sf: table(spark, sf, "pages").select("page_id", *[F.size(F.regexp_extract_all("html", F.lit(f"(?s)<h{i}[^>]*>(.*?)</h{i}>"), F.lit(1))).cast("long").alias(f"h{i}") for i in (1, 2, 3)], F.size(F.regexp_extract_all("html", F.lit("(?s)<p[^>]*>(.*?)</p>"), F.lit(1))).cast("long").alias("paragraphs")),
    "SELECT page_id, " + ", ".join(f"len(regexp_extract_all(html, '(?s)<h{i}[^>]*>(.*?)</h{i}>', 1)) AS h{i}" for i in (1, 2, 3)) + ", len(regexp_extract_all(html, '(?s)<p[^>]*>(.*?)</p>', 1)) AS paragraphs FROM pages",
)
query(
    "a05_html_text",
    lambda spark, sf: table(spark, sf, "pages").select("page_id", F.regexp_extract("html", "(?s)<title[^>]*>(.*?)</title>", 1).alias("title"), F.md5(F.trim(F.regexp_replace(F.regexp_replace("html", "<[^>]*>", " "), r"\s+", " "))).alias("text_md5")),
    r"SELECT page_id, regexp_extract(html, '(?s)<title[^>]*>(.*?)</title>', 1) AS title, md5(trim(regexp_replace(regexp_replace(html, '<[^>]*>', ' ', 'g'), '\s+', ' ', 'g'), ' ')) AS text_md5 FROM pages",
)
query(
    "a03_paragraphs",
    lambda spark, sf: readers.paragraphs(table(spark, sf, "documents").select(F.col("doc_id").alias("path"), "text")).select(F.col("path").alias("doc_id"), "pos", F.md5("text").alias("text_md5")),
    r"SELECT doc_id, CAST(pos - 1 AS INTEGER) AS pos, md5(trim(p, ' ')) AS text_md5 FROM (SELECT doc_id, unnest(l) AS p, generate_subscripts(l, 1) AS pos FROM (SELECT doc_id, regexp_split_to_array(text, '\n\s*\n') AS l FROM documents)) WHERE trim(p, ' ') <> ''",
)
