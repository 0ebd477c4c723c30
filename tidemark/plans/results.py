"""Registered queries for merging, judging and selecting results, and for retrieval over given vectors."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.functions import extract as X
from tidemark.functions import text as T
from tidemark.operators import graph as G
from tidemark.operators import results as R
from tidemark.operators import vectors as V
from tidemark.plans import graph as PG
from tidemark.plans.extract import TEXTS, _texts
from tidemark.registry import query
from tidemark.session import table


def t(name):
    return lambda s, d: table(s, d, name)


_docs, _line, _orders, _part, _cust, _conv, _events, _vectors = map(t, ("documents", "lineitem", "orders", "part", "customer", "conversations", "events", "embeddings"))

query(
    "g09_merged_documents",
    lambda s, d: R.merged_documents(_conv(s, d).select("conv_id", "turn", "text", F.array("role").alias("sections")), "conv_id", "turn", "text", "sections").select("conv_id", F.md5("text").alias("text_md5"), F.array_join("sections", ",").alias("sections")),
    "SELECT conv_id, md5(string_agg(CASE WHEN text <> '' THEN text END, chr(10) || chr(10) ORDER BY turn)) AS text_md5, string_agg(role, ',' ORDER BY turn) AS sections FROM conversations GROUP BY 1",
)
query(
    "g10_merged_lists",
    lambda s, d: R.merged_lists(_line(s, d).select("l_orderkey", "l_returnflag", F.array("l_suppkey").alias("v")), "l_orderkey", "l_returnflag", "v").select("l_orderkey", "l_returnflag", F.array_join("v", ",").alias("v")),
    "SELECT l_orderkey, l_returnflag, array_to_string(list_sort(list(DISTINCT l_suppkey)), ',') AS v FROM lineitem GROUP BY 1, 2",
)
_maps = lambda f: lambda s, d: _part(s, d).select("p_partkey", f(F.when(F.col("p_size") > 25, F.create_map(F.lit("size"), F.lit("large"), F.lit("brand"), F.lit("old"))).otherwise(F.create_map(F.lit("brand"), F.lit("own"))), F.create_map(F.lit("brand"), F.col("p_brand"), F.lit("size"), F.lit("small"))).alias("m")).select("p_partkey", F.col("m")["brand"].alias("brand"), F.col("m")["size"].alias("size"))
query("g02_updated_attributes", _maps(X.updated), "SELECT p_partkey, p_brand AS brand, 'small' AS size FROM part")
query("g16_existing_metadata_wins", _maps(X.filled), "SELECT p_partkey, CASE WHEN p_size > 25 THEN 'old' ELSE 'own' END AS brand, CASE WHEN p_size > 25 THEN 'large' ELSE 'small' END AS size FROM part")


def _readings(s, d):
    """Two readings of each document: itself, and the document with the next number where there is one."""
    docs = _docs(s, d).select("doc_id", "text", "n_chars")
    other = docs.select((F.col("doc_id") - 1).alias("doc_id"), F.col("text").alias("text2"), F.col("n_chars").alias("n2"))
    both = docs.join(other, "doc_id", "left")
    merged = R.merged_pair(F.col("text"), F.col("n_chars") % 100 / 100, F.col("text2"), F.col("n2") % 100 / 100, T.token_jaccard(F.col("text"), F.coalesce("text2", F.lit(""))))
    return both.select("doc_id", merged.alias("m")).select("doc_id", F.md5("m.content").alias("content_md5"), F.round("m.confidence", 6).alias("confidence"), "m.method")


_set = lambda c: f"list_filter(list_distinct(regexp_split_to_array(lower({c}), '\\s+')), lambda w: w <> '' AND w NOT IN ({', '.join(map(repr, T.OVERLAP_STOP_WORDS))}))"
query(
    "g12_hybrid_readings",
    _readings,
    f"""WITH p AS (SELECT a.doc_id, a.text, b.text AS text2, a.n_chars % 100 / 100 AS c, b.n_chars % 100 / 100 AS c2, {_set('a.text')} AS x, {_set("coalesce(b.text, '')")} AS y FROM documents a LEFT JOIN documents b ON b.doc_id = a.doc_id + 1),
    q AS (SELECT *, coalesce(len(list_intersect(x, y)) / nullif(len(list_distinct(list_concat(x, y))), 0), 0) AS j FROM p)
    SELECT doc_id, md5(CASE WHEN text2 IS NULL OR j > 0.8 AND c >= c2 THEN text WHEN j > 0.8 THEN text2 ELSE text || chr(10) || chr(10) || '=== Alternative Extraction ===' || chr(10) || chr(10) || text2 END) AS content_md5,
      round(CASE WHEN text2 IS NULL OR j > 0.8 AND c >= c2 THEN c WHEN j > 0.8 THEN c2 ELSE (c + c2) / 2 END, 6) AS confidence, CASE WHEN text2 IS NULL OR j > 0.8 AND c >= c2 THEN 'first' WHEN j > 0.8 THEN 'second' ELSE 'hybrid' END AS method FROM q""",
)
_metric = lambda *cols: F.map_filter(F.map_from_arrays(F.array(*map(F.lit, cols)), F.array(*[F.when(F.col(c) > 0.02, F.col(c)) for c in cols])), lambda k, v: v.isNotNull())
_MEANS = """WITH r AS (SELECT {by} AS by_, unnest({names}) AS metric, unnest({values}) AS x FROM lineitem), n AS (SELECT {by} AS by_, count(*) AS n FROM lineitem GROUP BY 1)
    SELECT by_ AS {by}, metric, round(sum(x) / n, 6) AS avg, round(coalesce(stddev_samp(x), 0), 4) AS std FROM r JOIN n USING (by_) WHERE x > 0.02 GROUP BY by_, metric, n"""
query("f27_metric_means", lambda s, d: R.metric_means(_line(s, d).select("l_suppkey", _metric("l_discount", "l_tax").alias("m")), "l_suppkey", "m"), _MEANS.format(by="l_suppkey", names="['l_discount', 'l_tax']", values="[l_discount, l_tax]"))
query("f28_vision_metrics", lambda s, d: R.metric_means(_line(s, d).select("l_returnflag", _metric("l_tax", "l_quantity", "l_discount").alias("m")), "l_returnflag", "m"), _MEANS.format(by="l_returnflag", names="['l_tax', 'l_quantity', 'l_discount']", values="[l_tax, l_quantity, l_discount]"))
query(
    "f48_success_rate",
    lambda s, d: _events(s, d).groupBy("event_type").agg(F.count("*").alias("total"), F.count_if(F.col("value") < 50).alias("good")).select("event_type", F.when(F.col("total") == 0, "N/A").otherwise(F.format_string("%.2f%%", 100.0 * F.col("good") / F.col("total"))).alias("success_rate")),
    "SELECT event_type, format('{:.2f}%', 100.0 * count(*) FILTER (value < 50) / count(*)) AS success_rate FROM events GROUP BY 1",
)
query(
    "f38_simple_combine",
    lambda s, d: _conv(s, d).groupBy("conv_id").agg(F.md5(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("turn", "text"))), lambda x: x["text"]), "\n")).alias("text_md5"), F.round(F.avg(F.length("text") % 100 / 100), 6).alias("confidence")),
    "SELECT conv_id, md5(string_agg(text, chr(10) ORDER BY turn)) AS text_md5, round(avg(length(text) % 100 / 100), 6) AS confidence FROM conversations GROUP BY 1",
)
query(
    "f43_quality_score",
    lambda s, d: _line(s, d).groupBy("l_orderkey").agg(F.avg("l_discount").alias("elements")).join(_orders(s, d).select(F.col("o_orderkey").alias("l_orderkey"), F.least(F.lit(1.0), F.col("o_totalprice") / 500000).alias("own")), "l_orderkey").select("l_orderkey", F.round((F.col("own") + F.col("elements")) / 2, 10).alias("quality")),
    "SELECT l_orderkey, round((least(1.0, o_totalprice / 500000) + avg(l_discount)) / 2, 10) AS quality FROM lineitem JOIN orders ON o_orderkey = l_orderkey GROUP BY l_orderkey, o_totalprice",
)
query(
    "f49_context_summary",
    lambda s, d: R.context_summary(_events(s, d), "user_id", F.struct("ts", "event_id"), "event_type", "value").select("user_id", F.md5("flow").alias("flow_md5"), "steps", "seconds", "errors"),
    "SELECT user_id, md5(string_agg(event_type, '>' ORDER BY ts, event_id)) AS flow_md5, count(*) AS steps, round(sum(value), 4) AS seconds, count(*) FILTER (event_type = 'error') AS errors FROM events GROUP BY 1",
)
query(
    "f50_phase_summary",
    lambda s, d: R.phase_summary(_events(s, d), "user_id", "event_type", "value", F.when(F.col("value") > 400, "failed").when(F.col("value") > 0.05, "completed").otherwise("running")),
    """WITH p AS (SELECT user_id, event_type, count(*) AS runs, round(sum(value), 4) AS duration, count(*) FILTER (value > 400) AS f, count(*) FILTER (value <= 400 AND value > 0.05) AS c FROM events GROUP BY 1, 2)
    SELECT user_id, event_type, runs, duration, CASE WHEN sum(f) OVER w > 0 THEN 'failed' WHEN sum(c) OVER w = sum(runs) OVER w THEN 'completed' ELSE 'running' END AS status FROM p WINDOW w AS (PARTITION BY user_id)""",
)


def _next_turns(s, d):
    """Each turn against the next of its conversation."""
    c = _conv(s, d).select(F.concat_ws("/", "conv_id", "turn").alias("k"), "conv_id", "turn", "text")
    other = c.select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("text").alias("reference"))
    return c.join(other, ["conv_id", "turn"]).select("k", "text", "reference")


_TOKENS = r"regexp_extract_all(lower({}), '[\p{{L}}\p{{N}}_]+|[^\s\p{{L}}\p{{N}}_]')"
query(
    "h37_bleu",
    lambda s, d: R.bleu(_next_turns(s, d), "k", "text", "reference"),
    f"""WITH p AS (SELECT a.conv_id || '/' || a.turn AS k, {_TOKENS.format('a.text')} AS c, {_TOKENS.format('b.text')} AS r FROM conversations a JOIN conversations b ON a.conv_id = b.conv_id AND b.turn = a.turn + 1),
    w AS (SELECT k, 0 AS side, c AS w FROM p UNION ALL SELECT k, 1, r FROM p), g AS (SELECT k, side, n, array_to_string(w[i:i + n - 1], ' ') AS g FROM (SELECT k, side, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM w, range(1, 5) x(n))),
    m AS (SELECT k, n, g, count(*) FILTER (side = 0) AS a, count(*) FILTER (side = 1) AS b FROM g GROUP BY 1, 2, 3), s AS (SELECT k, n, sum(least(a, b)) AS hits, sum(a) AS total FROM m GROUP BY 1, 2 HAVING sum(a) > 0),
    l AS (SELECT k, sum(ln(CASE WHEN hits > 0 THEN hits::DOUBLE ELSE 0.1::DOUBLE END / total)) AS logs, count(*) AS orders, sum(hits) FILTER (n = 1) AS first FROM s GROUP BY 1)
    SELECT k, round(CASE WHEN coalesce(first, 0) = 0 THEN 0.0::DOUBLE ELSE CASE WHEN len(c) > len(r) THEN 1.0::DOUBLE ELSE exp(1.0::DOUBLE - len(r) / len(c)) END * exp(logs / 4 + (4 - orders) / 4 * ln(0.1::DOUBLE)) END, 6) AS bleu FROM p LEFT JOIN l USING (k)""",
)


def _text_quality(s, d):
    """H37 by task: overlap for captions, category for classification, error of a count, character errors for scanned text."""
    pairs = _part(s, d).select("p_partkey", "p_name", "p_type", (F.col("p_partkey") % 4).alias("task"), F.concat(F.lit("I see "), "p_size", F.lit(" items")).alias("seen"), F.concat(F.lit("there are "), F.col("p_partkey") % 50).alias("told"))
    error = F.abs(T.first_number(F.col("seen")) - T.first_number(F.col("told")))
    score = (
        F.when(F.col("task") == 0, T.token_jaccard(F.col("p_name"), F.col("p_type")))
        .when(F.col("task") == 1, F.when(T.category(F.concat(F.lit("category is "), "p_name")) == T.category(F.concat(F.lit("category is "), "p_type")), 1.0).otherwise(0.0))
        .when(F.col("task") == 2, F.greatest(F.lit(0.0), 1.0 - error / F.greatest(F.lit(1), T.first_number(F.col("told")))))
        .otherwise(F.greatest(F.lit(0.0), 1.0 - T.character_error_rate(F.col("p_name"), F.col("p_type"))))
    )
    return pairs.select("p_partkey", "task", F.round(score, 6).alias("score"))


query(
    "h37_quality_by_task",
    _text_quality,
    rf"""SELECT p_partkey, p_partkey % 4 AS task, round(CASE p_partkey % 4 WHEN 0 THEN coalesce(len(list_intersect({_set('p_name')}, {_set('p_type')})) / nullif(len(list_distinct(list_concat({_set('p_name')}, {_set('p_type')}))), 0), 0)
      WHEN 1 THEN CASE WHEN lower(p_name) = lower(p_type) THEN 1.0 ELSE 0.0 END WHEN 2 THEN greatest(0.0, 1.0 - abs(p_size - p_partkey % 50) / greatest(1, p_partkey % 50))
      ELSE greatest(0.0, 1.0 - levenshtein(regexp_replace(p_name, '\s', '', 'g'), regexp_replace(p_type, '\s', '', 'g')) / length(regexp_replace(p_type, '\s', '', 'g'))) END, 6) AS score FROM part""",
)
_features = lambda: {"tables": F.contains("text", F.lit("|")), "currency": F.col("text").rlike("[$€£]"), "many_blocks": F.size(F.split("text", "\n")) > 30, "signatures": F.contains("text", F.lit("@")), "header_footer": F.col("n_chars") > 5000, "sections_and_references": F.col("text").rlike("[0-9]{4}")}
_FEATURES = {"tables": "contains(text, '|')", "currency": "regexp_matches(text, '[$€£]')", "many_blocks": "len(string_split(text, chr(10))) > 30", "signatures": "contains(text, '@')", "header_footer": "n_chars > 5000", "sections_and_references": "regexp_matches(text, '[0-9]{4}')"}
_sum = lambda c: " + ".join(["0.0::DOUBLE", *[f"CASE WHEN {_FEATURES[f]} THEN {w[c]}::DOUBLE ELSE 0.0::DOUBLE END" for f, w in R.FEATURES.items() if c in w and f in _FEATURES]])
query(
    "h99_document_classes",
    lambda s, d: _docs(s, d).select("doc_id", F.explode(R.document_classes(_features())).alias("c")).select("doc_id", "c.*"),
    f"WITH s AS (SELECT doc_id, unnest([{', '.join(map(repr, R.CLASSES))}]) AS class, unnest([{', '.join(map(_sum, R.CLASSES))}]) AS x FROM documents), m AS (SELECT *, max(x) OVER (PARTITION BY doc_id) AS top FROM s) SELECT doc_id, class, round(CASE WHEN top > 0 THEN least(1.0, pow(x / top, 0.7::DOUBLE)) ELSE 0.0 END, 6) AS score FROM m",
)
query("h90_to_be_chunked", lambda s, d: _part(s, d).select("p_partkey", R.to_be_chunked(F.col("p_retailprice") / 90, F.col("p_size") + 10, F.col("p_size") / 50).alias("chunk")), "SELECT p_partkey, p_retailprice / 90 > 20 OR p_size + 10 > 50 OR (p_size / 50 > 0.7 AND (p_retailprice / 90 > 10 OR p_size + 10 > 30)) AS chunk FROM part")
query(
    "h89_chunking_choice",
    lambda s, d: _docs(s, d).select("doc_id", R.chunking_strategy(F.col("n_chars") * 2000, F.contains("text", F.lit("|")), F.lit(True)).alias("c")).select("doc_id", "c.*"),
    """WITH b AS (SELECT doc_id, n_chars * 2000 AS size, contains(text, '|') AS image, CASE WHEN n_chars * 2000 < 1048576 THEN 102400 WHEN n_chars * 2000 > 52428800 THEN 5242880 ELSE 1048576 END AS base FROM documents),
    c AS (SELECT *, CASE WHEN image THEN greatest(base, 2097152) WHEN size > 10485760 THEN least(base, 3145728) ELSE base END AS chunk FROM b)
    SELECT doc_id, CASE WHEN image THEN 'content' WHEN size > 10485760 THEN 'hybrid' ELSE 'size' END AS method, chunk, CAST(floor(chunk * 0.1::DOUBLE) AS INTEGER) AS overlap FROM c""",
)
_kind = lambda: F.get(F.array(*map(F.lit, ("pdf", "image", "document", "text", "unknown"))), (F.col("p_partkey") % 5).cast("int"))
_KIND = "(['pdf', 'image', 'document', 'text', 'unknown'])[p_partkey % 5 + 1]"
query(
    "h100_processing_category",
    lambda s, d: _part(s, d).select("p_partkey", R.processing_category(_kind(), F.when(F.col("p_partkey") % 15 == 4, "docx").otherwise("bin"), F.col("p_size") > 45, F.col("p_size") / 50).alias("category")),
    f"SELECT p_partkey, CASE WHEN k = 'image' THEN 'image' WHEN k = 'pdf' THEN CASE WHEN p_size > 45 OR p_size / 50 > 0.6 THEN 'image' WHEN p_size / 50 > 0.3 THEN 'hybrid' ELSE 'pdf' END WHEN k = 'document' OR p_partkey % 15 = 4 THEN 'office' WHEN k = 'text' THEN 'text' ELSE 'hybrid' END AS category FROM (SELECT *, {_KIND} AS k FROM part)",
)
query(
    "c24_required_capabilities",
    lambda s, d: _part(s, d).select("p_partkey", F.explode(R.required_capabilities(_kind(), F.col("p_size") > 45, F.col("p_size") % 2 == 0, F.col("p_size") / 50, F.col("p_size") % 3 == 0, F.col("p_size") % 7 == 0, F.col("p_size") > 20)).alias("capability", "least")),
    f"""WITH p AS (SELECT p_partkey, {_KIND} AS k, p_size AS z FROM part), c AS (SELECT p_partkey, unnest(['scanned_documents', 'images', 'tables', 'forms', 'complex_layouts', 'pdfs', 'office_documents', 'mixed_content', 'text_extraction']) AS capability,
    unnest([CASE WHEN z > 45 THEN 0.7 END, CASE WHEN k = 'image' THEN 0.9 WHEN z % 2 = 0 THEN CASE WHEN z / 50 > 0.5 THEN 0.8 ELSE 0.5 END END, CASE WHEN z % 3 = 0 THEN 0.7 END, CASE WHEN z % 7 = 0 THEN 0.8 END, CASE WHEN z > 20 THEN 0.7 END, CASE WHEN k = 'pdf' THEN 0.8 END, CASE WHEN k = 'document' THEN 0.8 END,
      CASE WHEN z % 2 = 0 AND z % 3 = 0 AND z > 20 THEN 0.8 END, CASE k WHEN 'image' THEN 0.6 WHEN 'pdf' THEN 0.7 ELSE 0.5 END])::DOUBLE AS least FROM p) SELECT * FROM c WHERE least IS NOT NULL""",
)
# Invoice fields. The patterns of each field, in order.
INVOICE_FIELDS = {
    "invoice_number": [r"Invoice\s*#?\s*[:]\s*([A-Z0-9-]+)", r"Invoice\s*Number\s*[:]\s*([A-Z0-9-]+)", r"Bill\s*Number\s*[:]\s*([A-Z0-9-]+)"],
    "date": [r"Date\s*[:]\s*(\d{1,2}[-/]\d{1,2}[-/]\d{2,4})", r"Invoice\s*Date\s*[:]\s*(\d{1,2}[-/]\d{1,2}[-/]\d{2,4})"],
    "total_amount": [r"Total\s*[:]\s*[$€£]?\s*([\d,]+\.?\d*)", r"Amount\s*Due\s*[:]\s*[$€£]?\s*([\d,]+\.?\d*)"],
    "tax_amount": [r"Tax\s*[:]\s*[$€£]?\s*([\d,]+\.?\d*)", r"VAT\s*[:]\s*[$€£]?\s*([\d,]+\.?\d*)"],
}
_bill = lambda s, d: _orders(s, d).select(F.concat(F.lit("o"), "o_orderkey").alias("id"), F.concat(F.lit("Bill Number: B-"), "o_orderkey", F.lit("\nInvoice Date: "), F.date_format("o_orderdate", "dd/MM/yyyy"), F.lit("\nAmount Due: $"), F.format_number("o_totalprice", 2)).alias("text"))
_BILLS = "SELECT 'o' || o_orderkey AS id, 'Bill Number: B-' || o_orderkey || chr(10) || 'Invoice Date: ' || strftime(o_orderdate, '%d/%m/%Y') || chr(10) || 'Amount Due: $' || format('{:,.2f}', o_totalprice) AS text FROM orders"
query(
    "h28_invoice_fields",
    lambda s, d: _docs(s, d).select(F.concat(F.lit("d"), "doc_id").alias("id"), "text").unionByName(_bill(s, d)).select("id", *[T.first_match(F.col("text"), p).alias(f) for f, p in INVOICE_FIELDS.items()]),
    "WITH t AS (SELECT 'd' || doc_id AS id, text FROM documents UNION ALL " + _BILLS + ") SELECT id, " + ", ".join("coalesce(" + ", ".join(f"nullif(regexp_extract(text, '{p}', 1), '')" for p in ps) + f") AS {f}" for f, ps in INVOICE_FIELDS.items()) + " FROM t",
)
query(
    "h27_document_metadata",
    lambda s, d: _texts(s, d).select("id", F.length("text").alias("chars"), F.size(F.filter(F.split("text", r"\s+"), lambda w: w != "")).alias("words"), F.size(F.split("text", "\n")).alias("lines"), F.array_join(X.dates(F.col("text")), ",").alias("dates"), F.size(X.amounts(F.col("text"))).alias("amounts"), F.size(X.addresses(F.col("text"))).alias("addresses"), T.first_match(F.col("text"), T.INVOICE).alias("invoice"), T.first_match(F.col("text"), T.VAT).alias("vat"), T.document_kind(F.col("text"))["kind"].alias("kind")),
    rf"""WITH t AS ({TEXTS}), m AS (SELECT id, text, list_transform(regexp_extract_all(text, '\d{{4}}-\d{{1,2}}-\d{{1,2}}|\d{{1,2}}[.-]\d{{1,2}}[.-]\d{{4}}'), lambda x: list_transform(regexp_split_to_array(x, '[.-]'), lambda y: CAST(y AS INTEGER))) AS f FROM t),
    o AS (SELECT id, text, list_transform(f, lambda x: CASE WHEN x[1] > 31 THEN list_reverse(x) ELSE x END) AS f FROM m)
    SELECT id, CAST(length(text) AS INTEGER) AS chars, CAST(len(list_filter(regexp_split_to_array(text, '\s+'), lambda w: w <> '')) AS INTEGER) AS words, CAST(len(string_split(text, chr(10))) AS INTEGER) AS lines,
      coalesce(array_to_string(list_transform(list_filter(f, lambda x: x[1] BETWEEN 1 AND 31 AND x[2] BETWEEN 1 AND 12 AND x[3] >= 1900), lambda x: format('{{:04d}}-{{:02d}}-{{:02d}}', x[3], x[2], x[1])), ','), '') AS dates,
      CAST(len(regexp_extract_all(text, '\$\s*\d{{1,3}}(?:,\d{{3}})*\.\d{{2}}|\d{{1,3}}(?:[.,]\d{{3}})*[.,]\d{{2}}\s*(?:€|Euro\b|[A-Z]{{3}}\b)')) AS INTEGER) AS amounts, CAST(len(regexp_extract_all(text, '{X.GERMAN_ADDRESS}')) + len(regexp_extract_all(text, '{X.US_ADDRESS}')) AS INTEGER) AS addresses,
      coalesce({', '.join(f"nullif(regexp_extract(text, '{p}', 1), '')" for p in T.INVOICE)}) AS invoice, coalesce({', '.join(f"nullif(regexp_extract(text, '{p}', 1), '')" for p in T.VAT)}) AS vat,
      (SELECT CASE WHEN max(n) = 0 THEN 'unknown' ELSE arg_max(k, n * 10 - i) END FROM (VALUES {', '.join("({}, '{}', {})".format(i, k, ' + '.join("CAST(contains(lower(text), '{}') AS INTEGER)".format(w.replace("'", "''")) for w in words)) for i, (k, words) in enumerate(T.KINDS.items()))}) v(i, k, n)) AS kind FROM o""",
)
# Retrieval over given vectors.
_COS = "list_cosine_similarity(CAST({a} AS DOUBLE[]), CAST({b} AS DOUBLE[]))"
_TOP = "r AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM p) SELECT * FROM r WHERE rank <= {k}"
query("j04_exhaustive_top_k", lambda s, d: V.top_k(_vectors(s, d), _vectors(s, d).filter("vec_id % 20 = 0"), 12), f"WITH p AS (SELECT q.vec_id AS query_id, v.vec_id, round({_COS.format(a='q.embedding', b='v.embedding')}, 6) AS score FROM embeddings q JOIN embeddings v ON q.vec_id % 20 = 0 AND q.vec_id <> v.vec_id), {_TOP.format(k=12)}")
query("j08_similar_entities", lambda s, d: V.top_k(_vectors(s, d).filter("label = 1"), _vectors(s, d).filter("vec_id % 20 = 0"), 5), f"WITH p AS (SELECT q.vec_id AS query_id, v.vec_id, round({_COS.format(a='q.embedding', b='v.embedding')}, 6) AS score FROM embeddings q JOIN embeddings v ON q.vec_id % 20 = 0 AND q.vec_id <> v.vec_id AND v.label = 1), {_TOP.format(k=5)}")
query("i11_semantic_graph_query", lambda s, d: V.top_k(_vectors(s, d), _vectors(s, d).filter("vec_id % 20 = 0"), 10).join(PG.nodes(s, d).filter("kind = 'Customer'").select(F.substring("id", 2, 20).cast("long").alias("vec_id"), "label"), "vec_id").select("query_id", "rank", "label"), f"WITH p AS (SELECT q.vec_id AS query_id, v.vec_id, round({_COS.format(a='q.embedding', b='v.embedding')}, 6) AS score FROM embeddings q JOIN embeddings v ON q.vec_id % 20 = 0 AND q.vec_id <> v.vec_id), t AS ({_TOP.format(k=10).replace('r AS (', 'SELECT * FROM (', 1).replace(') SELECT * FROM r WHERE', ') WHERE')}) SELECT query_id, rank, c_name AS label FROM t JOIN customer ON c_custkey = vec_id")
query(
    "h49_text_and_image_top_k",
    lambda s, d: V.top_k(_vectors(s, d), R.combined_queries(_vectors(s, d).filter("vec_id % 20 = 0"), _vectors(s, d).select((F.col("vec_id") - 1).alias("vec_id"), "embedding")), 5),
    f"WITH m AS (SELECT a.vec_id, list_transform(list_zip(a.embedding, b.embedding), lambda x: 0.7::DOUBLE * x[1] + (1 - 0.7::DOUBLE) * x[2]) AS e FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1 WHERE a.vec_id % 20 = 0), p AS (SELECT q.vec_id AS query_id, v.vec_id, round(list_cosine_similarity(q.e, CAST(v.embedding AS DOUBLE[])), 6) AS score FROM m q JOIN embeddings v ON q.vec_id <> v.vec_id), {_TOP.format(k=5)}",
)
query("d07_visual_similarity", lambda s, d: V.similar_pairs(_vectors(s, d), 0.5, across=False), f"SELECT * FROM (SELECT a.vec_id AS a, b.vec_id AS b, round({_COS.format(a='a.embedding', b='b.embedding')}, 6) AS score FROM embeddings a JOIN embeddings b ON a.vec_id < b.vec_id) WHERE score >= 0.5")
_named = f"p AS (SELECT q.vec_id AS query_id, v.vec_id, 'label' || v.label AS name, round({_COS.format(a='q.embedding', b='v.embedding')}, 6) AS score FROM embeddings q JOIN embeddings v ON q.vec_id % 20 = 0 AND q.vec_id <> v.vec_id)"
query(
    "j09_enhanced_queries",
    lambda s, d: R.enhanced_queries(V.top_k(_vectors(s, d), _vectors(s, d).filter("vec_id % 20 = 0"), 3), _vectors(s, d).select("vec_id", F.concat(F.lit("label"), "label").alias("name")), "find "),
    f"WITH {_named}, r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM p) SELECT query_id, 'find ' || query_id || ' ' || string_agg(name, ' ' ORDER BY rank) AS query FROM r WHERE rank <= 3 GROUP BY 1",
)
query("c14_filtered_hits", lambda s, d: R.filtered_hits(_docs(s, d).select("doc_id", "n_chars", F.when(F.col("source") != "src1", F.col("lang")).alias("lang")), "n_chars", "doc_id", 50, lang="de").select("doc_id", "n_chars"), "SELECT doc_id, n_chars FROM documents WHERE lang = 'de' OR source = 'src1' ORDER BY n_chars DESC, doc_id LIMIT 50")
query("j10_stored_results", lambda s, d: R.to_be_stored(_docs(s, d).select("doc_id", "source", (F.col("n_chars") % 100 / 100).alias("score")), "score", F.col("source")).select("doc_id", "score", "search_query", "source"), "SELECT doc_id, n_chars % 100 / 100 AS score, source AS search_query, 'web_search' AS source FROM documents WHERE n_chars % 100 / 100 > 0.7")
query(
    "d26_zipped_records",
    lambda s, d: R.zipped(_cust(s, d).select("c_custkey", "c_name", F.lit(0).alias("at")), _orders(s, d).select(F.col("o_custkey").alias("c_custkey"), F.col("o_orderkey").alias("at"), F.col("o_orderkey")), "c_custkey", "at").select("c_custkey", "c_name", "o_orderkey"),
    "SELECT c_custkey, c_name, min(o_orderkey) AS o_orderkey FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY 1, 2",
)
query(
    "d31_cross_modal",
    lambda s, d: _part(s, d).select("p_brand", F.explode(F.split("p_name", " ")).alias("word")).distinct().join(_part(s, d).select("p_brand", "p_partkey", "p_name"), "p_brand").filter(F.contains(F.lower("p_name"), F.lower("word"))).select("p_brand", "p_partkey", "word", F.round(F.least(0.9 * F.length("word") / F.length("p_name"), F.lit(0.9)), 6).alias("confidence")).filter("confidence >= 0.4"),
    "WITH w AS (SELECT DISTINCT p_brand, unnest(string_split(p_name, ' ')) AS word FROM part) SELECT p_brand, p_partkey, word, round(least(0.9::DOUBLE * length(word) / length(p_name), 0.9), 6) AS confidence FROM w JOIN part USING (p_brand) WHERE contains(lower(p_name), lower(word)) AND round(least(0.9::DOUBLE * length(word) / length(p_name), 0.9), 6) >= 0.4",
)
# Paths, threads and sessions.
query(
    "i02_shortest_paths",
    lambda s, d: G.paths(PG.edges(s, d), PG.nodes(s, d).filter("kind = 'Customer' AND confidence = 0.5"), 3).filter("id LIKE 'r%'").select("start", "id", F.array_join("path", ">").alias("path")),
    f"{PG.WITH}, w(start, id, hop, path) AS (SELECT id, id, 0, id FROM n WHERE kind = 'Customer' AND confidence = 0.5 UNION ALL SELECT start, target, hop + 1, path || '>' || target FROM w JOIN e ON source = id WHERE hop < 3), r AS (SELECT *, row_number() OVER (PARTITION BY start, id ORDER BY hop, path) AS r FROM w) SELECT start, id, path FROM r WHERE r = 1 AND id LIKE 'r%'",
)
query(
    "c17_direct_replies",
    lambda s, d: _conv(s, d).filter("role = 'user'").select("conv_id", F.col("turn").alias("parent")).join(_conv(s, d).select("conv_id", (F.col("turn") - 1).alias("parent"), "turn", "role"), ["conv_id", "parent"]),
    "SELECT a.conv_id, a.turn AS parent, b.turn, b.role FROM conversations a JOIN conversations b ON a.conv_id = b.conv_id AND b.turn = a.turn + 1 WHERE a.role = 'user'",
)
query("k07_session_streams", lambda s, d: _conv(s, d).groupBy("conv_id").agg(F.md5(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("turn", "role", "text"))), lambda x: F.concat(x["role"], F.lit(": "), x["text"])), "")).alias("stream_md5"), F.count("*").alias("n")), "SELECT conv_id, md5(string_agg(role || ': ' || text, '' ORDER BY turn, role, text)) AS stream_md5, count(*) AS n FROM conversations GROUP BY 1")
query(
    "c26_model_dashboard",
    lambda s, d: _line(s, d).groupBy(F.col("l_partkey").cast("string").alias("name")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), F.col("name").cast("long")).limit(10).unionByName(_part(s, d).agg(F.count("*").alias("total"), F.count_if(F.col("p_size") > 10).alias("active"), F.count_if(F.col("p_size") <= 10).alias("inactive"), F.count_if(F.contains("p_name", F.lit("red"))).alias("vision")).unpivot([], ["total", "active", "inactive", "vision"], "name", "n")),
    "SELECT * FROM (SELECT CAST(l_partkey AS VARCHAR) AS name, count(*) AS n FROM lineitem GROUP BY l_partkey ORDER BY n DESC, l_partkey LIMIT 10) UNION ALL SELECT unnest(['total', 'active', 'inactive', 'vision']), unnest([count(*), count(*) FILTER (p_size > 10), count(*) FILTER (p_size <= 10), count(*) FILTER (contains(p_name, 'red'))]) FROM part",
)
query("i07_nodes_of_kind", lambda s, d: PG.nodes(s, d).filter("kind = 'Supplier'").select("id", "label"), f"{PG.WITH} SELECT id, label FROM n WHERE kind = 'Supplier'")
