"""Registered record queries over the star schema and the texts."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tidemark.functions import text as T
from tidemark.operators import events as E
from tidemark.operators import graph as G
from tidemark.operators import records as R
from tidemark.operators import search as S
from tidemark.operators import vectors as V
from tidemark.plans import graph as PG
from tidemark.registry import query
from tidemark.session import table
from tidemark.sources import readers, writers


def t(name):
    return lambda s, d: table(s, d, name)


_docs, _line, _orders, _part, _cust, _nation, _conv = map(t, ("documents", "lineitem", "orders", "part", "customer", "nation", "conversations"))

query("a19_like_search", lambda s, d: readers.sql_like(_part(s, d), ["p_name", "p_type"], "brass", "p_partkey", 25).select("p_partkey"), "SELECT p_partkey FROM part WHERE contains(lower(p_name), 'brass') OR contains(lower(p_type), 'brass') ORDER BY p_partkey DESC LIMIT 25")
query("a21_contains_top_k", lambda s, d: S.top(_docs(s, d).filter(S.has("text", "edly")), 15, F.desc("n_chars"), F.col("doc_id")).select("doc_id", "n_chars"), "SELECT doc_id, n_chars FROM documents WHERE contains(lower(text), 'edly') ORDER BY n_chars DESC, doc_id LIMIT 15")
query(
    "a41_related_entities",
    lambda s, d: PG.edges(s, d).filter("source = 'n7'").select(F.col("target").alias("id"), F.lit("out").alias("way")).unionByName(PG.edges(s, d).filter("target = 'n7'").select(F.col("source").alias("id"), F.lit("in").alias("way"))).orderBy("way", "id").limit(20),
    f"{PG.WITH} SELECT * FROM (SELECT target AS id, 'out' AS way FROM e WHERE source = 'n7' UNION ALL SELECT source, 'in' FROM e WHERE target = 'n7') ORDER BY way, id LIMIT 20",
)
query("a51_clean_text", lambda s, d: _docs(s, d).select("doc_id", F.md5(F.trim(F.regexp_replace("text", r"[ \t]+", " "))).alias("clean_md5"), F.size(F.split("text", "\n")).cast("long").alias("lines")), r"SELECT doc_id, md5(trim(regexp_replace(text, '[ \t]+', ' ', 'g'), ' ')) AS clean_md5, len(string_split(text, chr(10))) AS lines FROM documents")
query(
    "b02_prometheus",
    lambda s, d: writers.prometheus(t("events")(s, d).groupBy(F.lit("Events").alias("category"), F.concat("event_type", F.lit(".count")).alias("name")).agg(F.count("*").alias("value"))),
    "WITH m AS (SELECT 'events_' || event_type || '_count' AS n, count(*) AS v FROM events GROUP BY 1) SELECT '# TYPE ' || n || ' gauge' AS line FROM m UNION ALL SELECT n || ' ' || v FROM m",
)
query("b08_csv_lines", lambda s, d: writers.csv_lines(_cust(s, d).select("c_custkey", "c_name", F.concat(F.lit('a,"'), "c_mktsegment").alias("q"))), "SELECT c_custkey || ',' || c_name || ',\"a,\"\"' || c_mktsegment || '\"' AS line FROM customer")
query("b09_json_lines", lambda s, d: writers.json_lines(_cust(s, d).select("c_custkey", "c_name")), "SELECT '{\"c_custkey\":' || c_custkey || ',\"c_name\":\"' || c_name || '\"}' AS line FROM customer")
query(
    "c19_content_kind",
    lambda s, d: t("events")(s, d).select("event_id", readers.content_kind(F.when(F.col("event_type") == "click", "image/png").when(F.col("event_type") == "view", "application/pdf").otherwise("x/y")).alias("kind")).groupBy("kind").agg(F.count("*").alias("n")),
    "SELECT CASE event_type WHEN 'click' THEN 'image' WHEN 'view' THEN 'document' ELSE 'other' END AS kind, count(*) AS n FROM events GROUP BY 1",
)
query("c20_daily_quota", lambda s, d: E.daily_quota(t("events")(s, d), 2).groupBy("can_send").agg(F.count("*").alias("n")), "SELECT can_send, count(*) AS n FROM (SELECT count(*) < 2 AS can_send FROM events GROUP BY user_id, CAST(ts AS DATE)) GROUP BY 1")
query(
    "d04_append_and_delete",
    lambda s, d: _cust(s, d).select("c_custkey").unionAll(_cust(s, d).filter("c_mktsegment = 'BUILDING'").select("c_custkey")).join(_cust(s, d).filter("c_acctbal < 0").select("c_custkey"), "c_custkey", "left_anti"),
    "SELECT c_custkey FROM (SELECT c_custkey FROM customer UNION ALL SELECT c_custkey FROM customer WHERE c_mktsegment = 'BUILDING') WHERE c_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_acctbal < 0)",
)
query(
    "d12_document_entity_index",
    lambda s, d: R.both_indexes(_line(s, d), "l_orderkey", "l_suppkey")[0].withColumnRenamed("l_orderkey", "id").withColumn("side", F.lit("document")).unionByName(R.both_indexes(_line(s, d), "l_orderkey", "l_suppkey")[1].withColumnRenamed("l_suppkey", "id").withColumn("side", F.lit("entity"))),
    "SELECT l_orderkey AS id, count(DISTINCT l_suppkey) AS n, 'document' AS side FROM lineitem GROUP BY 1 UNION ALL SELECT l_suppkey, count(DISTINCT l_orderkey), 'entity' FROM lineitem GROUP BY 1",
)
query("d13_entities_of_documents", lambda s, d: _line(s, d).groupBy("l_orderkey").agg(F.array_join(F.array_sort(F.collect_set("l_partkey")), ",").alias("entities")), "SELECT l_orderkey, array_to_string(list_sort(list(DISTINCT l_partkey)), ',') AS entities FROM lineitem GROUP BY 1")
query("d14_documents_of_entities", lambda s, d: _line(s, d).select("l_partkey", "l_orderkey").distinct().withColumn("score", F.lit(1.0)), "SELECT DISTINCT l_partkey, l_orderkey, 1.0::DOUBLE AS score FROM lineitem")
query(
    "d17_graph_and_vector_documents",
    lambda s, d: S.merged_scores(_line(s, d).filter("l_discount >= 0.1").select(F.col("l_orderkey").alias("id"), F.lit(0.9).alias("score")), _orders(s, d).orderBy(F.desc("o_totalprice"), "o_orderkey").limit(20).select(F.col("o_orderkey").alias("id"), (F.row_number().over(Window.orderBy(F.desc("o_totalprice"), "o_orderkey")) - 1).alias("i"), F.lit(20).alias("n")), "id"),
    "SELECT id, round(coalesce(g * 0.7::DOUBLE, 0) + coalesce((1 - i / 20) * 0.3::DOUBLE, 0), 6) AS score FROM (SELECT l_orderkey AS id, max(0.9::DOUBLE) AS g FROM lineitem WHERE l_discount >= 0.1 GROUP BY 1) FULL JOIN (SELECT o_orderkey AS id, row_number() OVER (ORDER BY o_totalprice DESC, o_orderkey) - 1 AS i FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 20) USING (id)",
)


def _scored_nodes(s, d):
    weight = F.when(F.col("kind") == "Nation", 1.2).otherwise(1.0)
    return PG.nodes(s, d).withColumn("score", F.round(R.relevance(F.col("label"), [F.col("kind")], ["an", "reg"], {"IRAN": 0.9}, weight), 6))


_REL = "CASE WHEN contains(lower(label), 'iran') OR contains('iran', lower(label)) THEN 0.63::DOUBLE ELSE 0 END + CASE WHEN contains(lower(label), 'an') THEN 0.5::DOUBLE ELSE 0 END + CASE WHEN contains(lower(label), 'reg') THEN 0.5::DOUBLE ELSE 0 END + CASE WHEN contains(lower(kind), 'an') THEN 0.3::DOUBLE ELSE 0 END + CASE WHEN contains(lower(kind), 'reg') THEN 0.3::DOUBLE ELSE 0 END"
_SCORED = f"n2 AS (SELECT *, round(least(1.0, ({_REL}) * CASE WHEN kind = 'Nation' THEN 1.2::DOUBLE ELSE 1.0::DOUBLE END), 6) AS score FROM n)"
query("h07_entity_relevance", lambda s, d: _scored_nodes(s, d).select("id", "score"), f"{PG.WITH}, {_SCORED} SELECT id, score FROM n2")
query(
    "d21_relevant_subgraph",
    lambda s, d: R.relevant_subgraph(_scored_nodes(s, d), PG.edges(s, d), 30, 0.2, 0.3),
    f"{PG.WITH}, {_SCORED}, b AS (SELECT id, score FROM n2 WHERE score > 0.2 ORDER BY score DESC, id LIMIT 30) SELECT source, target, round((x.score + y.score) / 2, 6) AS score FROM e JOIN b x ON x.id = source JOIN b y ON y.id = target WHERE round((x.score + y.score) / 2, 6) > 0.3",
)
query(
    "d22_claims_against_labels",
    lambda s, d: R.label_support(_docs(s, d).select("doc_id", F.lower("text").alias("low")), "doc_id", "low", t("region")(s, d).select("r_name", F.lower(F.substring("r_name", 1, 3)).alias("needle")), "r_name", "needle"),
    "SELECT r_name, count(*) AS support FROM documents JOIN region ON contains(lower(text), lower(substr(r_name, 1, 3))) GROUP BY 1",
)
query("f11_property_coverage", lambda s, d: _line(s, d).unpivot(["l_returnflag"], ["l_discount", "l_tax"], "property", "x").groupBy("l_returnflag", "property").agg(F.count("*").alias("n"), F.round(F.avg((F.col("x") > 0).cast("double")), 6).alias("coverage")), "SELECT l_returnflag, property, count(*) AS n, round(avg(CAST(x > 0 AS INTEGER)), 6) AS coverage FROM (SELECT l_returnflag, unnest(['l_discount', 'l_tax']) AS property, unnest([l_discount, l_tax]) AS x FROM lineitem) GROUP BY 1, 2")
query("f24_inference_means", lambda s, d: _line(s, d).groupBy("l_linestatus").agg(F.round(F.avg("l_quantity"), 6).alias("avg_resolution"), F.round(100.0 * F.avg((F.col("l_tax") > 0.04).cast("double")), 6).alias("resized_pct")), "SELECT l_linestatus, round(avg(l_quantity), 6) AS avg_resolution, round(100.0 * avg(CAST(l_tax > 0.04 AS INTEGER)), 6) AS resized_pct FROM lineitem GROUP BY 1")
query("f36_resolution_report", lambda s, d: R.resolution_report(_part(s, d).select("p_brand", F.col("p_name").alias("cluster")), "p_brand", "cluster"), "SELECT p_brand, count(*) AS before, count(DISTINCT p_name) AS after, count(*) - count(DISTINCT p_name) AS merged, round(100.0 * (count(*) - count(DISTINCT p_name)) / count(*), 6) AS reduction_pct FROM part GROUP BY 1")
query(
    "f37_merged_results",
    lambda s, d: R.merged_results(_conv(s, d).withColumn("c", (F.col("turn") + 1) / 10), "conv_id", "text", "c", "turn"),
    "SELECT conv_id, md5(string_agg(text, chr(10) ORDER BY turn)) AS text_md5, round(sum((turn + 1) / 10 * length(text)) / nullif(sum(length(text)), 0), 6) AS weighted, round(avg((turn + 1) / 10), 6) AS mean FROM conversations GROUP BY 1",
)
query(
    "f39_ordered_by_share",
    lambda s, d: _line(s, d).withColumn("share", F.round(F.col("l_discount") / F.nullif(F.sum("l_discount").over(Window.partitionBy("l_orderkey")), F.lit(0.0)), 6)).select("l_orderkey", "l_linenumber", "share", F.row_number().over(Window.partitionBy("l_orderkey").orderBy(F.desc_nulls_last("share"), "l_linenumber")).alias("rank")),
    "WITH s AS (SELECT l_orderkey, l_linenumber, round(l_discount / nullif(sum(l_discount) OVER (PARTITION BY l_orderkey), 0), 6) AS share FROM lineitem) SELECT *, CAST(row_number() OVER (PARTITION BY l_orderkey ORDER BY share DESC NULLS LAST, l_linenumber) AS INTEGER) AS rank FROM s",
)
query(
    "f41_claim_status",
    lambda s, d: _orders(s, d).select("o_orderkey", R.claim_status(F.col("o_orderkey") % 5, F.col("o_custkey") % 3, F.lit(5)).alias("status")),
    "SELECT o_orderkey, CASE WHEN (o_custkey % 3) / 5 > 0.3 THEN 'invalid' WHEN (o_orderkey % 5) / 5 >= 0.7 THEN 'valid' ELSE 'uncertain' END AS status FROM orders",
)
query("f42_repeated_claims", lambda s, d: R.repeated(_line(s, d), "l_suppkey", "l_orderkey"), "SELECT l_orderkey, l_suppkey, count(*) AS n FROM lineitem GROUP BY 1, 2 HAVING count(*) > 1")
query("g11_merged_edges", lambda s, d: G.distinct_edges(PG.edges(s, d).unionByName(PG.edges(s, d).select(F.col("target").alias("source"), F.col("source").alias("target"), "kind", "confidence")), directed=False).groupBy("kind").agg(F.count("*").alias("n")), f"{PG.WITH} SELECT kind, count(*) AS n FROM (SELECT DISTINCT least(source, target), greatest(source, target), kind FROM e) GROUP BY 1")
query(
    "h17_spoken_phrases",
    lambda s, d: _conv(s, d).select("conv_id", "turn", F.posexplode(T.speaker_phrases(F.concat("role", F.lit(": "), "text"))).alias("pos", "p")).select("conv_id", "turn", "pos", "p.*"),
    r"""WITH s AS (SELECT conv_id, turn, list_filter(string_split(regexp_replace(role || ': ' || text, '([.!?])\s+', '\1' || chr(1), 'g'), chr(1)), lambda x: trim(x, ' ') <> '') AS l FROM conversations),
    e AS (SELECT conv_id, turn, CAST(generate_subscripts(l, 1) - 1 AS INTEGER) AS pos, unnest(l) AS x FROM s)
    SELECT conv_id, turn, pos, CASE WHEN regexp_matches(x, '^[A-Za-z\s]+:') THEN trim(regexp_extract(x, '^([A-Za-z\s]+):', 1), ' ') ELSE 'unknown' END AS speaker, trim(CASE WHEN regexp_matches(x, '^[A-Za-z\s]+:') THEN regexp_replace(x, '^[A-Za-z\s]+:\s*', '') ELSE x END, ' ') AS phrase FROM e""",
)
query(
    "h18_language_runs",
    lambda s, d: R.language_runs(_conv(s, d), "conv_id", "turn", F.when(F.col("text").rlike("[äöüß]"), "de").when(F.col("text").rlike("[éèçê]"), "fr").otherwise("en")),
    "WITH l AS (SELECT conv_id, turn, CASE WHEN regexp_matches(text, '[äöüß]') THEN 'de' WHEN regexp_matches(text, '[éèçê]') THEN 'fr' ELSE 'en' END AS language FROM conversations), m AS (SELECT *, CASE WHEN language = lag(language) OVER (PARTITION BY conv_id ORDER BY turn) THEN 0 ELSE 1 END AS new FROM l), r AS (SELECT *, CAST(sum(new) OVER (PARTITION BY conv_id ORDER BY turn) AS BIGINT) AS run FROM m) SELECT conv_id, run, min(language) AS language, count(*) AS n FROM r GROUP BY 1, 2",
)
query("h47_fusion_confidence", lambda s, d: t("embeddings")(s, d).alias("a").join(t("embeddings")(s, d).select((F.col("vec_id") - 1).alias("vec_id"), F.col("embedding").alias("b")), "vec_id").select("vec_id", F.round((V.cosine("embedding", "b") + 1.0) / 2, 6).alias("confidence")), "SELECT a.vec_id, round((list_cosine_similarity(CAST(a.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[])) + 1.0) / 2, 6) AS confidence FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1")
query("h48_cross_modal_top_k", lambda s, d: V.top_k(t("embeddings")(s, d), t("embeddings")(s, d).filter("vec_id % 20 = 0"), 8).join(t("embeddings")(s, d).select("vec_id", "label"), "vec_id").select("query_id", "vec_id", F.round(F.col("score") * F.when(F.col("label") % 2 == 0, 0.9).otherwise(1.0), 9).alias("score")), "WITH p AS (SELECT q.vec_id AS query_id, v.vec_id, v.label, round(list_cosine_similarity(CAST(q.embedding AS DOUBLE[]), CAST(v.embedding AS DOUBLE[])), 6) AS score FROM embeddings q JOIN embeddings v ON q.vec_id % 20 = 0 AND q.vec_id <> v.vec_id), r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM p) SELECT query_id, vec_id, round(score * CASE WHEN label % 2 = 0 THEN 0.9::DOUBLE ELSE 1.0::DOUBLE END, 9) AS score FROM r WHERE rank <= 8")
query("h59_image_forecast", lambda s, d: _part(s, d).select("p_partkey", F.round(F.greatest(F.lit(0.0), F.col("p_size") * 0.00765 - F.col("p_retailprice") * 0.0001), 9).alias("saving")), "SELECT p_partkey, round(greatest(0.0, p_size * 0.00765::DOUBLE - p_retailprice * 0.0001::DOUBLE), 9) AS saving FROM part")
query("h80_row_lengths", lambda s, d: _docs(s, d).select("doc_id", F.transform(F.split("text", "\n"), lambda x: F.size(F.split(x, " \\| "))).alias("n")).select("doc_id", (F.array_max("n") == F.array_min("n")).alias("consistent")), "SELECT doc_id, list_max(n) = list_min(n) AS consistent FROM (SELECT doc_id, list_transform(string_split(text, chr(10)), lambda x: len(string_split(x, ' | '))) AS n FROM documents)")
query("h88_byte_ranges", lambda s, d: _docs(s, d).select("doc_id", F.posexplode(R.byte_ranges(F.col("n_chars").cast("int"), 4096)).alias("pos", "r")).select("doc_id", "pos", "r.start", "r.end"), 'SELECT doc_id, CAST(i AS INTEGER) AS pos, CAST(i * 4096 AS INTEGER) AS start, CAST(least((i + 1) * 4096, n_chars) AS INTEGER) AS "end" FROM (SELECT doc_id, n_chars, unnest(range(CAST(ceil(n_chars / 4096) AS BIGINT))) AS i FROM documents)')
query("h98_complexity", lambda s, d: _part(s, d).select("p_partkey", F.round(0.2 + 0.2 * F.least(F.col("p_size") / 20, F.lit(1.0)) + F.least((F.col("p_partkey") % 4) / 5, F.lit(0.3)) + F.least(F.col("p_size") / 20, F.lit(0.3)), 6).alias("complexity")), "SELECT p_partkey, round(0.2::DOUBLE + 0.2::DOUBLE * least(p_size / 20, 1.0) + least((p_partkey % 4) / 5, 0.3) + least(p_size / 20, 0.3), 6) AS complexity FROM part")
query("i04_path_edges", lambda s, d: G.complete_edges(PG.edges(s, d), G.reached(PG.edges(s, d), PG.nodes(s, d).filter("id = 'c1'"), 3, directed=True).select("id")).select("source", "target", "kind"), f"{PG.WITH}, w(id, hop) AS (SELECT 'c1', 0 UNION ALL SELECT target, hop + 1 FROM w JOIN e ON source = id WHERE hop < 3) SELECT source, target, kind FROM e WHERE source IN (SELECT id FROM w) AND target IN (SELECT id FROM w)")
query("j01_key_findings", lambda s, d: S.top(_line(s, d).select("l_orderkey", "l_linenumber", F.greatest("l_discount", "l_tax").alias("score")), 10, F.desc("score"), F.col("l_orderkey"), F.col("l_linenumber")), "SELECT l_orderkey, l_linenumber, greatest(l_discount, l_tax) AS score FROM lineitem ORDER BY score DESC, l_orderkey, l_linenumber LIMIT 10")
query("j02_top_concepts", lambda s, d: _docs(s, d).select(F.explode(F.split("text", " ")).alias("w")).filter(F.length("w") > 6).groupBy("w").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "w").limit(20), "SELECT w, count(*) AS n FROM (SELECT unnest(string_split(text, ' ')) AS w FROM documents) WHERE length(w) > 6 GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 20")
query(
    "j06_multi_query_fusion",
    lambda s, d: S.rank_fusion(_docs(s, d).select("doc_id", F.lower("text").alias("low")).select("doc_id", F.explode(F.array(*[F.struct(F.lit(q).alias("q"), (F.length("low") - F.length(F.replace("low", F.lit(q), F.lit("")))).alias("hits")) for q in ("thing", "with", "from")])).alias("h")).filter("h.hits > 0").withColumn("rank", F.row_number().over(Window.partitionBy("h.q").orderBy(F.desc("h.hits"), "doc_id"))).filter("rank <= 30"), "doc_id"),
    "WITH h AS (SELECT doc_id, q, length(lower(text)) - length(replace(lower(text), q, '')) AS hits FROM documents, (VALUES ('thing'), ('with'), ('from')) v(q)), r AS (SELECT *, row_number() OVER (PARTITION BY q ORDER BY hits DESC, doc_id) AS rank FROM h WHERE hits > 0) SELECT doc_id, round(sum(1.0 / (60 + rank)), 9) AS score, count(*) AS lists FROM r WHERE rank <= 30 GROUP BY 1",
)
query(
    "j11_best_adapters",
    lambda s, d: R.with_alternatives(_part(s, d).groupBy("p_brand", "p_type").agg(F.round(F.avg("p_retailprice"), 6).alias("score")), "p_brand", "p_type", "score"),
    "WITH s AS (SELECT p_brand, p_type, round(avg(p_retailprice), 6) AS score FROM part GROUP BY 1, 2), r AS (SELECT *, row_number() OVER (PARTITION BY p_brand ORDER BY score DESC, p_type) AS rank, max(score) OVER (PARTITION BY p_brand) AS best FROM s) SELECT p_brand, p_type, CAST(rank AS INTEGER) AS rank, round(best - score, 6) AS gap FROM r WHERE rank <= 3",
)
