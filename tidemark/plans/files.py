"""Registered queries for readers and writers: the tables are written to the shared folder in a format and read back by the library's reader."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from tidemark.operators import stateful as S
from tidemark.registry import query
from tidemark.session import shared_dir, table
from tidemark.sources import mixed, readers, writers
from tidemark.streaming import windows as W


def t(name):
    return lambda s, d: table(s, d, name)


_docs, _orders, _part, _cust, _pages, _events, _line = map(t, ("documents", "orders", "part", "customer", "pages", "events", "lineitem"))


def _at(s, what: str) -> str:
    return f"{shared_dir(s)}/{what}-{uuid.uuid4().hex}"


def _csv(s, d):
    path = _at(s, "csv")
    _cust(s, d).select("c_custkey", "c_name", F.concat(F.lit('a,"'), "c_mktsegment", F.lit('"')).alias("q")).write.csv(path, header=True, escape='"')
    return readers.csv(s, path)


query("a01_csv", lambda s, d: _csv(s, d), "SELECT CAST(c_custkey AS VARCHAR) AS c_custkey, c_name, 'a,\"' || c_mktsegment || '\"' AS q FROM customer")


def _json(s, d):
    path = _at(s, "json")
    _part(s, d).select("p_partkey", "p_name", F.struct("p_size", "p_brand").alias("of")).write.json(path)
    return path


query("a02_json_documents", lambda s, d: readers.ndjson(s, _json(s, d), "p_partkey long, p_name string, of struct<p_size: long, p_brand: string>").select("p_partkey", "p_name", "of.p_size", "of.p_brand"), "SELECT p_partkey, p_name, CAST(p_size AS BIGINT) AS p_size, p_brand FROM part")


def _lines(s, d):
    """Orders as JSON lines, every seventh of which is cut off."""
    path = _at(s, "ndjson")
    whole = F.to_json(F.struct("o_orderkey", "o_orderstatus"))
    _orders(s, d).select(F.when(F.col("o_orderkey") % 7 == 0, F.substring(whole, 1, 12)).otherwise(whole).alias("value")).write.text(path)
    return path


query("a22_ndjson", lambda s, d: readers.ndjson(s, _lines(s, d), "o_orderkey long, o_orderstatus string"), "SELECT o_orderkey, o_orderstatus FROM orders WHERE o_orderkey % 7 <> 0")
_marked = lambda s, d: _docs(s, d).select(F.col("doc_id").cast("string").alias("path"), F.concat(F.lit("# "), "source", F.lit("\n\n## "), "lang", F.lit("\n"), "text").alias("text"))  # noqa: E731
query(
    "a04_markdown",
    lambda s, d: readers.markdown(_marked(s, d)).groupBy("path", "kind", "level").agg(F.count("*").alias("n"), F.sum(F.length("text")).alias("chars")),
    r"""WITH l AS (SELECT CAST(doc_id AS VARCHAR) AS path, unnest(string_split('# ' || source || chr(10) || chr(10) || '## ' || lang || chr(10) || text, chr(10))) AS x FROM documents),
    m AS (SELECT path, length(regexp_extract(x, '^(#{1,6})\s', 1)) AS level, regexp_replace(x, '^#{1,6}\s+', '') AS t FROM l WHERE trim(x, ' ') <> '')
    SELECT path, CASE WHEN level > 0 THEN 'heading' ELSE 'paragraph' END AS kind, CAST(level AS INTEGER) AS level, count(*) AS n, CAST(sum(length(t)) AS BIGINT) AS chars FROM m GROUP BY ALL""",
)


def _xml(s, d):
    path = _at(s, "xml")
    _cust(s, d).select("c_custkey", "c_name", "c_mktsegment").write.format("xml").option("rowTag", "customer").option("rootTag", "customers").save(path)
    return readers.xml(s, path, "customer")


query("a06_xml", lambda s, d: _xml(s, d).select("c_custkey", "c_name", "c_mktsegment"), "SELECT c_custkey, c_name, c_mktsegment FROM customer")
_headed = lambda s, d: _pages(s, d).select("page_id", F.concat(F.lit('<html><head><meta name="author" content="'), "url", F.lit('"><meta property="og:title" content="t'), "page_id", F.lit('"></head>'), "html").alias("html"))  # noqa: E731
query("a12_html_metadata", lambda s, d: _headed(s, d).select("page_id", readers.html_parts(F.col("html"))["meta"].alias("m")).select("page_id", F.explode("m").alias("name", "content")), "SELECT page_id, 'author' AS name, url AS content FROM pages UNION ALL SELECT page_id, 'og:title', 't' || page_id FROM pages")
query(
    "a15_table_rows",
    lambda s, d: _cust(s, d).select("c_custkey", F.posexplode(readers.html_rows(F.concat(F.lit("<table><tr><th>name</th><th>nation</th></tr><tr class='x'><td>"), "c_name", F.lit("</td>\n<td>"), "c_nationkey", F.lit("</td></tr></table>")))).alias("row", "cells")).select("c_custkey", "row", F.array_join("cells", "|").alias("cells")),
    "SELECT c_custkey, CAST(0 AS INTEGER) AS row, 'name|nation' AS cells FROM customer UNION ALL SELECT c_custkey, 1, c_name || '|' || c_nationkey FROM customer",
)


def _folder(s, d):
    """A folder for each language with a text file and a JSON file of its documents' numbers."""
    path = _at(s, "folder")
    docs = _docs(s, d).select("lang", F.col("doc_id").cast("string").alias("value")).repartition(4, "lang")
    docs.write.partitionBy("lang").text(f"{path}/texts")
    docs.write.partitionBy("lang").json(f"{path}/json")
    return path


query("a20_a44_a53_files", lambda s, d: readers.files(s, _folder(s, d), "*.*").filter("extension IN ('txt', 'json')").groupBy("extension", "handler", F.regexp_extract("path", "lang=([a-z]+)", 1).alias("lang")).agg(F.sum((F.col("length") > 0).cast("int")).alias("files")), "SELECT DISTINCT unnest(['txt', 'json']) AS extension, unnest(['text', 'json']) AS handler, lang, CAST(1 AS BIGINT) AS files FROM documents")


def _mixed(s, d):
    """Documents by the remainder of their number: JSON lines, delimited rows, and text and XML files of a block of documents each; all read by one source."""
    path = _at(s, "mixed")
    docs = _docs(s, d).select("doc_id", "text", F.expr("doc_id DIV 200").alias("block"))
    part = lambda n: docs.filter(F.pmod("doc_id", F.lit(4)) == n)  # noqa: E731
    blocks = lambda n: part(n).repartition("block").sortWithinPartitions("block", "doc_id")  # noqa: E731
    part(0).select("doc_id", "text").write.json(f"{path}/json")
    part(1).select("doc_id", "text").write.csv(f"{path}/csv", header=True, escape='"', quoteAll=True, ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False)
    blocks(2).select("block", "text").write.partitionBy("block").text(f"{path}/text")
    blocks(3).select("block", "text").write.partitionBy("block").format("xml").option("rowTag", "p").save(f"{path}/xml")
    mixed.register(s)
    found = s.read.format("mixed").load(path).filter("handler IN ('json', 'csv', 'text', 'xml')")
    item = F.coalesce(F.try_element_at("attributes", F.lit("doc_id")), F.regexp_extract("path", "(block=[0-9]+)", 1))
    return found.select("handler", item.alias("item"), F.length("text").alias("chars"), F.md5("text").alias("digest"))


query(
    "l01_l09_mixed_folder",
    _mixed,
    r"""WITH d AS (SELECT doc_id, text, doc_id % 4 AS part, 'block=' || (doc_id // 200) AS block FROM documents),
    r AS (SELECT CASE part WHEN 0 THEN 'json' ELSE 'csv' END AS handler, CAST(doc_id AS VARCHAR) AS item, text AS x FROM d WHERE part < 2
      UNION ALL SELECT 'text', block, string_agg(text, chr(10) ORDER BY doc_id) || chr(10) FROM d WHERE part = 2 GROUP BY block
      UNION ALL SELECT 'xml', block, trim(regexp_replace(string_agg(text, ' ' ORDER BY doc_id), '[ 	
]+', ' ', 'g'), ' ') FROM d WHERE part = 3 GROUP BY block)
    SELECT handler, item, CAST(length(x) AS INTEGER) AS chars, md5(x) AS digest FROM r""",
)


def _ontology(s, d):
    path = _at(s, "ontology")
    kinds = _part(s, d).select("p_brand", "p_type").distinct().groupBy("p_brand").agg(F.sort_array(F.collect_set("p_type")).alias("types"))
    made = kinds.agg(F.map_from_entries(F.collect_list(F.struct(F.col("p_brand"), F.struct(F.col("types").alias("required"), F.array().cast("array<string>").alias("optional"))))).alias("entity_types"))
    made.select("entity_types", F.create_map(F.lit("LIKES"), F.struct(F.array(F.lit("Brand#1"), F.lit("Brand#2")).alias("domain"), F.array(F.lit("Brand#3")).alias("range"))).alias("relationship_types")).coalesce(1).write.json(path)
    return readers.ontology(s, path)


query("a42_ontology", lambda s, d: _ontology(s, d)[0].select("kind", F.array_join("required", ",").alias("required")), "SELECT p_brand AS kind, array_to_string(list_sort(list(DISTINCT p_type)), ',') AS required FROM part GROUP BY 1")
# Writers.
query("b01_metrics_as_json", lambda s, d: writers.json_lines(_events(s, d).groupBy("event_type").agg(F.count("*").alias("n"), F.max("user_id").alias("most"))), "SELECT '{\"event_type\":\"' || event_type || '\",\"n\":' || count(*) || ',\"most\":' || max(user_id) || '}' AS line FROM events GROUP BY event_type")


def _daily(s, d):
    path = _at(s, "daily")
    writers.write_daily(_events(s, d).filter("event_type = 'error'").select("event_id", "ts", "value"), path)
    return s.read.schema("event_id long, ts timestamp_ntz, value double, day date").json(path).groupBy("day").agg(F.count("*").alias("n"), F.sum("event_id").alias("ids"))


query("b05_daily_alerts", _daily, "SELECT CAST(ts AS DATE) AS day, count(*) AS n, CAST(sum(event_id) AS BIGINT) AS ids FROM events WHERE event_type = 'error' GROUP BY 1")
query("b06_redacted_requests", lambda s, d: writers.redacted(_events(s, d).select("event_id", F.concat(F.lit('{"api_key": "'), "event_type", F.lit('", "password":"p'), "user_id", F.lit('", "k": '), "event_id", F.lit("}")).alias("data"))), "SELECT event_id, '{\"api_key\": \"***\", \"password\":\"***\", \"k\": ' || event_id || '}' AS data FROM events")
query("b07_model_events", lambda s, d: _events(s, d).select("event_id", F.to_json(F.struct(F.concat(F.lit("model_"), "event_type").alias("type"), F.struct(F.col("user_id").alias("id"), F.lit("local").alias("provider")).alias("model"), F.floor(F.col("value") * 1000).alias("duration_ms"), F.when(F.col("event_type") == "error", F.struct(F.lit("failed").alias("message"))).alias("error"))).alias("event")), "SELECT event_id, '{\"type\":\"model_' || event_type || '\",\"model\":{\"id\":' || user_id || ',\"provider\":\"local\"},\"duration_ms\":' || CAST(floor(value * 1000) AS BIGINT) || CASE WHEN event_type = 'error' THEN ',\"error\":{\"message\":\"failed\"}' ELSE '' END || '}' AS event FROM events")
query("b10_markdown_rows", lambda s, d: writers.markdown_rows(_cust(s, d).select("c_custkey", F.concat_ws("|", "c_name", "c_mktsegment").alias("n"))), r"SELECT '| ' || c_custkey || ' | ' || c_name || '\|' || c_mktsegment || ' |' AS line FROM customer")
query("b11_hypergraph_export", lambda s, d: writers.json_lines(_line(s, d).groupBy(F.col("l_orderkey").alias("edge")).agg(F.sort_array(F.collect_set("l_partkey")).alias("nodes"))), "SELECT '{\"edge\":' || l_orderkey || ',\"nodes\":[' || array_to_string(list_sort(list(DISTINCT l_partkey)), ',') || ']}' AS line FROM lineitem GROUP BY l_orderkey")
query("b13_dead_letters", lambda s, d: writers.dead_letters(_docs(s, d).filter("n_chars < 100").select("doc_id", "source"), "too short"), "SELECT doc_id, source, 'too short' AS error, CAST(0 AS INTEGER) AS retries, sha256('too short|' || doc_id || '|' || source) AS entry FROM documents WHERE n_chars < 100")
query("k05_typed_events", lambda s, d: W.run_to_end(W.event_stream(s, d).filter(F.col("event_type").isin("click", "purchase")).select("event_id", "event_type"), shared_dir(s)), "SELECT event_id, event_type FROM events WHERE event_type IN ('click', 'purchase')")
query(
    "k15_transcript_cache",
    lambda s, d: S.evicted(_orders(s, d).select(F.col("o_orderkey").alias("entry"), F.col("o_orderdate").cast("timestamp_ntz").alias("last_used"), F.col("o_totalprice").alias("size")), "1998-12-01", 300, 5e7),
    "SELECT entry, size FROM (SELECT o_orderkey AS entry, o_totalprice AS size, sum(o_totalprice) OVER (ORDER BY o_orderdate DESC, o_orderkey DESC ROWS UNBOUNDED PRECEDING) AS used FROM orders WHERE o_orderdate >= TIMESTAMP '1998-12-01' - INTERVAL 300 DAY) WHERE round(used, 4) <= 5e7",
)
