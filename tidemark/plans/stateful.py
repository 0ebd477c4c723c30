"""Registered queries for order-dependent, chunking and streaming operators."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.functions import chunking as C
from tidemark.operators import stateful as S
from tidemark.plans.events import COOLED
from tidemark.registry import query
from tidemark.session import shared_dir, table
from tidemark.streaming import windows as W


def _shared(spark) -> str:
    """The folder that driver and executors share."""
    return shared_dir(spark)


#: Anchors one after the other: the next is the least centre beyond the last one's tolerance.
ANCHORED = """WITH RECURSIVE a AS (SELECT {by}, min({centre}) AS anchor FROM {table} GROUP BY 1 UNION ALL
    SELECT a.{by}, min(t.{centre}) FROM a JOIN {table} t ON t.{by} = a.{by} AND t.{centre} - a.anchor > {tolerance} GROUP BY a.{by}, a.anchor)
    SELECT t.{by}, t.{key}, max(a.anchor) AS anchor FROM {table} t JOIN a ON a.{by} = t.{by} AND a.anchor <= t.{centre} GROUP BY 1, 2"""

query(
    "e12_fixed_windows",
    lambda s, d: table(s, d, "documents").select("doc_id", F.posexplode(C.fixed_windows(F.col("text"))).alias("pos", "w")).select("doc_id", "pos", "w.*"),
    """WITH RECURSIVE d AS (SELECT doc_id, text, length(text) AS n FROM documents WHERE text <> ''),
    w(doc_id, pos, "start", "end") AS (SELECT doc_id, -1, CAST(0 AS BIGINT), CAST(0 AS BIGINT) FROM d UNION ALL
      SELECT doc_id, pos + 1, st, CASE WHEN plain < n THEN coalesce(least(CASE WHEN a > 0 THEN plain + a END, CASE WHEN b > 0 THEN plain + b END, CASE WHEN c > 0 THEN plain + c END), plain) ELSE n END
      FROM (SELECT doc_id, pos, n, st, plain, strpos(substr(text, plain + 1), '.') AS a, strpos(substr(text, plain + 1), chr(10)) AS b, strpos(substr(text, plain + 1), ' ') AS c
        FROM (SELECT w.doc_id, w.pos, d.n, d.text, CASE WHEN w.pos < 0 THEN 0 ELSE w."end" - 200 END AS st, least(CASE WHEN w.pos < 0 THEN 0 ELSE w."end" - 200 END + 1000, d.n) AS plain FROM w JOIN d USING (doc_id) WHERE w.pos < 0 OR w."end" < d.n)))
    SELECT doc_id, CAST(pos AS INTEGER) AS pos, CAST("start" AS INTEGER) AS "start", CAST("end" AS INTEGER) AS "end" FROM w WHERE pos >= 0""",
)
query(
    "h09_sections",
    lambda s, d: table(s, d, "documents").select("doc_id", F.explode(C.section_starts(F.col("text"))).alias("line")),
    f"""WITH RECURSIVE d AS (SELECT doc_id, string_split(text, chr(10)) AS l FROM documents),
    r(doc_id, i, size, cut) AS (SELECT doc_id, 0, length(l[1]) + 1, true FROM d UNION ALL
      SELECT doc_id, i + 1, CASE WHEN head OR size > 2000 THEN 0 ELSE size END + length(x) + 1, head OR size > 2000 FROM (SELECT r.doc_id, r.i, r.size, l[r.i + 2] AS x, regexp_matches(l[r.i + 2], '{'|'.join(C.HEADINGS)}') AS head FROM r JOIN d USING (doc_id) WHERE r.i + 1 < len(l)))
    SELECT doc_id, CAST(i AS INTEGER) AS line FROM r WHERE cut""",
)
query(
    "h15_packed_sentences",
    lambda s, d: table(s, d, "documents").select("doc_id", F.posexplode(C.packed_sentences(F.col("text"))).alias("pos", "segment")).select("doc_id", "pos", F.length("segment").alias("length")),
    r"""WITH RECURSIVE d AS (SELECT doc_id, text, string_split(regexp_replace(text, '([.!?])\s+', '\1' || chr(1), 'g'), chr(1)) AS l FROM documents WHERE length(text) > 1000),
    r(doc_id, i, open, closed) AS (SELECT doc_id, 0, '', NULL::VARCHAR FROM d UNION ALL
      SELECT doc_id, i + 1, CASE WHEN length(open) + length(x) + 1 > 1000 THEN x WHEN open = '' THEN x ELSE open || ' ' || x END, CASE WHEN length(open) + length(x) + 1 > 1000 AND open <> '' THEN open END FROM (SELECT r.*, l[r.i + 1] AS x FROM r JOIN d USING (doc_id) WHERE r.i < len(l))),
    s AS (SELECT doc_id, i, closed AS x FROM r WHERE closed IS NOT NULL UNION ALL SELECT r.doc_id, r.i + 1, open FROM r JOIN d USING (doc_id) WHERE r.i = len(l) AND open <> '' UNION ALL SELECT doc_id, 0, text FROM documents WHERE length(text) <= 1000)
    SELECT doc_id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY i) - 1 AS INTEGER) AS pos, CAST(length(x) AS INTEGER) AS length FROM s""",
)
query(
    "h10_adaptive_sizes",
    lambda s, d: table(s, d, "documents").select("doc_id", C.adaptive_sizes((F.col("doc_id") % 10) / 10, F.col("doc_id") % 7 == 0, F.col("doc_id") % 2 == 0).alias("c")).select("doc_id", "c.*"),
    "SELECT doc_id, CASE WHEN doc_id % 10 > 7 OR doc_id % 7 = 0 THEN 800 WHEN doc_id % 2 = 0 THEN 1200 ELSE 1500 END AS size, CASE WHEN doc_id % 10 > 7 OR doc_id % 7 = 0 THEN 250 WHEN doc_id % 2 = 0 THEN 200 ELSE 150 END AS overlap FROM documents",
)
query("e06_anchored_rows", lambda s, d: S.anchored_groups(table(s, d, "part").select("p_brand", "p_partkey", "p_retailprice"), "p_brand", "p_partkey", "p_retailprice", 25.0), ANCHORED.format(table="part", by="p_brand", key="p_partkey", centre="p_retailprice", tolerance="25.0"))
query("d19_greedy_clusters", lambda s, d: S.greedy_clusters(table(s, d, "part").select("p_brand", "p_partkey", "p_name"), "p_brand", "p_partkey", "p_name", 0.85))
query("h34_string_ratio", lambda s, d: table(s, d, "part").select("p_partkey", F.round(S.string_ratio("p_name", "p_type"), 6).alias("ratio")))
query(
    "k10_retried",
    lambda s, d: S.retried(table(s, d, "orders").select(F.col("o_orderkey").alias("entry"), (F.col("o_custkey") % 5).alias("retries"), (F.col("o_orderstatus") == "F").alias("succeeds"))).groupBy("state").agg(F.count("*").alias("n")),
    "SELECT CASE WHEN o_custkey % 5 >= 3 THEN 'remaining' WHEN o_orderstatus = 'F' THEN 'processed' ELSE 'failed' END AS state, count(*) AS n FROM orders GROUP BY 1",
)
query(
    "k11_cache_eviction",
    lambda s, d: S.evicted(table(s, d, "events").select(F.col("event_id").alias("entry"), F.col("ts").alias("last_used"), F.col("value").alias("size")), "2024-01-31", 14, 100_000.0),
    "SELECT entry, size FROM (SELECT event_id AS entry, value AS size, sum(value) OVER (ORDER BY ts DESC, event_id DESC ROWS UNBOUNDED PRECEDING) AS used FROM events WHERE ts >= TIMESTAMP '2024-01-17') WHERE round(used, 4) <= 100000.0",
)
query(
    "d30_box_relations",
    lambda s, d: S.box_relations(
        table(s, d, "lineitem").select("l_orderkey", "l_linenumber", (F.col("l_quantity")).alias("x1"), (F.col("l_discount") * 100).alias("y1"), (F.col("l_quantity") + 20).alias("x2"), (F.col("l_discount") * 100 + 4).alias("y2")), "l_orderkey", "l_linenumber"
    ).groupBy("relation").agg(F.count("*").alias("n")),
    """WITH b AS (SELECT l_orderkey AS o, l_linenumber AS k, l_quantity AS x1, l_discount * 100 AS y1, l_quantity + 20 AS x2, l_discount * 100 + 4 AS y2 FROM lineitem),
    p AS (SELECT a.*, c.x1 AS u1, c.y1 AS v1, c.x2 AS u2, c.y2 AS v2, least(a.x2, c.x2) - greatest(a.x1, c.x1) AS w, least(a.y2, c.y2) - greatest(a.y1, c.y1) AS h FROM b a JOIN b c ON a.o = c.o AND a.k <> c.k),
    r AS (SELECT CASE WHEN w > 0 AND h > 0 AND w * h / nullif((u2 - u1) * (v2 - v1), 0) > 0.9 THEN 'contains' WHEN w > 0 AND h > 0 AND w * h / nullif((x2 - x1) * (y2 - y1), 0) > 0.9 THEN 'contained_by' WHEN w > 0 AND h > 0 THEN 'overlaps' WHEN y2 < v1 THEN 'above' WHEN v2 < y1 THEN 'below' WHEN x2 < u1 THEN 'left_of' WHEN u2 < x1 THEN 'right_of' END AS relation FROM p)
    SELECT relation, count(*) AS n FROM r WHERE relation IS NOT NULL GROUP BY 1""",
)
query(
    "h16_word_error_rate",
    lambda s, d: table(s, d, "part").select("p_partkey", F.round(S.word_error_rate(F.col("p_name"), F.col("p_type")), 6).alias("wer")),
    r"""WITH w AS (SELECT p_partkey, list_filter(regexp_split_to_array(lower(p_name), '\s+'), lambda x: x <> '') AS a, list_filter(regexp_split_to_array(lower(p_type), '\s+'), lambda x: x <> '') AS b FROM part),
    k AS (SELECT *, list_distinct(list_concat(a, b)) AS k FROM w), c AS (SELECT p_partkey, len(a) AS n, array_to_string(list_transform(a, lambda x: chr(CAST(64 + list_position(k, x) AS INTEGER))), '') AS x, array_to_string(list_transform(b, lambda x: chr(CAST(64 + list_position(k, x) AS INTEGER))), '') AS y FROM k)
    SELECT p_partkey, round(levenshtein(x, y) / greatest(1, n), 6) AS wer FROM c""",
)
query(
    "f44_joined_parts",
    lambda s, d: S.joined_parts(table(s, d, "conversations").select(F.col("conv_id").alias("key"), F.col("turn").alias("pos"), F.col("role").alias("part"))),
    "SELECT conv_id AS key, string_agg(role, chr(10) ORDER BY turn) AS joined FROM conversations GROUP BY 1",
)
query(
    "k01_streamed_windows",
    lambda s, d: W.run_to_end(W.windowed_counts(W.event_stream(s, d), "1 day"), _shared(s), "complete").select(F.col("window.start").cast("timestamp_ntz").alias("start"), "event_type", "n", F.round("total", 4).alias("total")),
    "SELECT date_trunc('day', ts)::TIMESTAMP AS start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1, 2",
)
query("k06_streamed_thresholds", lambda s, d: W.run_to_end(W.threshold_events(W.event_stream(s, d), 300.0), _shared(s)).select("event_id", "event_type", "value"), "SELECT event_id, event_type, value FROM events WHERE value > 300.0")
query("e11_streamed_cooldown", lambda s, d: W.run_to_end(W.cooled_down(W.event_stream(s, d).filter("event_type = 'error'"), 3600), _shared(s)), COOLED)
