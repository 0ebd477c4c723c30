"""Registered graph queries; nations, customers, suppliers and regions are the entities, foreign keys and orders the edges."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.operators import graph as G
from tidemark.registry import query
from tidemark.session import table


def nodes(spark, sf):
    """(id, kind, label, confidence) of regions, nations, customers and suppliers."""
    t = lambda n: table(spark, sf, n)
    return (
        t("region").select(F.concat(F.lit("r"), "r_regionkey").alias("id"), F.lit("Region").alias("kind"), F.col("r_name").alias("label"), F.lit(1.0).alias("confidence"))
        .unionByName(t("nation").select(F.concat(F.lit("n"), "n_nationkey").alias("id"), F.lit("Nation").alias("kind"), F.col("n_name").alias("label"), F.lit(0.9).alias("confidence")))
        .unionByName(t("customer").select(F.concat(F.lit("c"), "c_custkey").alias("id"), F.lit("Customer").alias("kind"), F.col("c_name").alias("label"), (F.pmod("c_custkey", F.lit(10)) / 10).alias("confidence")))
        .unionByName(t("supplier").select(F.concat(F.lit("s"), "s_suppkey").alias("id"), F.lit("Supplier").alias("kind"), F.col("s_name").alias("label"), (F.pmod("s_suppkey", F.lit(10)) / 10).alias("confidence")))
    )


def edges(spark, sf):
    """(source, target, kind, confidence) of the foreign keys."""
    t = lambda n: table(spark, sf, n)
    key = lambda p, c: F.concat(F.lit(p), c)
    return (
        t("nation").select(key("n", "n_nationkey").alias("source"), key("r", "n_regionkey").alias("target"), F.lit("PART_OF").alias("kind"), F.lit(1.0).alias("confidence"))
        .unionByName(t("customer").select(key("c", "c_custkey").alias("source"), key("n", "c_nationkey").alias("target"), F.lit("LIVES_IN").alias("kind"), F.lit(0.8).alias("confidence")))
        .unionByName(t("supplier").select(key("s", "s_suppkey").alias("source"), key("n", "s_nationkey").alias("target"), F.lit("LOCATED_IN").alias("kind"), F.lit(0.7).alias("confidence")))
    )


N = """n AS (SELECT 'r' || r_regionkey AS id, 'Region' AS kind, r_name AS label, 1.0::DOUBLE AS confidence FROM region UNION ALL SELECT 'n' || n_nationkey, 'Nation', n_name, 0.9::DOUBLE FROM nation
 UNION ALL SELECT 'c' || c_custkey, 'Customer', c_name, (c_custkey % 10) / 10 FROM customer UNION ALL SELECT 's' || s_suppkey, 'Supplier', s_name, (s_suppkey % 10) / 10 FROM supplier)"""
M = """e AS (SELECT 'n' || n_nationkey AS source, 'r' || n_regionkey AS target, 'PART_OF' AS kind, 1.0::DOUBLE AS confidence FROM nation UNION ALL SELECT 'c' || c_custkey, 'n' || c_nationkey, 'LIVES_IN', 0.8::DOUBLE FROM customer
 UNION ALL SELECT 's' || s_suppkey, 'n' || s_nationkey, 'LOCATED_IN', 0.7::DOUBLE FROM supplier)"""
WITH = f"WITH RECURSIVE {N}, {M}"

query("c09_entities_of_kind", lambda s, d: nodes(s, d).filter("kind = 'Nation'").select("id", "label"), f"{WITH} SELECT id, label FROM n WHERE kind = 'Nation'")
query("c13_displayed_nodes", lambda s, d: G.displayed(nodes(s, d)), f"{WITH} SELECT id, substr(label, 1, 20) AS label, round(confidence * 10, 6) AS size, round(confidence * 3, 6) AS width FROM n WHERE confidence >= 0.5")
query(
    "c10_pruned_graph",
    lambda s, d: G.pruned(nodes(s, d), edges(s, d), 0.3, 300, 2)[0].select("id", "kind", "confidence"),
    f"""{WITH}, k AS (SELECT * FROM n WHERE confidence >= 0.3 ORDER BY confidence DESC, id LIMIT 300), i AS (SELECT e.* FROM e JOIN k a ON a.id = source JOIN k b ON b.id = target),
    g AS (SELECT id FROM (SELECT source AS id FROM i UNION ALL SELECT target FROM i) GROUP BY id HAVING count(*) >= 2) SELECT k.id, k.kind, k.confidence FROM k JOIN g USING (id)""",
)
query(
    "c12_graph_page",
    lambda s, d: G.page(nodes(s, d), edges(s, d), 2, 50)[0].select("id", "label"),
    f"{WITH} SELECT id, label FROM n ORDER BY id LIMIT 50 OFFSET 50",
)
query(
    "c11_progressive_batches",
    lambda s, d: nodes(s, d).filter("kind = 'Customer'").groupBy(F.floor(F.substring("id", 2, 20).cast("long") / 100).alias("batch")).agg(F.count("*").alias("n"), F.min("id").alias("first")),
    f"{WITH} SELECT CAST(substr(id, 2) AS BIGINT) // 100 AS batch, count(*) AS n, min(id) AS first FROM n WHERE kind = 'Customer' GROUP BY 1",
)
query(
    "d01_edge_index",
    lambda s, d: edges(s, d).join(nodes(s, d).select(F.col("id").alias("source"), F.col("kind").alias("from_kind")), "source").join(nodes(s, d).select(F.col("id").alias("target"), F.col("kind").alias("to_kind")), "target").groupBy("kind", "from_kind", "to_kind").agg(F.count("*").alias("n")),
    f"{WITH} SELECT e.kind, a.kind AS from_kind, b.kind AS to_kind, count(*) AS n FROM e JOIN n a ON a.id = source JOIN n b ON b.id = target GROUP BY 1, 2, 3",
)
_some = lambda s, d: nodes(s, d).filter("kind != 'Nation' OR label < 'J'")
query("d02_dangling_edges", lambda s, d: G.dangling_edges(edges(s, d), _some(s, d)).select("source", "target"), f"{WITH} SELECT source, target FROM e WHERE source NOT IN (SELECT id FROM n WHERE kind <> 'Nation' OR label < 'J') OR target NOT IN (SELECT id FROM n WHERE kind <> 'Nation' OR label < 'J')")
query("d02_complete_edges", lambda s, d: G.complete_edges(edges(s, d), _some(s, d)).select("source", "target"), f"{WITH}, m AS (SELECT id FROM n WHERE kind <> 'Nation' OR label < 'J') SELECT source, target FROM e WHERE source IN (SELECT id FROM m) AND target IN (SELECT id FROM m)")
query(
    "d03_cascade_delete",
    lambda s, d: G.updated(nodes(s, d), edges(s, d), nodes(s, d).limit(0), nodes(s, d).filter("kind = 'Nation' AND label >= 'J'"))[1].groupBy("kind").agg(F.count("*").alias("n")),
    f"{WITH}, g AS (SELECT id FROM n WHERE kind = 'Nation' AND label >= 'J') SELECT kind, count(*) AS n FROM e WHERE source NOT IN (SELECT id FROM g) AND target NOT IN (SELECT id FROM g) GROUP BY 1",
)
query(
    "g01_merged_nodes",
    lambda s, d: G.merged_nodes(nodes(s, d).withColumn("ord", F.lit(0)).unionByName(nodes(s, d).filter("kind = 'Supplier'").withColumn("ord", F.lit(1)).withColumn("confidence", F.lit(0.55)))).select("id", "kind", "confidence", "sources"),
    f"{WITH} SELECT id, kind, CASE WHEN kind = 'Supplier' THEN greatest(confidence, 0.55::DOUBLE) ELSE confidence END AS confidence, CAST(CASE WHEN kind = 'Supplier' THEN 2 ELSE 1 END AS BIGINT) AS sources FROM n",
)
_trade = lambda s, d: table(s, d, "lineitem").select(F.col("l_partkey").alias("source"), F.col("l_suppkey").alias("target"), F.col("l_returnflag").alias("kind"), F.col("l_discount").alias("confidence"))
query("g03_distinct_edges", lambda s, d: G.distinct_edges(_trade(s, d), directed=False), "SELECT least(l_partkey, l_suppkey) AS source, greatest(l_partkey, l_suppkey) AS target, l_returnflag AS kind, max(l_discount) AS confidence FROM lineitem GROUP BY 1, 2, 3")
query("f35_contradictions", lambda s, d: G.contradictions(_trade(s, d)), "SELECT l_partkey AS source, l_returnflag AS kind, l_suppkey AS target, count(*) AS n FROM lineitem GROUP BY 1, 2, 3 HAVING count(*) > 1")
query(
    "f07_structure",
    lambda s, d: G.structure(nodes(s, d), edges(s, d)),
    f"{WITH}, m AS (SELECT count(*) AS m FROM (SELECT DISTINCT least(source, target), greatest(source, target) FROM e)), c AS (SELECT count(*) AS c FROM n) SELECT c AS nodes, m AS edges, round(2 * m / c, 6) AS avg_degree, round(2 * m / (c * (c - 1)), 9) AS density FROM m, c",
)
query("f07_degrees", lambda s, d: G.degrees(edges(s, d)).orderBy(F.desc("degree"), "id").limit(20), f"{WITH} SELECT id, count(*) AS degree FROM (SELECT source AS id FROM e UNION ALL SELECT target FROM e) GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 20")
query(
    "f07_components",
    lambda s, d: G.components(nodes(s, d), edges(s, d)).groupBy("component").agg(F.count("*").alias("n")),
    f"""{WITH}, region_of AS (SELECT 'n' || n_nationkey AS nation, 'r' || n_regionkey AS root FROM nation),
    member AS (SELECT id, CASE WHEN id LIKE 'r%' THEN id WHEN id LIKE 'n%' THEN (SELECT root FROM region_of WHERE nation = id) ELSE (SELECT root FROM e JOIN region_of ON nation = target WHERE source = id) END AS root FROM n)
    SELECT min(id) AS component, count(*) AS n FROM member GROUP BY root""",
)
query(
    "f08_ontology",
    lambda s, d: G.ontology_counts(nodes(s, d), edges(s, d), ["Nation", "Customer", "Region"], nodes(s, d).sparkSession.createDataFrame([("PART_OF", "Nation", "Region"), ("LIVES_IN", "Customer", "Nation")], "kind string, domain string, range string")),
    f"{WITH}, c AS (SELECT (SELECT count(*) FROM n) AS entities, (SELECT count(*) FROM n WHERE kind <> 'Supplier') AS valid_entities, (SELECT count(*) FROM e) AS edges, (SELECT count(*) FROM e WHERE kind <> 'LOCATED_IN') AS valid_edges) SELECT *, round((valid_entities + valid_edges) / (entities + edges), 6) AS consistency FROM c",
)
query("f10_completeness", lambda s, d: G.completeness(table(s, d, "customer").withColumn("c_acctbal", F.when(F.col("c_acctbal") > 0, F.col("c_acctbal"))), "c_mktsegment", ["c_name", "c_acctbal"]), "SELECT c_mktsegment, count(*) AS entities, round(avg((1 + CAST(c_acctbal > 0 AS INTEGER)) / 2), 6) AS completeness, count(c_name) AS has_c_name, count(CASE WHEN c_acctbal > 0 THEN 1 END) AS has_c_acctbal FROM customer GROUP BY 1")
query("f09_interlinking", lambda s, d: nodes(s, d).join(edges(s, d).select(F.col("source").alias("id")).distinct().withColumn("linked", F.lit(1)), "id", "left").groupBy("kind").agg(F.round(F.avg(F.coalesce("linked", F.lit(0))), 6).alias("share")), f"{WITH} SELECT kind, round(avg(CAST(id IN (SELECT source FROM e) AS INTEGER)), 6) AS share FROM n GROUP BY 1")
query("f14_graph_summary", lambda s, d: nodes(s, d).groupBy(F.lit("entity").alias("of"), "kind").agg(F.count("*").alias("n")).unionByName(edges(s, d).groupBy(F.lit("edge").alias("of"), "kind").agg(F.count("*").alias("n"))), f"{WITH} SELECT 'entity' AS of, kind, count(*) AS n FROM n GROUP BY 2 UNION ALL SELECT 'edge', kind, count(*) FROM e GROUP BY 2")
query("f12_query_potential", lambda s, d: nodes(s, d).agg(F.countDistinct("kind").alias("kinds")).withColumn("one", F.lit(1)).join(edges(s, d).agg(F.countDistinct("kind").alias("edge_kinds")).withColumn("one", F.lit(1)), "one").select("kinds", "edge_kinds", (F.col("kinds") * F.col("edge_kinds")).alias("potential")), f"{WITH} SELECT (SELECT count(DISTINCT kind) FROM n) AS kinds, (SELECT count(DISTINCT kind) FROM e) AS edge_kinds, (SELECT count(DISTINCT kind) FROM n) * (SELECT count(DISTINCT kind) FROM e) AS potential")
query(
    "i03_k_hop",
    lambda s, d: G.reached(edges(s, d), nodes(s, d).filter("id = 'n3'"), 2).groupBy("hop").agg(F.count("*").alias("n")),
    f"""{WITH}, b AS (SELECT source AS a, target AS z FROM e UNION ALL SELECT target, source FROM e), one AS (SELECT DISTINCT z FROM b WHERE a = 'n3'), two AS (SELECT DISTINCT b.z FROM b JOIN one ON a = one.z WHERE b.z <> 'n3' AND b.z NOT IN (SELECT z FROM one))
    SELECT 0 AS hop, 1 AS n UNION ALL SELECT 1, count(*) FROM one UNION ALL SELECT 2, count(*) FROM two""",
)
query(
    "i01_shortest_path",
    lambda s, d: G.reached(edges(s, d), nodes(s, d).filter("id = 'c1'"), 5, directed=True).filter("id LIKE 'r%'").select("id", F.col("hop").alias("length")),
    f"{WITH}, w(id, hop) AS (SELECT 'c1', 0 UNION ALL SELECT target, hop + 1 FROM w JOIN e ON source = id WHERE hop < 5) SELECT id, min(hop) AS length FROM w WHERE id LIKE 'r%' GROUP BY 1",
)
query(
    "d20_edges_of_relevant",
    lambda s, d: edges(s, d).withColumn("end", F.explode(F.array("source", "target"))).join(nodes(s, d).filter("kind = 'Nation' AND contains(label, 'AN')").select(F.col("id").alias("end")), "end", "left_semi").select("source", "target", "kind").distinct().groupBy("kind").agg(F.count("*").alias("n")),
    f"{WITH}, r AS (SELECT id FROM n WHERE kind = 'Nation' AND contains(label, 'AN')) SELECT kind, count(*) AS n FROM e WHERE source IN (SELECT id FROM r) OR target IN (SELECT id FROM r) GROUP BY 1",
)
query("i05_hyperedges_of_node", lambda s, d: table(s, d, "lineitem").groupBy("l_partkey").agg(F.countDistinct("l_orderkey").alias("hyperedges")), "SELECT l_partkey, count(DISTINCT l_orderkey) AS hyperedges FROM lineitem GROUP BY 1")
query("i06_nodes_of_hyperedge", lambda s, d: table(s, d, "lineitem").groupBy("l_orderkey").agg(F.countDistinct("l_partkey").alias("nodes")), "SELECT l_orderkey, count(DISTINCT l_partkey) AS nodes FROM lineitem GROUP BY 1")
query("i08_hyperedges_of_kind", lambda s, d: table(s, d, "orders").filter("o_orderpriority = '1-URGENT'").join(table(s, d, "lineitem"), F.col("o_orderkey") == F.col("l_orderkey")).groupBy("o_orderkey").agg(F.count("*").alias("size")), "SELECT o_orderkey, count(*) AS size FROM orders JOIN lineitem ON o_orderkey = l_orderkey WHERE o_orderpriority = '1-URGENT' GROUP BY 1")


def _mentions(s, d):
    """Places of two words in every document."""
    words = table(s, d, "documents").select("doc_id", F.split("text", " ").alias("w"))
    long = words.select("doc_id", F.posexplode("w").alias("start", "ent")).filter(F.col("ent").isin("idiot", "trash", "clown", "scum"))
    return long.select("doc_id", "ent", "start", F.col("start").alias("end"))


query(
    "d05_cooccurring",
    lambda s, d: G.cooccurring(_mentions(s, d)),
    """WITH m AS MATERIALIZED (SELECT doc_id, l[i] AS ent, i - 1 AS start FROM (SELECT doc_id, l, unnest(list_filter(range(1, len(l) + 1), lambda i: l[i] IN ('idiot', 'trash', 'clown', 'scum'))) AS i FROM (SELECT doc_id, string_split(text, ' ') AS l FROM documents)))
    SELECT a.doc_id, a.ent AS a, b.ent AS b, CAST(b.start - a.start AS INTEGER) AS gap, round(greatest(0.5, 1 - (b.start - a.start) / 50), 6) AS confidence FROM m a JOIN m b ON a.doc_id = b.doc_id AND b.start > a.start AND b.start - a.start <= 50""",
)
query(
    "g13_first_entity",
    lambda s, d: table(s, d, "lineitem").groupBy("l_returnflag", "l_suppkey").agg(F.min(F.struct("l_orderkey", "l_linenumber")).alias("f")).select("l_returnflag", "l_suppkey", "f.l_orderkey", "f.l_linenumber"),
    "SELECT l_returnflag, l_suppkey, l_orderkey, l_linenumber FROM (SELECT *, row_number() OVER (PARTITION BY l_returnflag, l_suppkey ORDER BY l_orderkey, l_linenumber) r FROM lineitem) WHERE r = 1",
)
query(
    "g14_boosted_entity",
    lambda s, d: table(s, d, "lineitem").groupBy("l_returnflag", "l_partkey").agg(F.round(F.least(F.lit(1.0), F.max("l_discount") + 0.1 * (F.count("*") - 1)), 6).alias("confidence"), F.countDistinct("l_suppkey").alias("sources")),
    "SELECT l_returnflag, l_partkey, round(least(1.0, max(l_discount) + 0.1::DOUBLE * (count(*) - 1)), 6) AS confidence, count(DISTINCT l_suppkey) AS sources FROM lineitem GROUP BY 1, 2",
)

_TERMS = "00012 asia"
_OWN = f"""{WITH}, own AS (SELECT id FROM n WHERE {' OR '.join(f"contains(lower(label || ' ' || kind), '{t}')" for t in _TERMS.split())}),
    every AS (SELECT id FROM own UNION SELECT target FROM e JOIN own ON source = id UNION SELECT source FROM e JOIN own ON target = id)"""
query("d23_term_subgraph_nodes", lambda s, d: G.term_subgraph(nodes(s, d), edges(s, d), _TERMS)[0].select("id", "label"), f"{_OWN} SELECT id, label FROM n JOIN every USING (id)")
query("d23_term_subgraph_edges", lambda s, d: G.term_subgraph(nodes(s, d), edges(s, d), _TERMS)[1].select("source", "target", "kind"), f"{_OWN} SELECT source, target, e.kind FROM e JOIN every a ON a.id = source JOIN every b ON b.id = target")
