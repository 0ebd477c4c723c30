"""Registered queries for entity resolution, layout, forms, ontologies and hyperedges."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.functions import extract as X
from tidemark.functions import text as T
from tidemark.operators import forms as FO
from tidemark.operators import layout as L
from tidemark.operators import ontology as O
from tidemark.operators import resolution as R
from tidemark.operators import stateful as S
from tidemark.plans import graph as PG
from tidemark.plans.stateful import ANCHORED
from tidemark.registry import query
from tidemark.session import table


def t(name):
    return lambda s, d: table(s, d, name)


_docs, _line, _orders, _part, _cust = map(t, ("documents", "lineitem", "orders", "part", "customer"))


def similar_customers(s, d):
    """Customers against the next of their numbers, by kind, name and balance."""
    c = _cust(s, d).select("c_custkey", "c_mktsegment", "c_name", F.create_map(F.lit("balance"), "c_acctbal", F.lit("nation"), F.col("c_nationkey").cast("double")).alias("p"))
    other = c.select((F.col("c_custkey") - 1).alias("c_custkey"), F.col("c_mktsegment").alias("kind"), F.col("c_name").alias("name"), F.col("p").alias("q"))
    same = R.entity_similarity((F.col("c_mktsegment"), F.col("kind")), S.string_ratio(F.lower("c_name"), F.lower("name")), X.property_similarity(F.col("p"), F.col("q")))
    return c.join(other, "c_custkey").select("c_custkey", F.round(same, 9).alias("similarity"))


query("h40_entity_similarity", similar_customers)


def _records(s, d):
    """Customers as records of one company a nation and segment, with the properties that they have."""
    p = F.map_from_arrays(F.array(*map(F.lit, ("credit", "debt", "name", "segment"))), F.array(F.when(F.col("c_acctbal") > 0, "yes"), F.when(F.col("c_acctbal") < -500, "yes"), "c_name", "c_mktsegment"))
    return _cust(s, d).select(F.concat_ws("/", "c_nationkey", "c_mktsegment").alias("cluster"), F.col("c_custkey").alias("id"), F.map_filter(p, lambda k, v: v.isNotNull()).alias("properties"))


query(
    "g07_merged_records",
    lambda s, d: R.merged_records(_records(s, d)).select("cluster", "base", "merged", F.array_join(F.transform(F.array_sort(F.map_entries("properties")), lambda e: F.concat_ws("=", e["key"], e["value"])), ",").alias("properties")),
    """WITH p AS (SELECT c_nationkey || '/' || c_mktsegment AS cluster, c_custkey AS id, unnest(['credit', 'debt', 'name', 'segment']) AS k, unnest([CASE WHEN c_acctbal > 0 THEN 'yes' END, CASE WHEN c_acctbal < -500 THEN 'yes' END, c_name, c_mktsegment]) AS v FROM customer),
    n AS (SELECT *, count(*) OVER (PARTITION BY id) AS n FROM p WHERE v IS NOT NULL), r AS (SELECT *, row_number() OVER (PARTITION BY cluster, k ORDER BY n DESC, id) AS r, row_number() OVER (PARTITION BY cluster ORDER BY n DESC, id) AS b FROM n)
    SELECT cluster, max(CASE WHEN b = 1 THEN id END) AS base, count(DISTINCT id) AS merged, string_agg(CASE WHEN r = 1 THEN k || '=' || v END, ',' ORDER BY k) AS properties FROM r GROUP BY 1""",
)
query(
    "g07_merged_references",
    lambda s, d: R.merged_references(_orders(s, d).select((F.col("o_custkey") % 50).alias("cluster"), F.col("o_orderstatus").alias("source"), F.col("o_orderpriority").alias("ref"), F.col("o_totalprice").alias("confidence"))),
    "SELECT o_custkey % 50 AS cluster, o_orderstatus AS source, o_orderpriority AS ref, max(o_totalprice) AS confidence FROM orders GROUP BY 1, 2, 3",
)
query("g08_resolved_in_batches", lambda s, d: R.resolved_in_batches(_part(s, d), "p_brand", "p_partkey", "p_name", 0.85, 4))
query("g05_distinct_titles", lambda s, d: R.distinct_titles(_part(s, d), "p_brand", "p_partkey", "p_retailprice", "p_name", "p_size").select("p_brand", "p_partkey", "p_name"))
query(
    "h52_best_match",
    lambda s, d: R.best_match(_line(s, d).select("l_orderkey", "l_partkey", F.round(0.7 * F.col("l_discount") * 10 + 0.3 * F.col("l_tax") * 10, 6).alias("score")), "l_orderkey", "l_partkey", "score"),
    "SELECT l_orderkey, l_partkey, score FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY score DESC, l_partkey) AS r FROM (SELECT l_orderkey, l_partkey, round(0.7::DOUBLE * l_discount * 10 + 0.3::DOUBLE * l_tax * 10, 6) AS score FROM lineitem)) WHERE r = 1",
)
# Layout: a page is an order, its items' places come from their quantities and discounts.
query(
    "e07_anchored_columns",
    lambda s, d: S.anchored_groups(_part(s, d).select("p_brand", "p_partkey", F.col("p_size").cast("double").alias("x")), "p_brand", "p_partkey", "x", 5.0),
    ANCHORED.format(table="(SELECT *, CAST(p_size AS DOUBLE) AS x FROM part)", by="p_brand", key="p_partkey", centre="x", tolerance="5.0"),
)


def _anchors(name: str, centre: str, tolerance: float) -> str:
    return f"""{name}(page, anchor) AS (SELECT page, min({centre}) FROM i GROUP BY 1 UNION ALL SELECT a.page, min(i.{centre}) FROM {name} a JOIN i ON i.page = a.page AND i.{centre} - a.anchor > {tolerance} GROUP BY a.page, a.anchor),
    g{name} AS (SELECT i.*, (SELECT max(anchor) FROM {name} a WHERE a.page = i.page AND a.anchor <= i.{centre}) AS anchor FROM i)"""


query(
    "d10_aligned_pairs",
    lambda s, d: L.aligned_pairs(_line(s, d).select(F.col("l_orderkey").alias("page"), F.col("l_partkey").alias("item"), F.col("l_quantity").alias("x"), F.col("l_discount").alias("y")), "page", "item", "x", "y", 0.015),
    f"""WITH RECURSIVE i AS (SELECT l_orderkey AS page, l_partkey AS item, l_quantity AS x, l_discount AS y FROM lineitem), {_anchors('rows', 'y', 0.015)}, {_anchors('cols', 'x', 0.015)}
    SELECT a.page, a.item AS a, b.item AS b, 'same_row' AS kind, 0.9::DOUBLE AS confidence FROM grows a JOIN grows b ON a.page = b.page AND a.anchor = b.anchor AND a.item < b.item
    UNION ALL SELECT a.page, a.item, b.item, 'same_column', 0.9::DOUBLE FROM gcols a JOIN gcols b ON a.page = b.page AND a.anchor = b.anchor AND a.item < b.item""",
)
_entities = lambda s, d: _docs(s, d).select("doc_id", F.explode(T.entities(F.col("text"))).alias("e")).select("doc_id", F.col("e.kind").alias("kind"), F.col("e.text").alias("entity"))
_lines = lambda s, d: _docs(s, d).select("doc_id", F.posexplode(F.split("text", "\n")).alias("block", "text"))
_ENTITIES = " UNION ".join(f"SELECT doc_id, unnest(regexp_extract_all(text, '{p}')) AS entity FROM documents" for p in T.ENTITIES.values())
_LINES = "SELECT doc_id, unnest(l) AS text, CAST(generate_subscripts(l, 1) - 1 AS INTEGER) AS block FROM (SELECT doc_id, string_split(text, chr(10)) AS l FROM documents)"
query(
    "d24_placed_in_blocks",
    lambda s, d: L.placed_in_blocks(_entities(s, d), _lines(s, d), "doc_id"),
    f"WITH e AS ({_ENTITIES}), l AS ({_LINES}), m AS (SELECT doc_id, entity, block, text = entity AS exact, row_number() OVER (PARTITION BY doc_id, entity ORDER BY text <> entity, block) AS r FROM e JOIN l USING (doc_id) WHERE contains(text, entity)) SELECT doc_id, entity, block, exact FROM m WHERE r = 1",
)
query(
    "d11_same_paragraph",
    lambda s, d: L.same_paragraph(_entities(s, d), _lines(s, d), "doc_id"),
    f"WITH e AS ({_ENTITIES}), l AS ({_LINES}), w AS (SELECT doc_id, block, entity FROM e JOIN l USING (doc_id) WHERE contains(text, entity)) SELECT x.doc_id, x.entity AS a, y.entity AS b, count(*) AS n FROM w x JOIN w y ON x.doc_id = y.doc_id AND x.block = y.block AND x.entity < y.entity GROUP BY 1, 2, 3",
)
query(
    "d11_authors",
    lambda s, d: L.authors(_cust(s, d).select(F.col("c_custkey").alias("doc_id"), F.when(F.col("c_mktsegment") == "BUILDING", "organization").otherwise("person").alias("kind"), F.col("c_name").alias("entity"), F.concat(F.lit("0"), "c_nationkey").alias("author")), "author").select("doc_id", "entity", "relation"),
    "SELECT c_custkey AS doc_id, c_name AS entity, 'author_of' AS relation FROM customer WHERE c_mktsegment <> 'BUILDING' AND contains(c_name, '0' || c_nationkey)",
)
_box = lambda s, d: _line(s, d).select(F.col("l_orderkey").alias("page"), F.col("l_partkey").alias("item"), F.col("l_quantity").alias("x1"), (F.col("l_discount") * 100).alias("y1"), (F.col("l_quantity") + 20).alias("x2"), (F.col("l_discount") * 100 + 4).alias("y2"))
query(
    "d09_visual_relations",
    lambda s, d: L.visual_relations(_box(s, d), "page", "item", 70.0, 14.0).groupBy("relation").agg(F.count("*").alias("n"), F.round(F.avg("confidence"), 4).alias("confidence")),
    """WITH b AS (SELECT l_orderkey AS o, l_partkey AS k, l_quantity / 70 AS x1, l_discount * 100 / 14 AS y1, (l_quantity + 20) / 70 AS x2, (l_discount * 100 + 4) / 14 AS y2 FROM lineitem),
    p AS (SELECT a.*, c.x1 AS u1, c.y1 AS v1, c.x2 AS u2, c.y2 AS v2, least(a.x2, c.x2) - greatest(a.x1, c.x1) AS w, least(a.y2, c.y2) - greatest(a.y1, c.y1) AS h FROM b a JOIN b c ON a.o = c.o AND a.k <> c.k),
    r AS (SELECT CASE WHEN w > 0 AND h > 0 AND w * h / nullif((u2 - u1) * (v2 - v1), 0) > 0.9 THEN 'contains' WHEN w > 0 AND h > 0 AND w * h / nullif((x2 - x1) * (y2 - y1), 0) > 0.9 THEN 'contained_by' WHEN w > 0 AND h > 0 THEN 'overlaps' WHEN y2 < v1 THEN 'above' WHEN v2 < y1 THEN 'below' WHEN x2 < u1 THEN 'left_of' WHEN u2 < x1 THEN 'right_of' END AS relation,
      CASE WHEN w > 0 AND h > 0 THEN w * h / nullif(least((x2 - x1) * (y2 - y1), (u2 - u1) * (v2 - v1)), 0) ELSE 0.8::DOUBLE END AS confidence FROM p)
    SELECT relation, count(*) AS n, round(avg(confidence), 4) AS confidence FROM r WHERE relation IS NOT NULL AND confidence >= 0.5 GROUP BY 1""",
)
query(
    "i10_regions_of_interest",
    lambda s, d: L.regions_of_interest(t("embeddings")(s, d).select("vec_id", F.transform(F.sequence(F.lit(0), F.lit(7)), lambda i: F.transform(F.slice("embedding", i * 8 + 1, F.lit(8)), lambda x: F.abs(x).cast("double"))).alias("map")), "vec_id", "map"),
    """WITH RECURSIVE c AS (SELECT vec_id, (k - 1) // 8 AS i, (k - 1) % 8 AS j, k - 1 AS k, abs(embedding[k])::DOUBLE AS x FROM embeddings, range(1, 65) r(k)), m AS (SELECT * FROM (SELECT *, max(x) OVER (PARTITION BY vec_id) AS top FROM c) WHERE x > 0.5 * top),
    r(vec_id, a, b) AS (SELECT vec_id, k, k FROM m UNION SELECT r.vec_id, r.a, n.k FROM r JOIN m o ON o.vec_id = r.vec_id AND o.k = r.b JOIN m n ON n.vec_id = o.vec_id AND abs(n.i - o.i) + abs(n.j - o.j) = 1),
    l AS (SELECT vec_id, a, min(b) AS root FROM r GROUP BY 1, 2)
    SELECT l.vec_id, min(j) / 8 AS x1, min(i) / 8 AS y1, (max(j) + 1) / 8 AS x2, (max(i) + 1) / 8 AS y2, count(*) AS cells FROM l JOIN m ON m.vec_id = l.vec_id AND m.k = l.a GROUP BY l.vec_id, root""",
)
# Metadata, tables and forms.
query(
    "h95_metadata_entities",
    lambda s, d: FO.metadata_entities(_docs(s, d).select("doc_id", F.create_map(F.lit("title"), F.array(F.get(F.split("text", "\n"), F.lit(0))), F.lit("author"), F.array("source"), F.lit("keywords"), F.array_distinct(F.filter(F.split("text", " "), lambda w: F.length(w) >= 10)), F.lit("language"), F.array("lang")).alias("metadata")), "doc_id"),
    """WITH m AS (SELECT doc_id, 'title' AS field, 'document_title' AS kind, string_split(text, chr(10))[1] AS text FROM documents UNION ALL SELECT doc_id, 'author', 'person', source FROM documents UNION ALL SELECT doc_id, 'keywords', 'document_metadata', unnest(list_distinct(list_filter(string_split(text, ' '), lambda w: length(w) >= 10))) FROM documents)
    SELECT doc_id, kind, text, field, 0.9::DOUBLE AS confidence FROM m WHERE trim(text, ' ') <> '' UNION ALL SELECT doc_id, 'document_metadata', 'Document Metadata', NULL, 1.0::DOUBLE FROM documents""",
)
query(
    "h96_table_entities",
    lambda s, d: FO.table_entities(_docs(s, d), "doc_id", F.transform(F.split("text", "\n"), lambda x: F.split(x, ", "))),
    "WITH r AS (SELECT doc_id, string_split(l[1], ', ') AS head, unnest(range(2, len(l) + 1)) AS i, l FROM (SELECT doc_id, string_split(text, chr(10)) AS l FROM documents)), c AS (SELECT doc_id, CAST(i - 2 AS INTEGER) AS row, head, string_split(l[i], ', ') AS cells FROM r), x AS (SELECT doc_id, row, head, CAST(generate_subscripts(cells, 1) - 1 AS INTEGER) AS col, unnest(cells) AS cell FROM c) "
    + " UNION ALL ".join(f"SELECT doc_id, row, col, head[col + 1] AS header, '{k}' AS kind, unnest(regexp_extract_all(cell, '{p}')) AS text FROM x WHERE trim(cell, ' ') <> ''" for k, p in T.ENTITIES.items()),
)


def _form(s, d):
    """A form a customer: name, whether of the building trade, whether in credit, nation."""
    row = lambda pos, element, name, value: F.struct(F.lit(pos).alias("pos"), F.lit(element).alias("element"), F.lit(name).alias("name"), value.cast("string").alias("value"))
    rows = F.array(row(0, "text_field", "customer name", F.col("c_name")), row(1, "radio", "building trade", F.col("c_mktsegment") == "BUILDING"), row(2, "checkbox", "in credit", F.col("c_acctbal") > 0), row(3, "combo", "company nation", F.col("c_nationkey")))
    return _cust(s, d).select(F.col("c_custkey").alias("form"), F.col("c_mktsegment").alias("form_type"), F.explode(rows).alias("r"), (F.lit(0.5) + F.col("c_nationkey") / 100).alias("confidence")).select("form", "form_type", "r.*", "confidence")


_FORM = """f AS (SELECT c_custkey AS form, c_mktsegment AS form_type, unnest([0, 1, 2, 3]) AS pos, unnest(['text_field', 'radio', 'checkbox', 'combo']) AS element, unnest(['customer name', 'building trade', 'in credit', 'company nation']) AS name,
    unnest([c_name, CAST(c_mktsegment = 'BUILDING' AS VARCHAR), CAST(c_acctbal > 0 AS VARCHAR), CAST(c_nationkey AS VARCHAR)]) AS value, 0.5::DOUBLE + c_nationkey / 100 AS confidence FROM customer),
    x AS (SELECT form, pos, CASE element WHEN 'text_field' THEN 'form_text_field' WHEN 'radio' THEN 'form_radio_button' WHEN 'checkbox' THEN 'form_checkbox' ELSE 'form_field' END AS kind,
      CASE element WHEN 'radio' THEN name || ': ' || CASE WHEN value = 'true' THEN 'Selected' ELSE 'Unselected' END WHEN 'checkbox' THEN name || ': ' || CASE WHEN value = 'true' THEN 'Checked' ELSE 'Unchecked' END ELSE name END AS text, confidence FROM f
    UNION ALL SELECT form, pos, 'form_value', value, confidence FROM f WHERE element = 'text_field' UNION ALL SELECT form, pos, 'form_label', name, round(confidence * 0.9::DOUBLE, 6) FROM f
    UNION ALL SELECT form, pos, 'key_value_pair', name || ': ' || value, confidence FROM f UNION ALL SELECT form, -1, 'form', 'Form: ' || form_type, max(confidence) FROM f GROUP BY form, form_type)"""
query("h97_form_entities", lambda s, d: FO.form_entities(_form(s, d)), f"WITH {_FORM} SELECT * FROM x")
query(
    "h97_form_edges",
    lambda s, d: FO.form_edges(FO.form_entities(_form(s, d))),
    f"WITH {_FORM}, e AS (SELECT form, pos, CASE WHEN kind IN ('form_value', 'form_label', 'key_value_pair', 'form') THEN kind ELSE 'element' END AS kind FROM x) SELECT form, pos, unnest(CASE kind WHEN 'element' THEN ['contains', 'belongs_to'] WHEN 'form_value' THEN ['has_value', 'value_of'] WHEN 'form_label' THEN ['labeled_by', 'labels'] ELSE ['has_data', 'extracted_from'] END) AS relation, CASE kind WHEN 'form_label' THEN 0.9::DOUBLE ELSE 1.0::DOUBLE END AS confidence FROM e WHERE kind <> 'form'",
)
query(
    "d32_form_relations",
    lambda s, d: FO.form_relations(
        _form(s, d).select(F.col("form").alias("doc"), F.col("pos").alias("field"), "name"),
        _cust(s, d).select(F.col("c_custkey").alias("doc"), F.explode(F.array(F.struct(F.col("c_name").alias("entity"), F.lit("person").alias("kind")), F.struct(F.col("c_mktsegment").alias("entity"), F.lit("organization").alias("kind")), F.struct(F.lit("2024").alias("entity"), F.lit("date").alias("kind")))).alias("o")).select("doc", "o.*"),
    ),
    "SELECT c_custkey AS doc, 0 AS field, c_name AS entity, 'refers_to' AS relation, 0.7::DOUBLE AS confidence FROM customer UNION ALL SELECT c_custkey, 3, c_mktsegment, 'refers_to', 0.7::DOUBLE FROM customer",
)
# Ontology: kinds and edge kinds of the graph of nations, customers and suppliers.
KINDS = [("Region", ["label"], ["area"]), ("Nation", ["label", "region"], []), ("Customer", ["label", "confidence"], ["segment", "region"])]
_props = lambda: F.array_compact(F.array(F.lit("label"), F.when(F.col("confidence") > 0.3, "confidence"), F.when(F.col("kind") == "Nation", "region"), F.when(F.length("label") > 17, "segment")))
_entities_of = lambda s, d: PG.nodes(s, d).select("id", "kind", _props().alias("properties"))
_PROPS = "list_filter(['label', CASE WHEN confidence > 0.3 THEN 'confidence' END, CASE WHEN kind = 'Nation' THEN 'region' END, CASE WHEN length(label) > 17 THEN 'segment' END], lambda x: x IS NOT NULL)"
_KINDS = ", ".join(f"('{k}', {r}::VARCHAR[], {o}::VARCHAR[])" for k, r, o in KINDS)
query(
    "h53_valid_entities",
    lambda s, d: O.checked_entities(_entities_of(s, d), s.createDataFrame(KINDS, "kind string, required array<string>, optional array<string>")),
    f"{PG.WITH}, k(kind, required, optional) AS (VALUES {_KINDS}), p AS (SELECT id, n.kind, required, list_filter(required, lambda x: NOT list_contains({_PROPS.replace('kind =', 'n.kind =')}, x)) AS missing FROM n LEFT JOIN k ON n.kind = k.kind) SELECT id, kind, required IS NOT NULL AND len(missing) = 0 AS valid, coalesce(array_to_string(missing, ','), '') AS missing FROM p",
)
RULES = [("PART_OF", ["Nation"], ["Region"]), ("LIVES_IN", ["Customer", "Supplier"], ["Nation"]), ("RELATED", [], ["Nation"])]
_RULES = ", ".join(f"('{k}', {a}::VARCHAR[], {b}::VARCHAR[])" for k, a, b in RULES)
_rules = lambda s: s.createDataFrame(RULES, "kind string, sources array<string>, targets array<string>")
query(
    "h54_valid_edges",
    lambda s, d: O.checked_edges(PG.edges(s, d), PG.nodes(s, d), _rules(s)),
    f"{PG.WITH}, k(kind, a, b) AS (VALUES {_RULES}) SELECT source, target, e.kind, coalesce((len(a) = 0 OR list_contains(a, x.kind)) AND (len(b) = 0 OR list_contains(b, y.kind)), false) AS valid FROM e JOIN n x ON x.id = source JOIN n y ON y.id = target LEFT JOIN k ON k.kind = e.kind",
)
_inter = lambda of: f"coalesce(len(list_intersect(props, {of})) / nullif(len({of}), 0), 0.0::DOUBLE)"
query(
    "h55_type_suggestions",
    lambda s, d: O.suggested_kinds(_entities_of(s, d), KINDS),
    f"{PG.WITH}, k(kind, required, optional) AS (VALUES {_KINDS}), p AS (SELECT id, {_PROPS} AS props FROM n), x AS (SELECT id, k.kind, round(0.7::DOUBLE * {_inter('required')} + 0.3::DOUBLE * {_inter('optional')}, 9) AS score FROM p, k) SELECT id, kind, score, CAST(row_number() OVER (PARTITION BY id ORDER BY score DESC, kind) AS INTEGER) AS rank FROM x",
)
query(
    "h56_edge_suggestions",
    lambda s, d: O.suggested_edges(PG.edges(s, d).join(PG.nodes(s, d).select(F.col("id").alias("source"), F.col("kind").alias("source_kind")), "source").join(PG.nodes(s, d).select(F.col("id").alias("target"), F.col("kind").alias("target_kind")), "target"), _rules(s)),
    f"{PG.WITH}, k(kind, a, b) AS (VALUES {_RULES}), p AS (SELECT DISTINCT x.kind AS source_kind, y.kind AS target_kind FROM e JOIN n x ON x.id = source JOIN n y ON y.id = target) SELECT source_kind, target_kind, kind, CASE WHEN len(a) = 0 OR len(b) = 0 THEN 0.3::DOUBLE ELSE round(0.5::DOUBLE * (1 / len(a) + 1 / len(b)), 9) END AS score FROM p JOIN k ON (len(a) = 0 OR list_contains(a, source_kind)) AND (len(b) = 0 OR list_contains(b, target_kind))",
)
_edge = lambda i: lambda s, d: O.checked_hyperedges(_line(s, d).select(F.col("l_orderkey").alias("edge"), F.col("l_partkey").alias("node")), _part(s, d).filter("p_size <= 40").select(F.col("p_partkey").alias("node")))[i]
_SIZES = "SELECT l_orderkey AS edge, count(DISTINCT l_partkey) AS size, count(DISTINCT CASE WHEN p_partkey IS NULL THEN l_partkey END) AS unknown FROM lineitem LEFT JOIN (SELECT p_partkey FROM part WHERE p_size <= 40) ON p_partkey = l_partkey GROUP BY 1"
query("i09_accepted_hyperedges", _edge(0), f"SELECT edge, size FROM ({_SIZES}) WHERE unknown = 0")
query("i09_refused_hyperedges", _edge(1), f"SELECT edge, unknown FROM ({_SIZES}) WHERE unknown > 0")
