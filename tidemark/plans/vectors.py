"""Registered vector queries."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from tidemark.operators import index as I
from tidemark.operators import vectors as V
from tidemark.registry import query
from tidemark.session import shared_dir, table

_e = lambda s, d: table(s, d, "embeddings")
_COS = "list_cosine_similarity(CAST({a} AS DOUBLE[]), CAST({b} AS DOUBLE[]))"
query(
    "j03_cosine_top_k",
    lambda s, d: V.top_k(_e(s, d), _e(s, d).filter("vec_id % 20 = 0"), 5),
    f"""WITH p AS (SELECT q.vec_id AS query_id, v.vec_id, round({_COS.format(a="q.embedding", b="v.embedding")}, 6) AS score FROM embeddings q JOIN embeddings v ON q.vec_id % 20 = 0 AND q.vec_id <> v.vec_id),
    r AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM p) SELECT * FROM r WHERE rank <= 5""",
)
query(
    "h43_late_interaction",
    lambda s, d: _e(s, d).alias("a").join(_e(s, d).select((F.col("vec_id") - 1).alias("vec_id"), F.col("embedding").alias("next")), "vec_id").select("vec_id", F.round(V.max_sim(V.parts("embedding", 4, 16), V.parts("next", 4, 16)), 6).alias("max_sim")),
    """WITH p AS (SELECT a.vec_id, i, j, list_cosine_similarity(CAST(a.embedding[i * 16 + 1 : i * 16 + 16] AS DOUBLE[]), CAST(b.embedding[j * 16 + 1 : j * 16 + 16] AS DOUBLE[])) AS c
      FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1, range(4) x(i), range(4) y(j)), m AS (SELECT vec_id, i, max(c) AS c FROM p GROUP BY 1, 2) SELECT vec_id, round(sum(c) / 4, 6) AS max_sim FROM m GROUP BY 1""",
)
query("label_centroids", lambda s, d: V.centroids(_e(s, d)), "SELECT label, CAST(dim - 1 AS INTEGER) AS dim, round(avg(CAST(x AS DOUBLE)), 6) AS mean FROM (SELECT label, unnest(embedding) AS x, generate_subscripts(embedding, 1) AS dim FROM embeddings) GROUP BY 1, 2")
query("h42_norms", lambda s, d: _e(s, d).select("vec_id", F.round(V.norm("embedding"), 6).alias("norm"), F.round(V.norm(V.unit("embedding")), 6).alias("unit_norm")), "SELECT vec_id, round(sqrt(list_dot_product(CAST(embedding AS DOUBLE[]), CAST(embedding AS DOUBLE[]))), 6) AS norm, 1.0::DOUBLE AS unit_norm FROM embeddings")
query(
    "h44_document_similarity",
    lambda s, d: _e(s, d).join(_e(s, d).select((F.col("vec_id") - 2).alias("vec_id"), F.col("embedding").alias("other")), "vec_id").select("vec_id", F.round(V.document_similarity("embedding", "other", 4, 16), 6).alias("similarity")),
    f"""WITH p AS (SELECT a.vec_id, i, max({_COS.format(a="a.embedding[i * 16 + 1 : i * 16 + 16]", b="b.embedding[j * 16 + 1 : j * 16 + 16]")}) AS c, any_value({_COS.format(a="a.embedding", b="b.embedding")}) AS whole FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 2, range(4) x(i), range(4) y(j) GROUP BY 1, 2)
    SELECT vec_id, round(0.3::DOUBLE * any_value(whole) + 0.7::DOUBLE * (sum(c) / 4), 6) AS similarity FROM p GROUP BY 1""",
)
query(
    "h45_late_fusion",
    lambda s, d: _e(s, d).join(_e(s, d).select((F.col("vec_id") - 3).alias("vec_id"), F.col("embedding").alias("other")), "vec_id").select("vec_id", F.transform(V.late_fusion("embedding", "other"), lambda x: F.round(x, 6) + F.lit(0.0)).alias("fused")),
    """WITH u AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(x AS DOUBLE) / sqrt(list_dot_product(CAST(embedding AS DOUBLE[]), CAST(embedding AS DOUBLE[])))) AS u FROM embeddings),
    m AS (SELECT a.vec_id, list_transform(list_zip(a.u, b.u), lambda x: 0.5::DOUBLE * x[1] + 0.5::DOUBLE * x[2]) AS m FROM u a JOIN u b ON b.vec_id = a.vec_id + 3)
    SELECT vec_id, list_transform(m, lambda x: round(x / sqrt(list_dot_product(m, m)), 6) + 0::DOUBLE) AS fused FROM m""",
)
query(
    "d06_similar_pairs",
    lambda s, d: V.similar_pairs(_e(s, d), 0.7),
    f"SELECT * FROM (SELECT a.vec_id AS a, b.vec_id AS b, round({_COS.format(a='a.embedding', b='b.embedding')}, 6) AS score FROM embeddings a JOIN embeddings b ON a.vec_id < b.vec_id AND a.label <> b.label) WHERE score >= 0.7",
)


def _indexed(s, d):
    """An index built of all vectors, and the five nearest rows of each twentieth found in it."""
    path = f"{shared_dir(s)}/index-{uuid.uuid4().hex}"
    index = I.build(_e(s, d), path)
    return I.search(s, index, _e(s, d).filter("vec_id % 20 = 0"), 5)[0].select("query_id", "rank", "vec_id", "score")


query(
    "b14_vector_index",
    _indexed,
    f"""WITH p AS (SELECT q.vec_id AS query_id, v.vec_id, round({_COS.format(a="q.embedding", b="v.embedding")}, 6) AS score FROM embeddings q JOIN embeddings v ON q.vec_id % 20 = 0 AND q.vec_id <> v.vec_id),
    r AS (SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score FROM p) SELECT * FROM r WHERE rank <= 5""",
)
