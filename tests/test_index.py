"""The vector index against brute force: exact results, cells left out on clustered vectors, recall of few probes, defined cases."""

import uuid

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.operators import index as I
from tidemark.operators import vectors as V
from tidemark.operators.cells import fit, in_cells
from tidemark.session import table

SF = "/root/testdata/sf0.01"


def clustered(spark, n=4_000, groups=40, seed=1):
    rng = np.random.default_rng(seed)
    centre = rng.normal(size=(groups, 16))
    centre /= np.linalg.norm(centre, axis=1, keepdims=True)
    x = centre[rng.integers(0, groups, n)] + rng.normal(size=(n, 16)) * 0.03
    return spark.createDataFrame([(i, v.tolist(), i % 3) for i, v in enumerate(x)], "vec_id long, embedding array<double>, label int"), x


def brute(x, queries, k):
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    out = {}
    for q in queries:
        score = np.round(unit @ unit[q], 6)
        score[q] = -9
        out[q] = [int(i) for i in np.lexsort((np.arange(len(x)), -score))[:k]]
    return out


def results(best):
    got = {}
    for r in best.orderBy("query_id", "rank").collect():
        got.setdefault(r["query_id"], []).append(r["vec_id"])
    return got


@pytest.fixture(scope="module")
def built(spark, tmp_path_factory):
    vectors, x = clustered(spark)
    return vectors, x, I.build(vectors, f"{tmp_path_factory.mktemp('index')}/{uuid.uuid4().hex}", cells=64, block=50)


def test_exact_with_few_cells(spark, built):
    vectors, x, index = built
    best, read = I.search(spark, I.load(spark, index.path), vectors.filter("vec_id % 20 = 0"), 7)
    assert results(best) == brute(x, range(0, 4_000, 20), 7)
    seen = read.agg(F.avg("cells"), F.avg("rows"), F.count("*")).first()
    assert seen[2] == 200 and seen[0] < 64 / 4 and seen[1] < 4_000 / 4


def test_cells_hold_every_row_and_hot_cells_are_split(spark, built):
    vectors, _, index = built
    assert index.sizes.sum() == 4_000 and index.blocks.max() > 1
    rows = index.rows(spark, list(range(64)))
    assert rows.count() == 4_000 and rows.groupBy("cell", "block").count().agg(F.max("count")).first()[0] < 110


def test_only_the_folders_of_probed_cells_are_read(spark, built):
    _, _, index = built
    rows = index.rows(spark, [1, 5])
    plan = rows._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [cell" in plan.replace("isnotnull(cell", "cell") and "DataFilters: []" in plan
    assert rows.select("cell").distinct().count() == 2


def test_few_probes(spark, built):
    vectors, x, index = built
    best, read = I.search(spark, index, vectors.filter("vec_id % 20 = 0"), 5, probes=4)
    want = brute(x, range(0, 4_000, 20), 5)
    recall = np.mean([len(set(v) & set(results(best)[q])) / 5 for q, v in want.items()])
    assert recall >= 0.9 and read.agg(F.max("cells")).first()[0] <= 4


def test_given_vectors(spark, tmp_path):
    """Vectors without clusters: nothing can be left out, and the result is still exact."""
    vectors = table(spark, SF, "embeddings")
    index = I.build(vectors, f"{tmp_path}/i")
    asked = vectors.filter("vec_id % 20 = 0")
    got, want = (sorted(map(tuple, df.select("query_id", "vec_id", "score", "rank").collect())) for df in (I.search(spark, index, asked, 5)[0], V.top_k(vectors, asked, 5)))
    assert got == want


def test_defined_cases(spark, tmp_path):
    rows = [(1, [1.0, 0.0]), (2, [1.0, 0.0]), (2, [1.0, 0.0]), (3, [0.0, 0.0]), (4, None), (5, [1.0, None]), (6, [float("nan"), 1.0]), (None, [1.0, 1.0]), (7, [-1.0, 0.0]), (8, [0.0, 1.0])]
    vectors = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    index = I.build(vectors, f"{tmp_path}/i", cells=3)
    best, _ = I.search(spark, index, vectors.filter("vec_id IN (1, 3, 4)"), 4)
    assert sorted(map(tuple, best.select("query_id", "rank", "vec_id", "score").collect())) == [(1, 1, 2, 1.0), (1, 2, 2, 1.0), (1, 3, 3, 0.0), (1, 4, 8, 0.0), (3, 1, 1, 0.0), (3, 2, 2, 0.0), (3, 3, 2, 0.0), (3, 4, 7, 0.0)]
    empty = I.build(vectors.limit(0), f"{tmp_path}/e")
    assert I.search(spark, empty, vectors, 3)[0].count() == 0 and I.search(spark, index, vectors.limit(0), 3)[0].count() == 0


def test_far_cells_are_never_met(spark):
    """The similarity join leaves out most pairs of cells of clustered vectors, and no pair of vectors."""
    vectors, x = clustered(spark, 1_500, 30, 3)
    centroids = fit(vectors, 30)
    far = {r["cell"]: r["far"] for r in in_cells(vectors, centroids).groupBy("cell").agg(F.max("far").alias("far")).collect()}
    near = V.near_cells(centroids, np.array([far.get(c, -1.0) for c in range(len(centroids))]), 0.9)
    assert sum(map(len, near)) < 30 * 31 / 2 / 3
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    score = np.round(unit @ unit.T, 6)
    want = {(a, b) for a, b in zip(*np.nonzero(np.triu(score, 1) >= 0.9), strict=True) if a % 3 != b % 3}
    got = [(r["a"], r["b"]) for r in V.similar_pairs(vectors, 0.9, block=64, cells=30).collect()]
    assert len(got) == len(set(got)) and set(got) == want
