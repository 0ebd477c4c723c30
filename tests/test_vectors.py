import math
import tracemalloc

import numpy as np
import pandas as pd
import pytest

from tidemark.operators import cells as C
from tidemark.operators import vectors as V
from tidemark.session import table


def cosine(a, b):
    n = math.sqrt(sum(x * x for x in a)) * math.sqrt(sum(x * x for x in b))
    return sum(x * y for x, y in zip(a, b, strict=True)) / n if n else 0.0


def test_similar_pairs_recall(spark):
    rows = [(r["vec_id"], r["label"], r["embedding"]) for r in table(spark, "/root/testdata/sf0.01", "embeddings").filter("vec_id < 200").collect()]
    want = {(a, b) for a, la, x in rows for b, lb, y in rows if a < b and la != lb and round(cosine(x, y), 6) >= 0.3}
    got = {(r["a"], r["b"]) for r in V.similar_pairs(table(spark, "/root/testdata/sf0.01", "embeddings").filter("vec_id < 200"), 0.3).collect()}
    assert got <= want and len(got) >= 0.9 * len(want)


@pytest.mark.parametrize("block", [64, 2048])
def test_similar_pairs_are_all_found(spark, block):
    vectors = table(spark, "/root/testdata/sf0.01", "embeddings").filter("vec_id < 200")
    rows = [(r["vec_id"], r["label"], r["embedding"]) for r in vectors.collect()]
    want = {(a, b) for a, la, x in rows for b, lb, y in rows if a < b and la != lb and round(cosine(x, y), 6) >= 0.1}
    got = [(r["a"], r["b"]) for r in V.similar_pairs(vectors, 0.1, block=block).collect()]
    assert len(got) == len(set(got)) and set(got) == want


def test_cosine_edge_cases(spark):
    df = spark.createDataFrame([([1.0, 0.0], [1.0, 0.0]), ([0.0, 0.0], [1.0, 0.0]), (None, [1.0, 0.0])], "a array<double>, b array<double>")
    assert [r[0] for r in df.select(V.cosine("a", "b")).collect()] == [1.0, 0.0, 0.0]


def test_late_fusion_is_unit(spark):
    df = spark.createDataFrame([([1.0, 0.0], [0.0, 1.0])], "a array<double>, b array<double>")
    assert df.select(V.late_fusion("a", "b")).first()[0] == pytest.approx([math.sqrt(0.5)] * 2)


def brute_best(rows, queries, k):
    """(query, row, score) by the operator's order, from all rounded cosines."""
    out = []
    for q in queries.itertuples():
        scored = sorted((-round(cosine(q.embedding, r.embedding), 6), r.vec_id) for r in rows.itertuples() if r.vec_id != q.vec_id)
        out += [(q.vec_id, i, -s + 0.0) for s, i in scored[:k]]
    return out


@pytest.mark.parametrize("scores, k", [(1, 3), (40, 3), (1 << 20, 3), (1 << 20, 500)])
def test_best_of_in_portions(monkeypatch, scores, k):
    monkeypatch.setattr(C, "SCORES", scores)
    rng = np.random.default_rng(2)
    x = rng.integers(-2, 3, (60, 3)).astype(float)  # many ties, zero vectors
    rows = pd.DataFrame({"vec_id": np.r_[np.arange(55), np.arange(5)], "embedding": list(x)})
    frames = list(V.best_of(k)(V.Rows(rows), rows.iloc[:20]))
    got = [(q, i, s + 0.0) for f in frames for q, i, s in f.itertuples(index=False)]
    assert got == brute_best(rows, rows.iloc[:20], k)


@pytest.mark.parametrize("compare, columns", [(V.best_of(5), {}), (V._pairs_of(0.9, True), {"label": 1, "same": False})])
def test_a_batch_of_visitors_is_not_one_matrix(compare, columns):
    """10,000 visitors to 4,096 rows took over a GB of a task's memory."""
    rng = np.random.default_rng(3)
    frame = lambda n, at: pd.DataFrame({"vec_id": np.arange(at, at + n), "embedding": list(rng.normal(size=(n, 16)))}).assign(**columns)
    block, visitors = V.Rows(frame(4_096, 0)), frame(10_000, 5_000)
    tracemalloc.start()
    for _ in compare(block, visitors):
        pass
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 150e6


def test_blocks_of_the_similarity_join_move_whole(spark, monkeypatch):
    """Each vector was a row of its own in every block that it passed: 2,000 vectors in blocks of 64 went as 57,772 rows."""
    sent = []

    def passing_by(held, come, *others):
        sent.append(held.count() + come.count())
        return C.passing_by(held, come, *others)

    monkeypatch.setattr(V, "passing_by", passing_by)
    monkeypatch.setattr(V, "PASSING", 3, raising=False)
    rng = np.random.default_rng(5)
    x = rng.normal(size=(2_000, 8)).round(3)
    x[7] = 0
    rows = [(i, i % 3, v.tolist()) for i, v in enumerate(x)]
    vectors = spark.createDataFrame(rows + rows[:500], "vec_id long, label int, embedding array<double>")
    got = [tuple(r) for r in V.similar_pairs(vectors, 0.8, block=64).collect()]
    norm = np.sqrt((x * x).sum(1))
    score = np.round(np.divide(x @ x.T, np.outer(norm, norm), out=np.zeros((2_000, 2_000)), where=np.outer(norm, norm) > 0), 6)
    want = {(a, b, score[a, b]) for a, b in zip(*np.nonzero(np.triu(score >= 0.8, 1)), strict=True) if a % 3 != b % 3}
    assert len(got) == len(set(got)) and set(got) == want
    assert sent[0] < 4_000, sent


@pytest.mark.parametrize("least", [0.0, -0.5])
def test_similar_pairs_at_no_limit(spark, least):
    x = np.array([[1, 0], [0, 0], [-1, 0], [0, 2], [1, 1]], dtype=float)
    vectors = spark.createDataFrame([(i, 1, v.tolist()) for i, v in enumerate(x)], "vec_id long, label int, embedding array<double>")
    want = {(a, b, round(cosine(x[a], x[b]), 6)) for a in range(5) for b in range(a + 1, 5) if round(cosine(x[a], x[b]), 6) >= least}
    assert {tuple(r) for r in V.similar_pairs(vectors, least, across=False).collect()} == want
    assert V.similar_pairs(vectors.limit(0), least).count() == 0


def test_many_pairs_are_worked_out_in_portions():
    rng = np.random.default_rng(4)
    frame = lambda at: pd.DataFrame({"vec_id": np.arange(at, at + 512), "label": 1, "same": False, "embedding": list(1 + rng.normal(size=(512, 256)) / 100)})
    block, visitors = V.Rows(frame(0)), frame(1_000)
    tracemalloc.start()
    found = sum(len(f) for f in V._pairs_of(0.9, False)(block, visitors))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert found == 512 * 512 and peak < 100e6
