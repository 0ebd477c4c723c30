import math
import random

import numpy as np
import pytest

from tidemark.llm import bitslice
from tidemark.llm.bitslice import SliceIndex, top_k
from tidemark.session import table


def brute(rows, k=10, every=100):
    fine = [(i, tuple(math.floor(1024 * float(x)) for x in v)) for i, v in rows if i is not None and v is not None and all(x is not None and math.isfinite(1024 * float(x)) for x in v)]
    out = []
    for q, a in {(q, a) for q, a in fine if q % every == 0}:
        scored = [(-sum(x * y for x, y in zip(a, v)), i) for i, v in fine if i != q]
        scored = sorted(x for x in scored if -(1 << 63) <= -x[0] < 1 << 63)[:k]
        out += [(q, n, i, -s) for n, (s, i) in enumerate(scored, 1)]
    return sorted(out)


def test_embeddings(spark):
    vectors = table(spark, "/root/testdata/sf0.01", "embeddings")
    assert sorted(map(tuple, top_k(vectors).collect())) == brute([(r["vec_id"], r["embedding"]) for r in vectors.collect()])


def test_several_blocks(spark, monkeypatch):
    monkeypatch.setattr(bitslice, "BLOCK_CELLS", 70 * 64)
    vectors = table(spark, "/root/testdata/sf0.01", "embeddings")
    assert sorted(map(tuple, top_k(vectors).collect())) == brute([(r["vec_id"], r["embedding"]) for r in vectors.collect()])


def test_edge_cases(spark):
    random.seed(3)
    same = [0.5, -0.25, 0.0]
    rows = [(i, same) for i in range(1, 40)] + [(0, [1.0, 1.0, -1.0]), (100, same), (200, None), (300, [1.0, None, 0.0]), (41, [float("nan"), 0.0, 0.0]), (42, [float("inf"), 0.0, 0.0]), (None, same), (43, [3.0]), (400, [0.0, 0.0, 0.0]), (44, [])]
    vectors = spark.createDataFrame([(i, v, 7) for i, v in rows], "vec_id long, embedding array<float>, score int")
    assert sorted(map(tuple, top_k(vectors).collect())) == brute(rows)
    assert top_k(vectors.limit(0)).count() == 0


def test_great_components(spark):
    """Components beyond 32 bits, beyond a long, and scores beyond a long, beside usual rows."""
    random.seed(5)
    rows = [(i, [random.uniform(-1, 1) for _ in range(4)]) for i in range(1, 60)]
    rows += [(0, [0.5, 0.25, 0.0, 1.0]), (100, [3e6, 0.0, 1.0, -3e6]), (200, [1e30, 0.0, 0.0, 0.0]), (300, [0.0, 1.0, 0.0, 0.0]), (61, [3e6, 1.0, 0.0, 0.0]), (62, [2e4, -2e4, 2e4, 0.0]), (63, [-1e30, 1.0, 2.0, 0.0]), (64, [1e6] * 4), (65, [1e306, 0.0, 0.0, 0.0]), (66, [0.0, 7.0, 0.0, 0.0]), (67, [4e15, 1.5, 0.0, 0.0]), (68, [-3.5e-17, 0.0, 0.0, -3e6])]
    vectors = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    assert sorted(map(tuple, top_k(vectors).collect())) == brute(rows)


def test_repeated_rows_and_queries(spark):
    rows = [(7, [1.0, 1.0])] * 500 + [(i, [0.5, float(i)]) for i in range(10, 20)] + [(100, [1.0, 0.0])] * 30 + [(100, [0.0, 1.0]), (200, [-1.0, 0.0])]
    vectors = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    assert sorted(map(tuple, top_k(vectors).collect())) == brute(rows)


@pytest.mark.parametrize("seed", range(6))
def test_candidates_hold_the_best(seed):
    rng = np.random.default_rng(seed)
    rows = rng.integers(-1024, 1025, (rng.integers(1, 400), 8))
    rows[rows.shape[0] // 2 :] = rows[0]
    index, query = SliceIndex(rows), rng.integers(-1024, 1025, 8)
    score = rows @ query
    kept = index.candidates(query, 10)
    tenth = np.sort(score)[::-1][min(10, len(score)) - 1]
    assert set(np.flatnonzero(score >= tenth)) <= set(kept)
    total, least = index.add_up(query, 0)
    if total:
        sums = sum(np.unpackbits(t.view(np.uint8), bitorder="little")[: index.n].astype(np.int64) << b for b, t in enumerate(total)) << least
        assert len(set(score - sums)) == 1
