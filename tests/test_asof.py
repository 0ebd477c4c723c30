"""As-of and interval joins against plain loops, with ties, nulls, a hot key and buckets of any width."""

import datetime as dt
import random

import pytest

from tidemark.operators.asof import asof_join, bucket_width, interval_join

T0 = dt.datetime(2024, 1, 1)


def at(minutes):
    return None if minutes is None else T0 + dt.timedelta(minutes=minutes)


def tables(spark, seed=2):
    rng = random.Random(seed)
    key = lambda: rng.choice(["hot", "hot", "hot", "b", "c", None])
    left = [(i, key(), rng.choice([None, *range(200)])) for i in range(150)]
    right = [(key(), rng.choice([None, *range(0, 200, 3)]), i, rng.random()) for i in range(120)]
    return left, right, spark.createDataFrame([(i, k, at(m)) for i, k, m in left], "id long, k string, t timestamp_ntz"), spark.createDataFrame([(k, at(m), i, v) for k, m, i, v in right], "k string, u timestamp_ntz, n long, v double")


@pytest.mark.parametrize("width, tolerance", [(None, None), (60_000_000, None), (7_000_000, None), (10**13, None), (300_000_000, 5)])
def test_asof(spark, width, tolerance):
    left, right, a, b = tables(spark)
    got = {r["id"]: (r["n"], r["v"]) for r in asof_join(a, b, "k", "t", "u", "n", ["n", "v"], width, tolerance and tolerance * 60_000_000).collect()}
    for i, k, m in left:
        before = [(u, n, v) for kk, u, n, v in right if k is not None and kk == k and m is not None and u is not None and u <= m and (tolerance is None or m - u <= tolerance)]
        assert got[i] == (max(before)[1:] if before else (None, None))
    assert len(got) == len(left)


def test_asof_of_empty_tables(spark):
    _, _, a, b = tables(spark)
    assert asof_join(a.limit(0), b, "k", "t", "u", "n", ["v"]).count() == 0
    assert asof_join(a, b.limit(0), "k", "t", "u", "n", ["v"]).filter("v IS NULL").count() == 150
    assert bucket_width(b.limit(0), "u") == 1


def test_a_hot_key_is_many_buckets(spark):
    _, _, _, b = tables(spark)
    assert bucket_width(b, "u", per_bucket=10) < 200 * 60_000_000 / 9


@pytest.mark.parametrize("width", [60_000_000, 900_000_000, 10**12])
def test_intervals(spark, width):
    left, right, a, b = tables(spark)
    spans = [(i, k, m, None if m is None else m + i % 40 - 3) for i, k, m in left]
    held = spark.createDataFrame([(i, k, at(s), at(e)) for i, k, s, e in spans], "id long, k string, s timestamp_ntz, e timestamp_ntz")
    got = sorted((r["id"], r["n"]) for r in interval_join(held, b, "k", "s", "e", "u", width).collect())
    assert got == sorted((i, n) for i, k, s, e in spans for kk, u, n, _ in right if k is not None and k == kk and s is not None and u is not None and s <= u <= e)
