"""Means and ranks of metrics against exact fractions."""

import random
from decimal import ROUND_HALF_UP, Decimal
from fractions import Fraction

from tidemark.operators import search as S


def test_means_between_two_roundings(spark):
    """Sums of 64 amounts in cents: every fourth mean lies exactly between two roundings, where a sum in double falls to either side by the order of its rows."""
    rng = random.Random(4)
    rows = [(m, rng.randint(100_000, 9_999_999) / 100, None if rng.random() < 0.5 else rng.randint(0, 10) / 100) for m in range(200) for _ in range(64)]
    got = {(r["metric"], r["model"]): r for r in S.unpivoted_ranks(spark.createDataFrame(rows, "model int, run_ms double, quality double").repartition(7), "model", ["run_ms", "quality"]).collect()}
    rounded = lambda x: float((Decimal(x.numerator) / Decimal(x.denominator)).quantize(Decimal("0.000001"), ROUND_HALF_UP))
    for i, metric in ((1, "run_ms"), (2, "quality")):
        values = {m: [Fraction(str(r[i])) for r in rows if r[0] == m and r[i] is not None] for m in range(200)}
        means = {m: rounded(sum(v) / 64) for m, v in values.items()}
        assert {m: got[metric, m]["mean"] for m in means} == means
        assert {m: got[metric, m]["avg_present"] for m in means} == {m: rounded(sum(v) / len(v)) for m, v in values.items()}
        order = sorted(means, key=lambda m: (means[m] if metric == "run_ms" else -means[m], m))
        assert {m: got[metric, m]["rank"] for m in means} == {m: i + 1 for i, m in enumerate(order)}


def test_means_of_other_numbers(spark):
    rows = [("a", 1e300), ("a", 1e300), ("b", float("inf")), ("c", None), ("d", 0.5), ("d", None)]
    got = {r["model"]: (r["mean"], r["avg_present"]) for r in S.unpivoted_ranks(spark.createDataFrame(rows, "model string, x double"), "model", ["x"]).collect()}
    assert got == {"a": (1e300, 1e300), "b": (float("inf"), float("inf")), "c": (0.0, None), "d": (0.25, 0.5)}
