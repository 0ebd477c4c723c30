"""Alignment of two graphs against a plain matching, and precision, recall and F1."""

import random

from pyspark.sql import functions as F

from tidemark.operators import alignment as A


def plain(pairs):
    """Greedy over all pairs in the one order: what mutual best matches come to."""
    out, a, b = [], set(), set()
    for x, y, s in sorted(pairs, key=lambda p: (-p[2], p[1], p[0])):
        if x not in a and y not in b:
            out.append((x, y))
            a.add(x)
            b.add(y)
    return sorted(out)


def test_matching(spark):
    for seed in range(3):
        rng = random.Random(seed)
        pairs = list({(rng.randint(0, 25), rng.randint(0, 25)): rng.randint(1, 6) / 6 for _ in range(150)}.items())
        pairs = [(a, b, s) for (a, b), s in pairs]
        got = A.matched(spark.createDataFrame([*pairs, (None, 1, 1.0), (1, None, 1.0)], "a int, b int, score double"))
        assert sorted((r["a"], r["b"]) for r in got.collect()) == plain(pairs)


def test_a_chain_takes_many_rounds(spark):
    """Each pair is better than the next, so they are matched one after another."""
    pairs = [(i, i + d, 1.0 - (2 * i + d) / 100) for i in range(8) for d in (0, 1)]
    got = A.matched(spark.createDataFrame(pairs, "a int, b int, score double"))
    assert sorted((r["a"], r["b"]) for r in got.collect()) == plain(pairs)


def test_candidates_of_repeated_labels(spark):
    kind = "id int, kind string, label string, block string"
    found = spark.createDataFrame([(i, "P", "same", "s") for i in range(50)] + [(90, "P", "sama", "s"), (91, "Q", "same", "s"), (92, "P", None, "s")], kind)
    reference = spark.createDataFrame([(i, "P", "same", "s") for i in range(100, 140)], kind)
    score = 1 - F.levenshtein("label", "label_") / 4
    pairs = A.candidates(found, reference, score, 0.5)
    assert pairs.count() == 41
    assert A.matched(pairs).count() == 40
    assert A.matched(A.candidates(found.limit(0), reference, score, 0.5)).count() == 0


def test_accuracy(spark):
    nodes = spark.createDataFrame([(1,), (2,), (3,), (4,)], "id int")
    wanted = spark.createDataFrame([(11,), (12,), (15,)], "id int")
    edges = spark.createDataFrame([(1, 2, "K"), (1, 2, "K"), (2, 1, "K"), (1, 3, "K"), (1, 2, "L")], "source int, target int, kind string")
    reference = spark.createDataFrame([(11, 12, "K"), (11, 15, "K")], "source int, target int, kind string")
    matching = spark.createDataFrame([(1, 11), (2, 12)], "a int, b int")
    got = {r["what"]: tuple(r)[1:] for r in A.accuracy(nodes, edges, wanted, reference, matching).collect()}
    assert got == {"entities": (2, 4, 3, 0.5, 0.666667, 0.571429), "relations": (1, 4, 2, 0.25, 0.5, 0.333333)}
    none = {r["what"]: tuple(r)[1:] for r in A.accuracy(nodes.limit(0), edges.limit(0), wanted.limit(0), reference.limit(0), matching.limit(0)).collect()}
    assert none == {"entities": (0, 0, 0, 0.0, 0.0, 0.0), "relations": (0, 0, 0, 0.0, 0.0, 0.0)}
