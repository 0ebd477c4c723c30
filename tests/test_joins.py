"""Joins with hot keys, with limits low enough for each way, and components over hubs, long paths and loops."""

import random

import pytest

from tidemark.operators import events as E
from tidemark.operators import graph as G
from tidemark.operators import joins as J
from tidemark.session import table


@pytest.mark.parametrize("hot, few", [(50_000, 100_000), (10, 0), (10, 5), (1, 2), (1_000, 0)])
def test_every_way_of_joining(spark, monkeypatch, hot, few):
    monkeypatch.setattr(J, "HOT", hot)
    monkeypatch.setattr(J, "FEW", few)
    rng = random.Random(1)
    rows = [(rng.choice(["hot"] * 6 + ["b", "c", "d", None]), i) for i in range(200)]
    df = spark.createDataFrame(rows, "k string, i int")
    known = J.checkpointed(df.groupBy("k").count().withColumnRenamed("count", "n").withColumn("v", __import__("pyspark").sql.functions.upper("k")).filter("k != 'd'"))
    got = J.join_counted(df, known, "k", "n")
    assert sorted((r["k"], r["i"], r["v"]) for r in got.collect()) == sorted((k, i, k.upper()) for k, i in rows if k not in (None, "d"))


def test_wide_rows_are_not_broadcast(spark, monkeypatch):
    known = J.checkpointed(spark.range(100))
    assert J.few(known) and not J.few(known, width=J.FEW_BYTES // 50) and not J.few(known, most=99)


@pytest.mark.parametrize("hot", [50_000, 3])
def test_components(spark, monkeypatch, hot):
    monkeypatch.setattr(J, "HOT", hot)
    monkeypatch.setattr(J, "FEW", 20)
    rng = random.Random(hot)
    edges = [(0, i) for i in range(1, 60)] + [(i, i + 1) for i in range(100, 170)] + [(200, 200), (300, 301), (301, 302), (302, 300)] + [(rng.randint(400, 600), rng.randint(400, 600)) for _ in range(120)]
    nodes = sorted({x for e in edges for x in e} | {999})
    got = {r["id"]: r["component"] for r in G.components(spark.createDataFrame([(x,) for x in nodes], "id int"), spark.createDataFrame([*edges, (None, 5)], "source int, target int")).collect()}
    label = {x: x for x in nodes}

    def find(x):
        while label[x] != x:
            x = label[x]
        return x

    for a, b in edges:
        low, high = sorted((find(a), find(b)))
        label[high] = low
    assert got == {x: find(x) for x in nodes}


def test_percentiles_of_many_keys(spark, monkeypatch):
    """The same percentiles where sketches are too many for a broadcast and keys are hot."""
    events = table(spark, "/root/testdata/sf0.001", "events")
    results = []
    for hot, few in ((50_000, 100_000), (100, 2), (100, 0)):
        monkeypatch.setattr(J, "HOT", hot)
        monkeypatch.setattr(J, "FEW", few)
        results.append([sorted(map(str, f(events).collect())) for f in (E.floor_percentiles, E.linear_percentiles)])
    assert results[0] == results[1] == results[2]
