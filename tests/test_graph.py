import pytest

from tidemark.operators import graph as G

NODE, EDGE = "id string, kind string, label string, confidence double", "source string, target string, kind string, confidence double"


def nodes(spark, *ids):
    return spark.createDataFrame([(i, "Person", i.upper(), 0.5) for i in ids], NODE)


def edges(spark, *pairs):
    return spark.createDataFrame([(*p.split("-"), "KNOWS", 0.5) for p in pairs], EDGE)


def test_dangling_edges_are_dropped(spark):
    n, e = nodes(spark, "a", "b"), edges(spark, "a-b", "a-x", "y-b", "x-y")
    assert [tuple(r)[:2] for r in G.complete_edges(e, n).select("source", "target").collect()] == [("a", "b")]
    assert G.dangling_edges(e, n).count() == 3


def test_merge_of_two_graphs(spark):
    n = nodes(spark, "p", "o").selectExpr("*", "0 AS ord").unionByName(nodes(spark, "o", "l").selectExpr("id", "kind", "label", "0.9D AS confidence", "1 AS ord"))
    got = {r["id"]: (r["confidence"], r["sources"]) for r in G.merged_nodes(n).collect()}
    assert got == {"p": (0.5, 1), "o": (0.9, 2), "l": (0.9, 1)}
    e = edges(spark, "p-o", "o-p", "p-o", "o-l")
    assert (G.distinct_edges(e).count(), G.distinct_edges(e, directed=False).count()) == (3, 2)


def test_five_nodes(spark):
    e = edges(spark, "n0-n1", "n1-n2", "n2-n3", "n3-n4", "n0-n3")
    hops = {r["id"]: r["hop"] for r in G.reached(e, nodes(spark, "n0"), 5, directed=True).collect()}
    assert hops == {"n0": 0, "n1": 1, "n3": 1, "n2": 2, "n4": 2}
    s = G.structure(nodes(spark, *[f"n{i}" for i in range(5)]), e).first()
    assert (s["nodes"], s["edges"], s["avg_degree"], s["density"]) == (5, 5, 2.0, 0.5)


def test_hops_do_not_chain(spark):
    e = edges(spark, "a-b", "b-c", "c-d")
    assert {r["id"] for r in G.reached(e, nodes(spark, "a"), 1).collect()} == {"a", "b"}


def test_components_of_a_long_path_and_single_nodes(spark):
    ids = [f"k{i:03d}" for i in range(60)]
    n = nodes(spark, *ids, "zz")
    got = {r["id"]: r["component"] for r in G.components(n, edges(spark, *[f"{a}-{b}" for a, b in zip(ids, ids[1:], strict=False)])).collect()}
    assert got == {i: "k000" for i in ids} | {"zz": "zz"}


def test_prune_and_cascade(spark):
    n = spark.createDataFrame([("a", "P", "A", 0.9), ("b", "P", "B", 0.8), ("c", "P", "C", 0.1), ("d", "P", "D", 0.7)], NODE)
    kept, inner = G.pruned(n, edges(spark, "a-b", "b-d", "a-c"), 0.5, 10, 2)
    assert [r["id"] for r in kept.collect()] == ["b"] and inner.count() == 0
    left, rest = G.updated(n, edges(spark, "a-b", "b-d"), nodes(spark, "a", "e"), nodes(spark, "d"))
    assert {r["id"] for r in left.collect()} == {"a", "b", "c", "e"} and rest.count() == 1


@pytest.mark.parametrize("reach", [5, 50])
def test_cooccurrence_is_a_range_join(spark, reach):
    places = [0, 3, 4, 9, 60, 61, 111, 200]
    m = spark.createDataFrame([(1, f"e{p}", p, p + 1) for p in places], "doc_id long, ent string, start long, end long")
    want = {(f"e{a}", f"e{b}") for a in places for b in places if b > a and 0 <= b - a - 1 <= reach}
    assert {(r["a"], r["b"]) for r in G.cooccurring(m, reach).collect()} == want
