"""Queries on string similarity, which SQL lacks, against plain Python on the whole tables."""

from collections import defaultdict
from difflib import SequenceMatcher

import pytest

from tidemark import registry
from tidemark.operators import resolution as R
from tidemark.session import table

SF = "/root/testdata/sf0.01"


def ratio(a, b):
    return SequenceMatcher(None, a, b).ratio()


def rows(spark, name):
    return registry.queries()[name](spark, SF).collect()


@pytest.fixture(scope="module")
def parts(spark):
    return table(spark, SF, "part").orderBy("p_partkey").collect()


def clusters(items, least=0.85):
    """Seed of each (block, key, label), in key order."""
    seeds, out = defaultdict(list), {}
    for block, key, label in sorted(items, key=lambda x: x[1]):
        found = next((k for k, name in seeds[block] if ratio(name, label) >= least), None)
        if found is None:
            seeds[block].append((key, label))
        out[key] = key if found is None else found
    return out


def test_clusters(spark, parts):
    want = clusters([(p["p_brand"], p["p_partkey"], p["p_name"]) for p in parts])
    assert {r["p_partkey"]: r["seed"] for r in rows(spark, "d19_greedy_clusters")} == want


def test_batches(spark, parts):
    from pyspark.sql import functions as F

    batch = {r["p_partkey"]: r["b"] for r in table(spark, SF, "part").select("p_partkey", F.pmod(F.xxhash64("p_partkey"), F.lit(4)).alias("b")).collect()}
    first = clusters([((p["p_brand"], batch[p["p_partkey"]]), p["p_partkey"], p["p_name"]) for p in parts])
    second = clusters([(p["p_brand"], p["p_partkey"], p["p_name"]) for p in parts if first[p["p_partkey"]] == p["p_partkey"]])
    assert {r["p_partkey"]: r["seed"] for r in rows(spark, "g08_resolved_in_batches")} == {k: second[s] for k, s in first.items()}


def test_distinct_titles(spark, parts):
    best = {}
    for p in sorted(parts, key=lambda p: (-p["p_size"], p["p_partkey"])):
        best.setdefault((p["p_brand"], p["p_retailprice"]), p)
    seeds = clusters([(p["p_brand"], p["p_partkey"], p["p_name"]) for p in best.values()])
    assert sorted(r["p_partkey"] for r in rows(spark, "g05_distinct_titles")) == sorted(k for k, s in seeds.items() if k == s)


def test_ratio(spark, parts):
    want = {p["p_partkey"]: round(ratio(p["p_name"], p["p_type"]), 6) for p in parts}
    assert {r["p_partkey"]: r["ratio"] for r in rows(spark, "h34_string_ratio")} == want


def test_entity_similarity(spark):
    known = {c["c_custkey"]: c for c in table(spark, SF, "customer").collect()}
    near = lambda a, b: 1 - abs(a - b) / max(abs(a), abs(b)) if max(abs(a), abs(b)) else 1.0
    for r in rows(spark, "h40_entity_similarity"):
        a, b = known[r["c_custkey"]], known[r["c_custkey"] + 1]
        alike = (near(a["c_acctbal"], b["c_acctbal"]) + near(float(a["c_nationkey"]), float(b["c_nationkey"]))) / 2
        want = (0.5 * ratio(a["c_name"].lower(), b["c_name"].lower()) + 0.3 * alike) / 0.8 if a["c_mktsegment"] == b["c_mktsegment"] else 0.0
        assert r["similarity"] == pytest.approx(want, abs=1e-8)


def test_weights_with_and_without_embeddings(spark):
    from pyspark.sql import functions as F

    kinds = lambda a, b: (F.lit(a), F.lit(b))
    row = spark.range(1).select(
        R.entity_similarity(kinds("A", "a"), F.lit(1.0), F.lit(0.5)).alias("two"),
        R.entity_similarity(kinds("A", None), F.lit(1.0), F.lit(0.5), F.lit(0.25)).alias("three"),
        R.entity_similarity(kinds("A", "b"), F.lit(1.0), F.lit(1.0)).alias("none"),
    ).first()
    assert row["two"] == pytest.approx((0.5 + 0.15) / 0.8) and row["three"] == pytest.approx(0.5 + 0.15 + 0.05) and row["none"] == 0
