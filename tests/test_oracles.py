"""Every registered query against its SQL in DuckDB, on the sf0.01 tables."""

import datetime
import decimal
import math
import os

import duckdb
import pytest

from tidemark import registry

SF = "/root/testdata/sf0.01"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def con():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    return con


def plain(x):
    if isinstance(x, float):
        return "nan" if math.isnan(x) else repr(x)
    if isinstance(x, (datetime.datetime, datetime.date)):
        return x.isoformat()
    if isinstance(x, decimal.Decimal):
        return str(x)
    if isinstance(x, (list, tuple)):
        return repr([plain(y) for y in x])
    return repr(x)


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_query_matches_sql(name, spark, con):
    only = os.environ.get("ONLY")
    if only and not any(name.startswith(x) for x in only.split(",")):
        pytest.skip("not asked for")
    got = registry.queries()[name](spark, SF)
    cur = con.execute(registry.oracle_sql()[name])
    names = [d[0] for d in cur.description]
    assert sorted(got.columns) == sorted(names)
    want = sorted([plain(x) for x in row] for row in cur.fetchall())
    rows = sorted([plain(x) for x in row] for row in got.select(*names).collect())
    assert len(rows) == len(want)
    assert rows == want


#: Queries that SQL cannot express, and the test that holds them against brute force.
BRUTE = {
    "d19_greedy_clusters": "test_resolution.py",
    "g05_distinct_titles": "test_resolution.py",
    "g08_resolved_in_batches": "test_resolution.py",
    "h34_string_ratio": "test_resolution.py",
    "h40_entity_similarity": "test_resolution.py",
    "h92_distinct_counts": "test_monitor.py",
    "h92_contained_columns": "test_monitor.py",
}


def test_every_query_is_held_against_something():
    assert set(registry.queries()) - set(registry.oracle_sql()) == set(BRUTE)
    for name, path in BRUTE.items():
        with open(os.path.join(os.path.dirname(__file__), path), encoding="utf-8") as f:
            assert name in f.read()
