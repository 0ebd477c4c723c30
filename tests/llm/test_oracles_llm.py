"""The corpus queries that have SQL, against DuckDB on the sf0.01 tables."""

import duckdb
import pytest

from tidemark.llm import queries as Q

SF = "/root/testdata/sf0.01"
TYPES = {"bigint": "BIGINT", "int": "INTEGER", "string": "VARCHAR", "boolean": "BOOLEAN"}


@pytest.mark.parametrize("name", sorted(Q.oracle_sql()))
def test_query_matches_sql(name, spark):
    con = duckdb.connect()
    for t in ("documents", "embeddings", "conversations", "benchmark"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    got = Q.queries()[name](spark, SF)
    sql = Q.oracle_sql()[name]
    assert {c: TYPES[t] for c, t in got.dtypes} == {r[0]: r[1] for r in con.execute(f"DESCRIBE {sql}").fetchall()}
    want = con.execute(f"SELECT {', '.join(got.columns)} FROM ({sql})").fetchall()
    assert sorted(map(repr, map(tuple, got.collect()))) == sorted(map(repr, want))
