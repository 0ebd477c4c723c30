"""Observed runs and profiles."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from tidemark.operators import monitor as M
from tidemark.operators import profile as P

ROWS = [(1, "b", 2.5, [1]), (2, None, None, None), (3, "a", -1.0, [])]
KIND = "id long, t string, x double, l array<int>"


def test_one_pass_gives_the_metrics(spark, tmp_path):
    df = spark.createDataFrame(ROWS, KIND)
    store, out = f"{tmp_path}/m", f"{tmp_path}/out"
    M.monitored(df, "copy", lambda d: d.write.parquet(out), store, "r1")
    assert spark.read.parquet(out).count() == 3
    got = {r["column"]: (r["rows"], r["nulls"], r["low"], r["high"]) for r in M.metrics(spark, store).collect()}
    assert got == {"id": (3, 0, "1", "3"), "t": (3, 1, "a", "b"), "x": (3, 1, "-1.0", "2.5"), "l": (3, 1, None, None)}
    M.monitored(df.limit(0), "none", lambda d: d.collect(), store)
    assert M.metrics(spark, store).filter("operation = 'none' AND rows = 0 AND nulls = 0").count() == 4


def test_failures_are_recorded_and_raised(spark, tmp_path):
    def fail(_):
        raise ValueError("broken")

    with pytest.raises(ValueError, match="broken"):
        M.monitored(spark.range(3), "bad", fail, f"{tmp_path}/m")
    assert [(r["success"], r["error_type"], r["column"]) for r in M.metrics(spark, f"{tmp_path}/m").collect()] == [(False, "ValueError", None)]


def test_streams(spark, tmp_path):
    spark.createDataFrame(ROWS, KIND).coalesce(1).write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema(KIND).parquet(f"{tmp_path}/in")
    listener = M.StreamMetrics("copied", stream.columns)
    spark.streams.addListener(listener)
    try:
        stream.observe("copied", *M.measures(stream)).writeStream.format("noop").option("checkpointLocation", f"{tmp_path}/c").trigger(availableNow=True).start().awaitTermination()
        for _ in range(50):
            if listener.rows:
                break
            __import__("time").sleep(0.2)
    finally:
        spark.streams.removeListener(listener)
    assert {r["column"]: (r["rows"], r["nulls"], r["low"]) for r in listener.table(spark).collect()} == {"id": (3, 0, "1"), "t": (3, 1, "a"), "x": (3, 1, "-1.0"), "l": (3, 1, None)}


def test_kinds_and_statistics(spark):
    rows = [("1", "1.5", "2024-01-02", "True", "x", None, 5, dt.date(2024, 1, 1)), ("-20", "3", "2023-12-31", "false", "10", None, None, None), (None, "1e2", None, "TRUE", "", None, 7, None)]
    df = spark.createDataFrame(rows, "i string, n string, d string, b string, t string, e string, l long, day date")
    got = {r["column"]: r for r in P.profile(df).collect()}
    assert {c: r["kind"] for c, r in got.items()} == {"i": "integer", "n": "number", "d": "date", "b": "boolean", "t": "text", "e": "empty", "l": "integer", "day": "date"}
    assert (got["i"]["low"], got["i"]["high"], got["i"]["mean"], got["i"]["nulls"]) == ("-20.0", "1.0", -9.5, 1)
    assert (got["d"]["low"], got["t"]["shortest"], got["t"]["longest"], got["t"]["mean"]) == ("2023-12-31", 0, 2, None)
    assert P.profile(df.limit(0)).filter("kind = 'empty' AND rows = 0").count() == 8


def test_distinct_counts_and_containment(spark):
    df = spark.range(60_000).select(F.col("id").alias("all"), (F.col("id") % 40_000).alias("most"), (F.col("id") % 7).alias("few"), F.lit(None).cast("long").alias("none"))
    made = P.profile(df, sketches=True)
    got = {r["column"]: r["distinct"] for r in P.distinct_counts(made).collect()}
    for c, want in (("all", 60_000), ("most", 40_000), ("few", 7)):
        assert abs(got[c] - want) <= 3 * P.STANDARD_ERROR * want
    assert got["none"] == 0
    halves = P.profile(df.filter("id < 30000"), True).unionByName(P.profile(df.filter("id >= 30000"), True))
    assert abs({r["column"]: r["distinct"] for r in P.united(halves).collect()}["all"] - 60_000) <= 3 * P.STANDARD_ERROR * 60_000
    pairs = {(r["inner"], r["outer"]) for r in P.contained(made).collect()}
    assert {("most", "all"), ("few", "most"), ("few", "all")} <= pairs and ("all", "most") not in pairs and ("all", "few") not in pairs


def test_registered_sketches_on_a_table(spark):
    """h92_distinct_counts and h92_contained_columns against exact counts."""
    from tidemark import registry
    from tidemark.session import table

    sf = "/root/testdata/sf0.01"
    orders, line = table(spark, sf, "orders"), table(spark, sf, "lineitem")
    exact = orders.agg(F.countDistinct("o_orderkey").alias("o_orderkey"), F.countDistinct("o_orderstatus").alias("o_orderstatus"), F.countDistinct(F.to_date("o_orderdate")).alias("o_day")).first()
    got = {r["column"]: r["distinct"] for r in registry.queries()["h92_distinct_counts"](spark, sf).collect()}
    for c in ("o_orderkey", "o_orderstatus", "o_day"):
        assert abs(got[c] - exact[c]) <= 3 * P.STANDARD_ERROR * exact[c]
    assert got["o_none"] == 0
    values = {c: {r[0] for r in line.select(c).distinct().collect()} for c in ("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber")}
    pairs = {(r["inner"], r["outer"]) for r in registry.queries()["h92_contained_columns"](spark, sf).collect()}
    assert {(a, b) for a in values for b in values if a != b and values[a] <= values[b]} <= pairs
