"""Registered queries for as-of and interval joins, observed runs and table profiles."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.operators import asof as A
from tidemark.operators import monitor as M
from tidemark.operators import profile as P
from tidemark.registry import query
from tidemark.session import shared_dir, table

HOUR = 3_600_000_000
#: Orders moved into the events' month: a user for each customer, a minute for each order.
_MOVED = "SELECT o_orderkey, o_custkey % 150 AS user_id, TIMESTAMP '2024-01-01' + INTERVAL 1 MINUTE * CAST(o_orderkey * 7 % 43200 AS INTEGER) AS at FROM orders"


def _orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").selectExpr("o_orderkey", "o_custkey % 150 AS user_id", "TIMESTAMP_NTZ '2024-01-01' + make_interval(0, 0, 0, 0, 0, CAST(o_orderkey * 7 % 43200 AS INT), 0) AS at")


def _events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select("user_id", "ts", "event_id", "value")


query(
    "asof_last_event",
    lambda s, d: A.asof_join(_orders(s, d), _events(s, d), "user_id", "at", "ts", "event_id", ["event_id", "value"]).select("o_orderkey", "user_id", "event_id", "value"),
    f"SELECT o_orderkey, o.user_id, e.event_id, e.value FROM ({_MOVED}) o ASOF LEFT JOIN events e ON o.user_id = e.user_id AND o.at >= e.ts",
)
query(
    "asof_last_event_within_an_hour",
    lambda s, d: A.asof_join(_orders(s, d), _events(s, d), "user_id", "at", "ts", "event_id", ["event_id"], width=6 * HOUR, tolerance=HOUR).select("o_orderkey", "event_id"),
    f"SELECT o_orderkey, CASE WHEN epoch_us(o.at) - epoch_us(e.ts) <= {HOUR} THEN e.event_id END AS event_id FROM ({_MOVED}) o ASOF LEFT JOIN events e ON o.user_id = e.user_id AND o.at >= e.ts",
)
query(
    "interval_events_around_orders",
    lambda s, d: A.interval_join(_orders(s, d).selectExpr("o_orderkey", "user_id", "at - INTERVAL 1 HOUR AS low", "at + INTERVAL 2 HOURS AS high"), _events(s, d), "user_id", "low", "high", "ts", 3 * HOUR).groupBy("o_orderkey").agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total")),
    f"SELECT o_orderkey, count(*) AS n, round(sum(value), 4) AS total FROM ({_MOVED}) o JOIN events e ON o.user_id = e.user_id AND e.ts BETWEEN o.at - INTERVAL 1 HOUR AND o.at + INTERVAL 2 HOUR GROUP BY 1",
)


def _observed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders written with their metrics taken on the way, and the metrics table that remains."""
    store, out = (f"{shared_dir(spark)}/{x}-{uuid.uuid4().hex}" for x in ("metrics", "copy"))
    orders = table(spark, sf_dir, "orders").withColumn("o_custkey", F.expr("nullif(o_custkey % 10, 0)"))
    M.monitored(orders, "copy orders", lambda df: df.write.parquet(out), store, "1")
    return M.metrics(spark, store).select("operation", "success", "column", "rows", "nulls", "low", "high")


_SEEN = " UNION ALL ".join(
    f"SELECT 'copy orders' AS operation, true AS success, '{c}' AS column, count(*) AS rows, count(*) - count(x) AS nulls, {low} AS low, {high} AS high FROM (SELECT {of} AS x FROM orders)"
    for c, of, low, high in [
        *((c, of, "CAST(min(x) AS VARCHAR)", "CAST(max(x) AS VARCHAR)") for c, of in (("o_orderkey", "o_orderkey"), ("o_custkey", "nullif(o_custkey % 10, 0)"), ("o_orderstatus", "o_orderstatus"), ("o_totalprice", "o_totalprice"), ("o_orderpriority", "o_orderpriority"))),
        ("o_orderdate", "o_orderdate", "strftime(min(x), '%Y-%m-%d %H:%M:%S')", "strftime(max(x), '%Y-%m-%d %H:%M:%S')"),
    ]
)
query("l06_observed_run", _observed, _SEEN)

_AS_TEXT = {"o_orderkey": "CAST(o_orderkey AS VARCHAR)", "o_custkey": "CASE WHEN o_custkey % 7 <> 0 THEN CAST(o_custkey AS VARCHAR) END", "o_orderstatus": "o_orderstatus", "o_day": "strftime(o_orderdate, '%Y-%m-%d')", "o_large": "CASE WHEN o_totalprice > 100000 THEN 'True' ELSE 'false' END", "o_cents": "CAST(CAST(round(o_totalprice * 100) AS BIGINT) / 4.0 AS VARCHAR)", "o_none": "CAST(NULL AS VARCHAR)"}


def _texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders with every column as text."""
    return table(spark, sf_dir, "orders").selectExpr(
        "CAST(o_orderkey AS string) AS o_orderkey", "CASE WHEN o_custkey % 7 <> 0 THEN CAST(o_custkey AS string) END AS o_custkey", "o_orderstatus", "date_format(o_orderdate, 'yyyy-MM-dd') AS o_day",
        "CASE WHEN o_totalprice > 100000 THEN 'True' ELSE 'false' END AS o_large", "CAST(CAST(round(o_totalprice * 100) AS bigint) / 4.0D AS decimal(20, 2)) AS o_cents", "CAST(NULL AS string) AS o_none",
    ).withColumn("o_cents", F.col("o_cents").cast("string"))


_AS_TEXT["o_cents"] = "CAST(CAST(CAST(round(o_totalprice * 100) AS BIGINT) / 4.0::DOUBLE AS DECIMAL(20, 2)) AS VARCHAR)"
_MATCH = lambda p: f"coalesce(bool_and(regexp_matches(lower(x), '{p}')), false)"
_KIND = f"CASE WHEN count(x) = 0 THEN 'empty' {' '.join(f"WHEN {_MATCH(p)} THEN '{k}'" for k, p in P.KINDS.items())} ELSE 'text' END"
_PROFILED = " UNION ALL ".join(f"SELECT '{c}' AS column, {_KIND} AS kind, count(*) AS rows, count(*) - count(x) AS nulls, min(length(x)) AS shortest, max(length(x)) AS longest, min(TRY_CAST(x AS DOUBLE)) AS l, max(TRY_CAST(x AS DOUBLE)) AS h, avg(TRY_CAST(x AS DOUBLE)) AS m, min(x) AS low, max(x) AS high FROM (SELECT {of} AS x FROM orders)" for c, of in _AS_TEXT.items())
query(
    "h92_profile",
    lambda s, d: P.profile(_texts(s, d)).select("column", "kind", "rows", "nulls", F.col("shortest").cast("long").alias("shortest"), F.col("longest").cast("long").alias("longest"), F.when(~F.col("kind").isin("integer", "number"), F.col("low")).alias("low_text"), F.when(F.col("kind").isin("integer", "number"), F.col("high").cast("double")).alias("high_number"), F.round("mean", 2).alias("mean")),
    f"SELECT \"column\", kind, rows, nulls, shortest, longest, CASE WHEN kind NOT IN ('integer', 'number') THEN low END AS low_text, CASE WHEN kind IN ('integer', 'number') THEN h END AS high_number, CASE WHEN kind IN ('integer', 'number') THEN round(m, 2) END AS mean FROM ({_PROFILED})",
)
query("h92_distinct_counts", lambda s, d: P.distinct_counts(P.profile(_texts(s, d), sketches=True)))
query("h92_contained_columns", lambda s, d: P.contained(P.profile(table(s, d, "lineitem").select("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber"), sketches=True)))
