"""Registered queries that run events as a stream of arrivals: sampled ring buffers, error records, sessions, stream joins.

The table arrives in slices of its time; the stream runs after each, from its checkpoint on.
"""

from __future__ import annotations

import json
import uuid
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.registry import query
from tidemark.session import shared_dir, table
from tidemark.streaming import errors as E
from tidemark.streaming import samplers as S
from tidemark.streaming import windows as W

PROVIDER = "spark.sql.streaming.stateStore.providerClass"


def _folder(spark: SparkSession, what: str) -> str:
    return f"{shared_dir(spark)}/{what}-{uuid.uuid4().hex}"


@contextmanager
def _rocksdb(spark: SparkSession):
    before = spark.conf.get(PROVIDER)
    S.with_rocksdb(spark)
    try:
        yield
    finally:
        spark.conf.set(PROVIDER, before)


def _arrived(spark: SparkSession, events: DataFrame, stream_of, mode: str = "append", last: DataFrame | None = None) -> DataFrame:
    """All that a stream over the arriving slices wrote; ``last`` is a slice that comes behind them."""
    folder, out, done = (_folder(spark, x) for x in ("arrivals", "results", "progress"))
    arriving = lambda: spark.readStream.schema(events.schema).parquet(folder).withColumn("ts", F.col("ts").cast("timestamp"))
    for _ in W.arrivals(events, folder):
        W.resumed(stream_of(arriving()), out, done, mode)
    if last is not None:
        last.write.mode("append").parquet(folder)
        W.resumed(stream_of(arriving()), out, done, mode)
    return spark.read.parquet(out).drop("batch")


def _ring(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = table(spark, sf_dir, "events")
    samples = lambda e: e.select(F.col("event_type").alias("key"), "ts", F.col("event_id").alias("id"), F.col("value").alias("watts"))
    with _rocksdb(spark):
        rows = _arrived(spark, events, lambda e: S.ring_buffers(samples(e), "2 hours", "30 minutes", 1000), "update")
    return S.latest(rows).select("key", F.col("first").alias("first_us"), F.col("last").alias("last_us"), "n", F.col("kept").cast("long").alias("kept"), "energy_wh", "mean_watts", "peak_watts")


query(
    "k02_k03_ring_buffers",
    _ring,
    """WITH e AS (SELECT event_type AS key, epoch_us(ts) AS t, event_id AS id, value AS w FROM events),
    g AS (SELECT *, CASE WHEN t - lag(t) OVER o <= 7200000000 THEN 0 ELSE 1 END AS new FROM e WINDOW o AS (PARTITION BY key ORDER BY t, id)),
    r AS (SELECT *, sum(new) OVER (PARTITION BY key ORDER BY t, id ROWS UNBOUNDED PRECEDING) AS run FROM g),
    k AS (SELECT *, row_number() OVER (PARTITION BY key, run ORDER BY t DESC, id DESC) AS back, count(*) OVER p AS n, min(t) OVER p AS first_us, max(t) OVER p AS last_us FROM r WINDOW p AS (PARTITION BY key, run)),
    z AS (SELECT *, (t - lag(t) OVER o) / 3.6e9::DOUBLE * (w + lag(w) OVER o) / 2 AS wh FROM k WHERE back <= 1000 WINDOW o AS (PARTITION BY key, run ORDER BY t, id))
    SELECT key, first_us, last_us, n, count(*) AS kept, round(coalesce(sum(wh), 0::DOUBLE), 6) AS energy_wh, round(avg(w), 6) AS mean_watts, max(w) AS peak_watts FROM z GROUP BY key, run, first_us, last_us, n""",
)


def _parsed(text: str) -> int:
    return json.loads(text)["k"]


def _tried(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events of which every seventeenth has its properties cut off, through both sinks; results and error records in one table."""
    events = table(spark, sf_dir, "events").withColumn("props", F.when(F.col("event_id") % 17 == 0, F.substring("props", 1, 4)).otherwise(F.col("props")))
    folder, good, bad, done = (_folder(spark, x) for x in ("arrivals", "good", "bad", "progress"))
    for _ in W.arrivals(events, folder):
        stream = spark.readStream.schema(events.schema).parquet(folder).select("event_id", "props")
        E.two_sinks(stream.withColumn("t", E.attempt(_parsed, "props", "long")), "t", good, bad, done)
    letters = spark.read.schema("event_id long, props string, error_type string, message string, retries int, batch int").parquet(bad).drop("batch")
    again = E.replayed(letters.withColumn("props", F.concat("props", F.lit('": 1}'))).filter("event_id % 2 = 0"), _parsed, "props", "long")
    results = spark.read.schema("event_id long, result long, batch int").parquet(good)
    return (
        results.select("event_id", F.lit("result").alias("sink"), "result", F.lit(None).cast("string").alias("error_type"))
        .unionByName(letters.select("event_id", F.lit("error").alias("sink"), F.lit(None).cast("long").alias("result"), "error_type"))
        .unionByName(again.select("event_id", F.concat(F.lit("replay "), "state").alias("sink"), "result", "error_type"))
    )


query(
    "k14_b13_error_records",
    _tried,
    """SELECT event_id, CASE WHEN event_id % 17 = 0 THEN 'error' ELSE 'result' END AS sink, CASE WHEN event_id % 17 <> 0 THEN CAST(json_extract_string(props, '$.k') AS BIGINT) END AS result, CASE WHEN event_id % 17 = 0 THEN 'JSONDecodeError' END AS error_type FROM events
    UNION ALL SELECT event_id, 'replay failed', NULL, 'JSONDecodeError' FROM events WHERE event_id % 34 = 0""",
)


def _sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sessions of users; every eleventh event arrives twice, and a row far ahead closes the last sessions."""
    events = table(spark, sf_dir, "events").select("event_id", "ts", "user_id", "value")
    twice = events.unionByName(events.filter("event_id % 11 = 0"))
    end = spark.range(1).select(F.lit(-1).cast("long").alias("event_id"), F.lit("2100-01-01").cast("timestamp_ntz").alias("ts"), F.lit(-1).cast("long").alias("user_id"), F.lit(0.0).alias("value"))
    rows = _arrived(spark, twice, lambda e: W.sessions(e, "user_id", "2 hours", "30 minutes"), last=end)
    return rows.select("user_id", F.unix_micros("started").alias("started_us"), F.unix_micros("ended").alias("ended_us"), "n", F.round("total", 4).alias("total"))


query(
    "streamed_sessions",
    _sessions,
    """WITH g AS (SELECT user_id, epoch_us(ts) AS t, event_id, value, CASE WHEN epoch_us(ts) - lag(epoch_us(ts)) OVER o <= 7200000000 THEN 0 ELSE 1 END AS new FROM events WINDOW o AS (PARTITION BY user_id ORDER BY ts, event_id)),
    r AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY t, event_id ROWS UNBOUNDED PRECEDING) AS run FROM g)
    SELECT user_id, min(t) AS started_us, max(t) + 7200000000 AS ended_us, count(*) AS n, round(sum(value), 4) AS total FROM r GROUP BY user_id, run""",
)


def _followed(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = table(spark, sf_dir, "events").select("event_id", "ts", "user_id", "event_type")
    return _arrived(spark, events, lambda e: W.followed(e.filter("event_type = 'click'"), e.filter("event_type = 'purchase'"), "user_id", "3 hours", "30 minutes"))


query(
    "streamed_clicks_before_purchases",
    _followed,
    "SELECT a.user_id AS key, a.event_id AS first_id, b.event_id AS then_id FROM events a JOIN events b ON a.user_id = b.user_id AND a.event_type = 'click' AND b.event_type = 'purchase' AND b.ts >= a.ts AND b.ts <= a.ts + INTERVAL 3 HOUR",
)


def _contexts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations as a stream: the turns of all sessions up to the third arrive first, then up to the sixth, then the rest."""
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", F.when(F.pmod("conv_id", F.lit(9)) != F.col("turn"), F.col("text")).alias("text"))
    folder, out, done = (_folder(spark, x) for x in ("turns", "contexts", "progress"))
    for some in ("turn < 3", "turn >= 3 AND turn < 6", "turn >= 6"):
        turns.filter(some).write.mode("append").parquet(folder)
        W.resumed(W.session_contexts(spark.readStream.schema(turns.schema).parquet(folder)), out, done)
    return spark.read.parquet(out).drop("batch")


query(
    "k07_streamed_contexts",
    _contexts,
    """WITH t AS (SELECT conv_id, turn, role, CASE WHEN conv_id % 9 <> turn THEN text END AS text FROM conversations),
    o AS (SELECT conv_id, turn, role, text, coalesce(text, '') <> '' AS ok, row_number() OVER (PARTITION BY conv_id ORDER BY turn, role, text) AS i FROM t),
    g AS (SELECT *, sum(CAST(ok AS INTEGER)) OVER (PARTITION BY conv_id ORDER BY i) - CAST(ok AS INTEGER) AS seen FROM o)
    SELECT conv_id, turn, role, CASE WHEN ok THEN 'ok' ELSE 'error' END AS status, CAST(least(5, seen) AS INTEGER) AS before,
      CASE WHEN ok THEN md5(coalesce((SELECT string_agg(h.role || ': ' || h.text, '' ORDER BY h.i) FROM g h WHERE h.conv_id = g.conv_id AND h.ok AND h.i < g.i AND h.seen >= g.seen - 5), '')) END AS context_md5 FROM g""",
)
