"""Registered queries on the events table."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.operators import events as E
from tidemark.registry import query
from tidemark.session import table


def _on(f, *args, **kw):
    return lambda spark, sf: f(table(spark, sf, "events"), *args, **kw)


K = "CAST(json_extract_string(props, '$.k') AS DOUBLE)"
US = "epoch_us"

query("f01_global_counts", _on(E.global_counts), "SELECT count(*) total_events, count(DISTINCT user_id) total_users, count(DISTINCT event_type) total_types, count(*) FILTER (event_type = 'error') total_errors FROM events")
query(
    "f02_daily_requests",
    _on(E.daily_requests, "2024-01-24", 7),
    """WITH d AS (SELECT CAST(unnest(generate_series(TIMESTAMP '2024-01-24', TIMESTAMP '2024-01-30', INTERVAL 1 DAY)) AS DATE) AS day)
    SELECT day, coalesce(n, 0) AS requests FROM d LEFT JOIN (SELECT CAST(ts AS DATE) AS day, count(*) AS n FROM events GROUP BY 1) USING (day)""",
)
query(
    "f03_endpoint_latency",
    lambda spark, sf: table(spark, sf, "events").groupBy(F.col("event_type").alias("endpoint")).agg(F.round(F.avg("value") * 1000, 4).alias("avg_ms")).orderBy(F.desc("avg_ms"), "endpoint").limit(5),
    "SELECT event_type AS endpoint, round(avg(value) * 1000, 4) AS avg_ms FROM events GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 5",
)
query(
    "f04_hourly_performance",
    _on(E.hourly_performance, "2024-01-15", 24),
    f"""WITH h AS (SELECT unnest(generate_series(TIMESTAMP '2024-01-15', TIMESTAMP '2024-01-15 23:00:00', INTERVAL 1 HOUR)) AS hour),
    a AS (SELECT date_trunc('hour', ts) AS hour, count(*) n, avg(value) t, avg(CASE WHEN {K} >= 50 THEN {K} END) m, avg(CASE WHEN {K} < 50 THEN {K} END) c FROM events GROUP BY 1)
    SELECT h.hour, coalesce(n, 0) AS requests, coalesce(round(t, 6), 0.0) AS avg_time, coalesce(round(m, 6), 0.0) AS avg_memory, coalesce(round(c, 6), 0.0) AS avg_cpu FROM h LEFT JOIN a USING (hour)""",
)
query("c21_newest_events", _on(E.newest), "SELECT event_id, ts, user_id, event_type, value FROM events ORDER BY ts DESC, event_id DESC LIMIT 100")
query("c22_recent_performance", _on(E.recent_performance, "click"), f"SELECT event_id, ts, round(value * 1000, 4) AS response_ms, round({K}, 4) AS memory_mb FROM events WHERE event_type = 'click' ORDER BY ts DESC, event_id DESC LIMIT 10")
query(
    "d18_usage_and_errors",
    _on(E.usage_and_errors),
    """SELECT user_id, coalesce(usage, 0) AS usage, coalesce(avg_value, 0.0) AS avg_value, coalesce(errors, 0) AS errors
    FROM (SELECT user_id, count(*) usage, round(avg(value), 6) avg_value FROM events WHERE event_type <> 'error' GROUP BY 1)
    FULL JOIN (SELECT user_id, count(*) errors FROM events WHERE event_type = 'error' GROUP BY 1) USING (user_id)""",
)
query(
    "f06_provider_shares",
    _on(E.provider_shares),
    "SELECT event_type, count(*) AS requests, round(avg(value), 6) AS weighted_latency, round(100.0 * count(*) / sum(count(*)) OVER (), 6) AS share_pct FROM events GROUP BY 1",
)
query(
    "e05_floor_percentiles",
    _on(E.floor_percentiles),
    """WITH s AS (SELECT event_type, list_sort(list(value)) AS v, count(*) AS n FROM events GROUP BY 1)
    SELECT event_type, n, v[CAST(floor(n * 0.5) AS BIGINT) + 1] p50, v[CAST(floor(n * 0.9) AS BIGINT) + 1] p90, v[CAST(floor(n * 0.95) AS BIGINT) + 1] p95, CASE WHEN n >= 100 THEN v[CAST(floor(n * 0.99) AS BIGINT) + 1] END p99 FROM s""",
)
query(
    "f17_linear_percentiles",
    _on(E.linear_percentiles),
    """WITH s AS (SELECT event_type, round(avg(value), 6) avg, max(value) max, min(value) min, round(quantile_cont(value, 0.25), 6) p25, round(quantile_cont(value, 0.5), 6) p50, round(quantile_cont(value, 0.75), 6) p75,
      round(quantile_cont(value, 0.9), 6) p90, round(quantile_cont(value, 0.95), 6) p95, round(quantile_cont(value, 0.99), 6) p99, quantile_cont(value, 0.95) cut FROM events GROUP BY 1)
    SELECT event_type, s.avg, s.max, s.min, p25, p50, p75, p90, p95, p99, (SELECT count(*) FROM events e WHERE e.event_type = s.event_type AND e.value > 1.5 * s.cut) AS spikes FROM s""",
)
query(
    "e08_last_points",
    _on(E.last_points),
    "SELECT event_type, count(*) points, round(avg(value), 6) mean, max(ts) last_updated FROM (SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY ts DESC, event_id DESC) r FROM events) WHERE r <= 1000 GROUP BY 1",
)
query("e10_trailing_100", _on(E.trailing), "SELECT user_id, CAST(r AS INTEGER) AS position, event_id, value FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) r FROM events) WHERE r <= 100")
query(
    "e09_current_window",
    _on(E.current_window),
    """WITH l AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY ts DESC, event_id DESC) r FROM events) WHERE r <= 100),
    s AS (SELECT event_type, count(*) n, round(avg(value), 6) mean, min(value) min, max(value) max, round(quantile_cont(value, 0.5), 6) median, list_sort(list(value)) v FROM l GROUP BY 1)
    SELECT event_type, n, mean, s.min, s.max, s.median, CASE WHEN n >= 20 THEN v[CAST(floor(n * 0.95) AS BIGINT) + 1] END p95 FROM s""",
)
query("e13_monitored_duration", _on(E.monitored_duration), "SELECT user_id, epoch_us(max(ts)) - epoch_us(min(ts)) AS duration_us, count(*) AS samples FROM events GROUP BY 1")
query(
    "e14_growth_steps",
    _on(E.growth_steps),
    """WITH s AS (SELECT *, value - lag(value) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS step, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS a, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS z FROM events),
    g AS (SELECT user_id, count(*) samples, max(CASE WHEN a = 1 THEN value END) f, max(CASE WHEN z = 1 THEN value END) l, max(value) p, avg(value) m, max(step) st FROM s GROUP BY 1)
    SELECT user_id, samples, round((l - f) / nullif(f, 0), 6) growth_rate, round(p / nullif(m, 0), 6) peak_ratio, round(st, 6) max_increase, (l - f) / nullif(f, 0) > 0.2 AS leak, p / nullif(m, 0) > 2.0 AS spike FROM g""",
)
query("f20_operation_stats", _on(E.operation_stats), f"SELECT event_type, count(*) AS count, count(*) FILTER ({K} >= 90) AS failed, round(sum(value), 4) total_time, min(value) min_time, max(value) max_time, round(avg(value), 6) avg_time FROM events GROUP BY 1")
query("f19_hit_rate", _on(E.hit_rate), f"SELECT count(*) operations, count(*) FILTER ({K} % 2 = 0) hits, round(count(*) FILTER ({K} % 2 = 0) / count(*), 6) hit_rate FROM events")
query("f18_resource_means", _on(E.resource_means), f"SELECT 'value' AS resource, round(avg(value), 6) AS mean FROM events UNION ALL SELECT 'k', round(avg({K}), 6) FROM events")
for _name, _units, _sql in (("f21_speech_rates", "length(props)", "length(props)"), ("f22_synthesis_rates", "length(event_type)", "length(event_type)"), ("f23_token_rates", "get_json_object(props, '$.k')", K)):
    query(
        _name,
        _on(E.throughput, "event_type", f"cast({_units} AS double)", "value"),
        f"WITH e AS (SELECT event_type, value, CAST({_sql} AS DOUBLE) AS u FROM events) SELECT event_type, count(*) requests, round(sum(u), 4) units, round(sum(value), 4) AS seconds, round(sum(u) / nullif(sum(value), 0), 6) units_per_second, round(sum(value) / nullif(sum(u), 0), 6) real_time_factor FROM e GROUP BY 1",
    )
query("f25_latency_histogram", _on(E.histogram), "SELECT event_type, CAST(floor(value / 100.0) * 100 AS BIGINT) AS bucket, count(*) n FROM events GROUP BY 1, 2")
query("f26_errors_by_code", _on(E.errors_by_type), f"SELECT CAST(floor({K} / 10) AS BIGINT) AS code, count(*) errors, round(100.0 * count(*) / (SELECT count(*) FROM events), 6) rate_pct FROM events WHERE event_type = 'error' GROUP BY 1")
query("f45_daily_baseline", _on(E.daily_baseline), "SELECT CAST(ts AS DATE) AS day, count(*) n, round(avg(CAST(event_type = 'error' AS INTEGER)), 6) error_rate, round(avg(value), 6) mean_time FROM events GROUP BY 1")
query(
    "f46_error_rate_alerts",
    _on(E.error_rate_alerts),
    """WITH r AS (SELECT CAST(ts AS DATE) AS day, 100.0 * count(*) FILTER (event_type = 'error') / count(*) AS rate FROM events GROUP BY 1), b AS (SELECT *, lag(rate) OVER (ORDER BY day) AS before FROM r)
    SELECT day, round(rate, 6) rate_pct, CASE WHEN rate >= 20 THEN 'critical' WHEN rate >= 10 THEN 'error' WHEN rate >= 5 THEN 'warning' ELSE 'ok' END AS level, round(100.0 * (rate - before) / nullif(before, 0), 6) over_baseline_pct FROM b""",
)
query(
    "f47_running_means",
    _on(E.running_means),
    """SELECT user_id, count(*) total, count(*) FILTER (event_type <> 'error') success, count(*) FILTER (event_type = 'error') failure, round(avg(value), 6) avg_time,
    CAST(floor(1000.0 * count(*) FILTER (event_type <> 'error') / count(*)) / 10 AS VARCHAR) || '%' AS success_rate FROM events GROUP BY 1""",
)
query("k08_daily_quota", _on(E.daily_quota), "SELECT user_id, CAST(ts AS DATE) AS day, count(*) used, count(*) < 3 AS can_send FROM events GROUP BY 1, 2")
query(
    "e03_prioritised_alerts",
    _on(E.prioritised_alerts, "2024-01-31"),
    f"""WITH g AS (SELECT user_id, event_type, CASE WHEN {K} >= 90 THEN 'critical' WHEN {K} >= 60 THEN 'error' ELSE 'warning' END AS severity, CASE WHEN {K} >= 90 THEN 1.0::DOUBLE WHEN {K} >= 60 THEN 0.7::DOUBLE ELSE 0.4::DOUBLE END AS weight,
      count(*) n, min((epoch_us(TIMESTAMP '2024-01-31') // 1000000 - epoch_us(ts) // 1000000) / 3600.0) AS hours FROM events GROUP BY 1, 2, 3, 4),
    s AS (SELECT *, round((0.5::DOUBLE * weight + 0.3::DOUBLE * greatest(0.0, 1 - hours / 24) + 0.2::DOUBLE * least(1.0, n / 10)) * CASE WHEN event_type = 'error' THEN 1.2::DOUBLE ELSE 1.0::DOUBLE END, 6) AS priority FROM g)
    SELECT CAST(row_number() OVER (ORDER BY priority DESC, user_id, event_type, severity) AS INTEGER) AS rank, user_id, event_type, severity, n, priority FROM s ORDER BY priority DESC, user_id, event_type, severity LIMIT 20""",
)
query(
    "e15_step_durations",
    _on(E.step_durations),
    """SELECT user_id, event_id, epoch_us(until) - epoch_us(ts) AS duration_us FROM (SELECT *, lead(event_type) OVER w AS nxt, lead(ts) OVER w AS until FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)) WHERE event_type = 'click' AND nxt = 'purchase'""",
)
COOLED = """WITH RECURSIVE a AS (SELECT event_type, event_id, epoch_us(ts) AS at, row_number() OVER (PARTITION BY event_type ORDER BY ts, event_id) AS i FROM events WHERE event_type = 'error'),
    n AS (SELECT x.event_type, x.i, min(y.i) AS next FROM a x JOIN a y ON x.event_type = y.event_type AND y.at >= x.at + 3600000000 GROUP BY 1, 2),
    s(event_type, i) AS (SELECT DISTINCT event_type, CAST(1 AS BIGINT) FROM a UNION ALL SELECT s.event_type, n.next FROM s JOIN n USING (event_type, i))
    SELECT event_type, event_id FROM a JOIN s USING (event_type, i)"""
query("e11_cooled_down_alerts", lambda spark, sf: E.cooled_down(table(spark, sf, "events").filter("event_type = 'error'"), 3600), COOLED)
