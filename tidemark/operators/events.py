"""Usage-event analytics: counts, latency, daily and hourly series, histograms, percentiles, alerts, quotas.

An event row is (event_id, ts, user_id, event_type, value, props); value is a response time in seconds.
All aggregations combine on the map side; series are joined to a spine whose length the caller sets.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.operators.joins import checkpointed, join_counted
from tidemark.operators.stateful import folded, sparse_runs

#: Alert levels of error rates in percent, and of response times in seconds.
ERROR_LEVELS = {"warning": 5.0, "error": 10.0, "critical": 20.0}
RESPONSE_LEVELS = {"warning": 5.0, "error": 10.0, "critical": 30.0}
SEVERITY = {"critical": 1.0, "error": 0.7, "warning": 0.4}


def json_number(column: str, path: str) -> Column:
    return F.get_json_object(column, path).cast("double")


def global_counts(events: DataFrame) -> DataFrame:
    """rows, distinct users, distinct types, error rows."""
    return events.agg(
        F.count("*").alias("total_events"), F.countDistinct("user_id").alias("total_users"), F.countDistinct("event_type").alias("total_types"), F.count(F.when(F.col("event_type") == "error", 1)).alias("total_errors")
    )


def spine(events: DataFrame, start: str, n: int, unit: str) -> DataFrame:
    """n consecutive days or hours from a start, as one column ``at``."""
    first = F.lit(start).cast("timestamp_ntz")
    step = F.expr(f"interval 1 {unit}")
    return events.sparkSession.range(1).select(F.explode(F.sequence(first, first + F.expr(f"interval {n - 1} {unit}"), step)).alias("at"))


def daily_requests(events: DataFrame, start: str, days: int = 7) -> DataFrame:
    """events per day from a start, zero-filled, chronological."""
    end = F.lit(start).cast("timestamp_ntz") + F.expr(f"interval {days} day")
    counts = events.filter((F.col("ts") >= F.lit(start).cast("timestamp_ntz")) & (F.col("ts") < end)).groupBy(F.date_trunc("day", "ts").cast("timestamp_ntz").alias("at")).agg(F.count("*").alias("n"))
    return F.broadcast(spine(events, start, days, "day")).join(counts, "at", "left").select(F.col("at").cast("date").alias("day"), F.coalesce("n", F.lit(0)).alias("requests")).orderBy("day")


def hourly_performance(events: DataFrame, start: str, hours: int = 24) -> DataFrame:
    """mean time, and means of two JSON measures over the rows that have them, per hour, zero-filled."""
    end = F.lit(start).cast("timestamp_ntz") + F.expr(f"interval {hours} hour")
    k = json_number("props", "$.k")
    means = (
        events.filter((F.col("ts") >= F.lit(start).cast("timestamp_ntz")) & (F.col("ts") < end))
        .groupBy(F.date_trunc("hour", "ts").cast("timestamp_ntz").alias("at"))
        .agg(F.count("*").alias("n"), F.avg("value").alias("t"), F.avg(F.when(k >= 50, k)).alias("m"), F.avg(F.when(k < 50, k)).alias("c"))
    )
    zero = lambda c: F.coalesce(F.round(c, 6), F.lit(0.0))
    return F.broadcast(spine(events, start, hours, "hour")).join(means, "at", "left").select(F.col("at").alias("hour"), F.coalesce("n", F.lit(0)).alias("requests"), zero("t").alias("avg_time"), zero("m").alias("avg_memory"), zero("c").alias("avg_cpu"))


def newest(events: DataFrame, n: int = 100) -> DataFrame:
    """The newest events; a top-n without a full sort."""
    return events.orderBy(F.desc("ts"), F.desc("event_id")).limit(n).select("event_id", "ts", "user_id", "event_type", "value")


def recent_performance(events: DataFrame, kind: str, n: int = 10) -> DataFrame:
    """The newest events of a type with milliseconds and a JSON measure as megabytes."""
    top = events.filter(F.col("event_type") == kind).orderBy(F.desc("ts"), F.desc("event_id")).limit(n)
    return top.select("event_id", "ts", F.round(F.col("value") * 1000, 4).alias("response_ms"), F.round(json_number("props", "$.k") * 1024 * 1024 / (1024 * 1024), 4).alias("memory_mb"))


def usage_and_errors(events: DataFrame) -> DataFrame:
    """Per user usage (count, mean) with error counts, either side zero where missing."""
    use = events.filter("event_type != 'error'").groupBy("user_id").agg(F.count("*").alias("usage"), F.round(F.avg("value"), 6).alias("avg_value"))
    errors = events.filter("event_type = 'error'").groupBy("user_id").agg(F.count("*").alias("errors"))
    zero = lambda c: F.coalesce(c, F.lit(0))
    return use.join(errors, "user_id", "full").select("user_id", zero("usage").alias("usage"), F.coalesce("avg_value", F.lit(0.0)).alias("avg_value"), zero("errors").alias("errors"))


def provider_shares(events: DataFrame) -> DataFrame:
    """per type requests, share, request-weighted mean latency over users, error rate of the whole."""
    per_user = events.groupBy("event_type", "user_id").agg(F.count("*").alias("n"), F.avg("value").alias("mean"))
    per = per_user.groupBy("event_type").agg(F.sum("n").alias("requests"), (F.sum(F.col("mean") * F.col("n")) / F.sum("n")).alias("latency"))
    every = Window.partitionBy()  # one row an event type
    return per.select("event_type", "requests", F.round("latency", 6).alias("weighted_latency"), F.round(100.0 * F.col("requests") / F.sum("requests").over(every), 6).alias("share_pct"))


def order_statistics(df: DataFrame, by: str, value: str, ranks: dict[str, Column], shares: list[float], accuracy: int = 10_000, above: tuple[int, float] | None = None) -> DataFrame:
    """by, n, mean, least, most and, for each named rank (from 0, an expression over n), the value at that rank; exact, without sorting a key's rows.

    Each share has as many ranks, and a rank lies within one of the share's.

    ``shares`` are about the ranks' shares of the rows. Two scans: mergeable sketches bracket each share; then one pass sums up each key, counts the rows
    below each bracket, and keeps the values inside it, a few thousandths of the rows, with their counts. The sketches are a row a key; they are
    broadcast where there are few, and joined apart for hot keys where there are many. With ``above`` = (i, f) the i-th share's ranks i0 <= x <= i1 bracket f
    times a value between them too, and ``_beyond`` holds what is needed to count the rows above it, see ``linear_percentiles``.
    """
    slack = 4 / accuracy
    ends = F.array(*[F.lit(min(1.0, max(0.0, p + d))) for p in shares for d in (-slack, slack)])
    whole = df.select(F.col(by), F.col(value).alias("_x")).filter("_x IS NOT NULL")
    sketch = checkpointed(whole.groupBy(by).agg(F.percentile_approx("_x", ends, accuracy).alias("_e"), F.count("*").alias("n")))
    met = join_counted(whole, sketch, by, "n")
    brackets = [(F.get("_e", F.lit(2 * i)), F.get("_e", F.lit(2 * i + 1))) for i in range(len(shares))]
    if above:
        # The ranks beside the bracket's ends may lie one value outside it, so this bracket is that of the two shares around.
        brackets.append((F.get("_e", F.lit(2 * above[0])) * above[1] * (1 - 1e-9), F.get("_e", F.lit(2 * above[0] + 1)) * above[1] * (1 + 1e-9)))
    x = F.col("_x")
    kinds = [F.struct(F.lit(-1).alias("i"), F.lit(None).cast("double").alias("v")), *[F.when((x >= low) & (x <= high), F.struct(F.lit(i).alias("i"), x.cast("double").alias("v"))) for i, (low, high) in enumerate(brackets)]]
    own = F.col("_k.i") == -1
    each = lambda f: F.array(*[f(low, high) for low, high in brackets])
    spread = met.select(by, "n", "_x", "_e", F.explode(F.array_compact(F.array(*kinds))).alias("_k"))
    cells = checkpointed(
        spread.groupBy(by, "n", F.col("_k.i").alias("_i"), F.col("_k.v").alias("_v")).agg(
            F.count("*").alias("_c"),
            F.avg(F.when(own, x)).alias("mean"),
            F.min(F.when(own, x)).alias("least"),
            F.max(F.when(own, x)).alias("most"),
            each(lambda low, high: F.count_if(own & (x < low))).alias("_below"),
            each(lambda low, high: F.count_if(own & (x > high))).alias("_over"),
            each(lambda low, high: F.max(F.when(own & (x < low), x))).alias("_last"),
            each(lambda low, high: F.min(F.when(own & (x > high), x))).alias("_next"),
        )
    )
    totals = cells.filter("_i = -1").select(by, "mean", "least", "most", "_below", "_over", "_last", "_next")
    w = Window.partitionBy(by, "_i").orderBy("_v").rowsBetween(Window.unboundedPreceding, 0)
    summed = cells.filter("_i >= 0").select(by, "n", "_i", "_v", "_c", F.sum("_c").over(w).alias("_sum"))
    inside = join_counted(summed, totals.join(sketch.select(by, "n").withColumnRenamed("n", "_n"), by), by, "_n").withColumn("_upto", F.col("_sum") + F.get("_below", F.col("_i")))
    of = len(ranks) // len(shares)

    def at(rank: Column, i: int) -> Column:
        """The value at a rank that the i-th bracket, or the value beside it, holds."""
        here, under = F.col("_i") == i, F.get("_below", F.lit(i)) > rank
        found = F.min(F.when(here & ~under & (F.col("_upto") > rank), F.col("_v")))
        return F.coalesce(found, F.max(F.when(here, F.when(under, F.get("_last", F.lit(i))).otherwise(F.get("_next", F.lit(i))))))

    made = inside.groupBy(by).agg(*[F.max(c).alias(c) for c in ("n", "mean", "least", "most", "_over")], *[at(rank, i // of).alias(name) for i, (name, rank) in enumerate(ranks.items())])
    if not above:
        return made.drop("_over")
    near = cells.filter(F.col("_i") == len(shares)).select(by, "_v", "_c")
    return made.withColumn("_over", F.get("_over", F.lit(len(shares)))), near


def floor_percentiles(events: DataFrame, by: str = "event_type", value: str = "value") -> DataFrame:
    """sorted[int(n * p)] for p50, p90, p95, p99; p99 needs 100 points."""
    shares = {"p50": 0.5, "p90": 0.9, "p95": 0.95, "p99": 0.99}
    out = order_statistics(events, by, value, {name: F.floor(F.col("n") * p) for name, p in shares.items()}, list(shares.values()))
    return out.select(by, "n", *shares).withColumn("p99", F.when(F.col("n") >= 100, F.col("p99")))


def linear_percentiles(events: DataFrame, by: str = "event_type", value: str = "value") -> DataFrame:
    """mean, extremes, interpolated percentiles, and rows above 1.5 times the 95th, for values of 0 or more."""
    points = [25, 50, 75, 90, 95, 99]
    at = lambda p: (F.col("n") - 1) * (p / 100)
    ranks = {f"{side}{p}": F.floor(at(p)) if side == "a" else F.ceil(at(p)) for p in points for side in "ab"}
    found, near = order_statistics(events, by, value, ranks, [p / 100 for p in points], above=(points.index(95), 1.5))
    between = lambda p: F.col(f"a{p}") + (F.col(f"b{p}") - F.col(f"a{p}")) * (at(p) - F.floor(at(p)))
    made = checkpointed(found.select(by, F.round("mean", 6).alias("avg"), F.col("most").alias("max"), F.col("least").alias("min"), *[F.round(between(p), 6).alias(f"p{p}") for p in points], (1.5 * between(95)).alias("_cut"), "_over", "n"))
    more = join_counted(near, made.select(by, "_cut", "n"), by, "n").groupBy(by).agg(F.sum(F.when(F.col("_v") > F.col("_cut"), F.col("_c")).otherwise(0)).alias("_more"))
    return made.join(more, by, "left").select(by, "avg", "max", "min", *[f"p{p}" for p in points], (F.col("_over") + F.coalesce("_more", F.lit(0))).alias("spikes"))


def last_points(events: DataFrame, n: int = 1000, by: str = "event_type") -> DataFrame:
    """The last n points of each metric, and when it was last updated."""
    newest_first = Window.partitionBy(by).orderBy(F.desc("ts"), F.desc("event_id"))
    kept = events.withColumn("r", F.row_number().over(newest_first)).filter(F.col("r") <= n)
    return kept.groupBy(by).agg(F.count("*").alias("points"), F.round(F.avg("value"), 6).alias("mean"), F.max("ts").alias("last_updated"))


def trailing(events: DataFrame, n: int = 100, by: str = "user_id") -> DataFrame:
    """The last n events of each key, newest first."""
    w = Window.partitionBy(by).orderBy(F.desc("ts"), F.desc("event_id"))
    return events.withColumn("position", F.row_number().over(w)).filter(F.col("position") <= n).select(by, "position", "event_id", "value")


def current_window(events: DataFrame, n: int = 100, by: str = "event_type") -> DataFrame:
    """Over the last n events of a key: mean, extremes, median, and sorted[int(n * .95)] from 20 points on."""
    last = trailing(events.select(by, "ts", "event_id", "value"), n, by)
    w = Window.partitionBy(by)
    ranked = last.select(by, "value", (F.row_number().over(w.orderBy("value", "event_id")) - 1).alias("i"), F.count("*").over(w).alias("n"))
    p95 = F.max(F.when((F.col("n") >= 20) & (F.col("i") == F.floor(F.col("n") * 0.95)), F.col("value")))
    return ranked.groupBy(by).agg(F.max("n").alias("n"), F.round(F.avg("value"), 6).alias("mean"), F.min("value").alias("min"), F.max("value").alias("max"), F.round(F.percentile("value", 0.5), 6).alias("median"), p95.alias("p95"))


def monitored_duration(events: DataFrame, by: str = "user_id") -> DataFrame:
    """Seconds from the first to the last sample of each key."""
    return events.groupBy(by).agg((F.unix_micros(F.max("ts").cast("timestamp")) - F.unix_micros(F.min("ts").cast("timestamp"))).alias("duration_us"), F.count("*").alias("samples"))


def growth_steps(events: DataFrame, by: str = "user_id", value: str = "value", leak: float = 0.2, spike: float = 2.0) -> DataFrame:
    """Growth from first to last sample, peak over mean, largest step up, and leak and spike flags."""
    w = Window.partitionBy(by).orderBy("ts", "event_id")
    steps = events.withColumn("step", F.col(value) - F.lag(value).over(w))
    key = F.struct("ts", "event_id")
    out = steps.groupBy(by).agg(F.min_by(value, key).alias("first"), F.max_by(value, key).alias("last"), F.max(value).alias("peak"), F.avg(value).alias("mean"), F.max("step").alias("max_step"), F.count("*").alias("samples"))
    growth = (F.col("last") - F.col("first")) / F.nullif(F.col("first"), F.lit(0.0))
    ratio = F.col("peak") / F.nullif(F.col("mean"), F.lit(0.0))
    return out.select(by, "samples", F.round(growth, 6).alias("growth_rate"), F.round(ratio, 6).alias("peak_ratio"), F.round("max_step", 6).alias("max_increase"), (growth > leak).alias("leak"), (ratio > spike).alias("spike"))


def operation_stats(events: DataFrame, by: str = "event_type") -> DataFrame:
    """count, failures, total, extremes and mean time of each operation."""
    return events.groupBy(by).agg(
        F.count("*").alias("count"), F.count(F.when(json_number("props", "$.k") >= 90, 1)).alias("failed"), F.round(F.sum("value"), 4).alias("total_time"), F.min("value").alias("min_time"), F.max("value").alias("max_time"), F.round(F.avg("value"), 6).alias("avg_time")
    )


def hit_rate(events: DataFrame) -> DataFrame:
    """operations, hits and hit rate (0 without operations)."""
    hits = F.count(F.when(json_number("props", "$.k") % 2 == 0, 1))
    return events.agg(F.count("*").alias("operations"), hits.alias("hits"), F.round(F.coalesce(hits / F.nullif(F.count("*"), F.lit(0)), F.lit(0.0)), 6).alias("hit_rate"))


def resource_means(events: DataFrame) -> DataFrame:
    """mean of each resource."""
    return events.select(F.expr("stack(2, 'value', value, 'k', cast(get_json_object(props, '$.k') AS double)) AS (resource, x)")).groupBy("resource").agg(F.round(F.avg("x"), 6).alias("mean"))


def throughput(events: DataFrame, by: str, units: str, seconds: str) -> DataFrame:
    """F21, F22, F23, for expressions of units and seconds: both in total, units a second, and the seconds that one unit takes."""
    total, time = F.sum(F.expr(units)), F.sum(F.expr(seconds))
    return events.groupBy(by).agg(F.count("*").alias("requests"), F.round(total, 4).alias("units"), F.round(time, 4).alias("seconds"), F.round(total / F.nullif(time, F.lit(0.0)), 6).alias("units_per_second"), F.round(time / F.nullif(total, F.lit(0.0)), 6).alias("real_time_factor"))


def histogram(events: DataFrame, width: float = 100.0) -> DataFrame:
    """latency histogram in buckets of a width, by type."""
    return events.groupBy("event_type", (F.floor(F.col("value") / width) * int(width)).alias("bucket")).agg(F.count("*").alias("n"))


def errors_by_type(events: DataFrame) -> DataFrame:
    """errors by a JSON code, and their share of all events in percent."""
    k = F.floor(json_number("props", "$.k") / 10)
    per = events.filter("event_type = 'error'").groupBy(k.alias("code")).agg(F.count("*").alias("errors"))
    total = F.broadcast(events.agg(F.count("*").alias("total")).withColumn("one", F.lit(1)))
    return per.withColumn("one", F.lit(1)).join(total, "one").select("code", "errors", F.round(100.0 * F.col("errors") / F.col("total"), 6).alias("rate_pct"))


def daily_baseline(events: DataFrame) -> DataFrame:
    """per day error rate and mean response time."""
    return events.groupBy(F.to_date("ts").alias("day")).agg(F.count("*").alias("n"), F.round(F.avg((F.col("event_type") == "error").cast("double")), 6).alias("error_rate"), F.round(F.avg("value"), 6).alias("mean_time"))


def error_rate_alerts(events: DataFrame) -> DataFrame:
    """per day the error rate in percent, its level, and its change against the day before in percent."""
    per = events.groupBy(F.to_date("ts").alias("day")).agg((100.0 * F.count(F.when(F.col("event_type") == "error", 1)) / F.count("*")).alias("rate"))
    before = F.lag("rate").over(Window.orderBy("day"))  # one row a day
    level = F.when(F.col("rate") >= ERROR_LEVELS["critical"], "critical").when(F.col("rate") >= ERROR_LEVELS["error"], "error").when(F.col("rate") >= ERROR_LEVELS["warning"], "warning").otherwise("ok")
    return per.withColumn("before", before).select("day", F.round("rate", 6).alias("rate_pct"), level.alias("level"), F.round(100.0 * (F.col("rate") - F.col("before")) / F.nullif(F.col("before"), F.lit(0.0)), 6).alias("over_baseline_pct"))


def running_means(events: DataFrame) -> DataFrame:
    """per key totals, successes, failures, mean time, and success rate as text ('N/A' without rows)."""
    good = F.count(F.when(F.col("event_type") != "error", 1))
    rate = F.when(F.count("*") == 0, F.lit("N/A")).otherwise(F.concat((F.floor(1000.0 * good / F.count("*")) / 10).cast("string"), F.lit("%")))
    return events.groupBy("user_id").agg(F.count("*").alias("total"), good.alias("success"), (F.count("*") - good).alias("failure"), F.round(F.avg("value"), 6).alias("avg_time"), rate.alias("success_rate"))


def daily_quota(events: DataFrame, limit: int = 3) -> DataFrame:
    """Messages of a user by day, and whether another may be sent; the counter starts anew each day."""
    return events.groupBy("user_id", F.to_date("ts").alias("day")).agg(F.count("*").alias("used")).withColumn("can_send", F.col("used") < limit)


def prioritised_alerts(events: DataFrame, as_of: str, n: int = 20) -> DataFrame:
    """.5 severity + .3 recency over 24 hours + .2 volume, 1.2 times for one team; the top n with rank."""
    k = json_number("props", "$.k")
    severity = F.when(k >= 90, "critical").when(k >= 60, "error").otherwise("warning")
    weight = F.when(severity == "critical", SEVERITY["critical"]).when(severity == "error", SEVERITY["error"]).otherwise(SEVERITY["warning"])
    hours = (F.unix_seconds(F.lit(as_of).cast("timestamp")) - F.unix_seconds(F.col("ts").cast("timestamp"))) / 3600.0
    groups = events.groupBy("user_id", "event_type", severity.alias("severity"), weight.alias("weight")).agg(F.count("*").alias("n"), F.min(hours).alias("hours"))
    score = (0.5 * F.col("weight") + 0.3 * F.greatest(F.lit(0.0), 1 - F.col("hours") / 24) + 0.2 * F.least(F.lit(1.0), F.col("n") / 10)) * F.when(F.col("event_type") == "error", 1.2).otherwise(1.0)
    top = groups.withColumn("priority", F.round(score, 6)).orderBy(F.desc("priority"), "user_id", "event_type", "severity").limit(n)
    order = Window.orderBy(F.desc("priority"), "user_id", "event_type", "severity")  # n rows
    return top.select(F.row_number().over(order).alias("rank"), "user_id", "event_type", "severity", "n", "priority")


def step_durations(events: DataFrame) -> DataFrame:
    """Duration of each step from its start row to the next row that ends it, by user."""
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    nxt = events.select("user_id", "event_id", "event_type", "ts", F.lead("event_type").over(w).alias("then"), F.lead("ts").over(w).alias("until"))
    return nxt.filter("event_type = 'click' AND then = 'purchase'").select("user_id", "event_id", (F.unix_micros(F.col("until").cast("timestamp")) - F.unix_micros(F.col("ts").cast("timestamp"))).alias("duration_us"))


def cooled_down(alerts: DataFrame, seconds: int = 300, by: tuple[str, ...] = ("event_type",)) -> DataFrame:
    """Alerts that are sent: none within the cooldown after the last one SENT of its key.

    Keys are cut where a gap alone ends the cooldown, so that a hot key becomes many runs; each is folded in order.
    """
    micros = seconds * 1_000_000
    kinds = dict(alerts.dtypes)

    def step(rows: pd.DataFrame, last: int | None) -> tuple[pd.DataFrame, int]:
        at, sent, i = rows["_at"].to_numpy(), [], 0
        while i < len(at):
            if last is None or at[i] - last >= micros:
                last = int(at[i])
                sent.append(i)
            # The next that may be sent is the first at or after the end of the cooldown.
            i = max(i + 1, int(np.searchsorted(at, last + micros)))
        return rows.iloc[sent][[*by, "event_id"]], last

    timed = alerts.select(*by, "event_id", F.unix_micros(F.col("ts").cast("timestamp")).alias("_at"))
    runs = sparse_runs(timed, list(by), "_at", micros, "_run")
    return folded(runs, [*by, "_run"], ["_at", "event_id"], step, ", ".join(f"{c} {kinds[c]}" for c in (*by, "event_id")))
