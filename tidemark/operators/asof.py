"""As-of and interval joins by time buckets.

A key's rows are dealt into buckets of time, so no key is one task's work. For the as-of join each bucket is ordered by itself, and the
last value of the buckets before it is carried in from a table that holds one row a key and bucket. For the interval join an interval goes
to each bucket that it touches, points to their own, and a pair meets in the point's bucket alone.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _micros(c: str) -> Column:
    return F.unix_micros(F.col(c).cast("timestamp"))


def bucket_width(right: DataFrame, time: str, per_bucket: int = 100_000, most: int = 1_000_000) -> int:
    """Microseconds a bucket so that all rows together would fill one with ``per_bucket`` rows on average; at most ``most`` buckets. One row reaches the driver."""
    seen = right.agg(F.count(time).alias("n"), F.min(_micros(time)).alias("a"), F.max(_micros(time)).alias("b")).first()
    buckets = min(most, max(1, seen["n"] // per_bucket))
    return max(1, ((seen["b"] or 0) - (seen["a"] or 0)) // buckets + 1)


def asof_join(left: DataFrame, right: DataFrame, by: str, left_time: str, right_time: str, tie: str, values: list[str], width: int | None = None, tolerance: int | None = None) -> DataFrame:
    """Each left row with the values of the last right row of its key at or before its time; null where there is none.

    Of right rows at one time the one with the greatest ``tie`` counts. Right rows without a key, time or tie never count; a left row
    without a key or time finds none. ``width`` is a bucket's length in microseconds (taken from the right side where it is not given), ``tolerance`` the
    greatest age of a right row in microseconds.
    """
    width = width or bucket_width(right, right_time)
    own = F.struct(*left.columns)
    found = right.dropna(subset=[by, right_time, tie]).select(F.col(by).alias("k"), _micros(right_time).alias("at"), F.lit(0).alias("side"), F.col(tie).alias("tie"), F.lit(None).cast(left.select(own).schema[0].dataType).alias("row"), F.struct(_micros(right_time).alias("at"), *values).alias("value"))
    asked = left.select(F.col(by).alias("k"), _micros(left_time).alias("at"), F.lit(1).alias("side"), F.lit(None).cast(found.schema["tie"].dataType).alias("tie"), own.alias("row"), F.lit(None).cast(found.schema["value"].dataType).alias("value"))
    able = F.col("k").isNotNull() & F.col("at").isNotNull()
    bucket = F.floor(F.col("at") / width).alias("bucket")
    both = found.unionByName(asked.filter(able)).select("*", bucket)
    # The last right row of each bucket, and the last of all buckets before one: as many rows as keys have buckets.
    ends = both.groupBy("k", "bucket").agg(F.max_by("value", F.when(F.col("value").isNotNull(), F.struct("at", "tie"))).alias("end"))
    before = F.last("end", ignorenulls=True).over(Window.partitionBy("k").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1))
    carried = ends.select("k", "bucket", before.alias("carried")).filter("carried IS NOT NULL")
    inside = F.last("value", ignorenulls=True).over(Window.partitionBy("k", "bucket").orderBy("at", "side", "tie").rowsBetween(Window.unboundedPreceding, 0))
    met = both.select("k", "at", "bucket", "side", "row", inside.alias("inside")).filter("side = 1").join(carried, ["k", "bucket"], "left").select("row", "at", F.coalesce("inside", "carried").alias("value"))
    if tolerance is not None:
        met = met.withColumn("value", F.when(F.col("at") - F.col("value.at") <= tolerance, F.col("value")))
    none = asked.filter(~F.coalesce(able, F.lit(False))).select("row", "at", "value")
    return met.unionByName(none).select("row.*", *[F.col("value")[v].alias(v) for v in values])


def interval_join(intervals: DataFrame, points: DataFrame, by: str, start: str, end: str, time: str, width: int) -> DataFrame:
    """Pairs of an interval and a point of the same key with start <= time <= end: the interval's columns and, but for the key, the point's.

    ``width`` is a bucket's length in microseconds, best about that of an interval: an interval is copied to each bucket that it
    touches. Intervals that end before they start hold nothing.
    """
    cover = F.sequence(F.floor(_micros(start) / width), F.floor(_micros(end) / width))
    held = intervals.dropna(subset=[by, start, end]).filter(F.col(start) <= F.col(end)).withColumn("bucket_", F.explode(cover))
    met = points.dropna(subset=[by, time]).withColumn("bucket_", F.floor(_micros(time) / width))
    return held.join(met, [by, "bucket_"]).filter((F.col(time) >= F.col(start)) & (F.col(time) <= F.col(end))).drop("bucket_")
