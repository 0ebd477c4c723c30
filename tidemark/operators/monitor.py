"""Metrics of a running query as rows, taken while it runs.

``monitored`` runs an action on a table that is observed: rows, nulls and extremes of every column are summed up in the tasks that
do the work anyway, without a second scan, and the run becomes rows of a metrics table, also where it fails. ``StreamMetrics`` is the same for a
stream, a listener that keeps the observed figures of the last batches.
"""

from __future__ import annotations

import time
from collections import deque
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQueryListener
from pyspark.sql.types import ArrayType, BinaryType, MapType, StructType, VariantType

METRICS = "operation string, run string, success boolean, error_type string, seconds double, column string, rows long, nulls long, low string, high string"


def measures(df: DataFrame) -> list[Column]:
    """Rows, and for each column its nulls and, where its type has an order, its extremes as text."""
    out = [F.count(F.lit(1)).alias("rows")]
    for i, f in enumerate(df.schema.fields):
        c = df[f.name] if df.columns.count(f.name) == 1 else None
        if c is None:
            continue
        out.append(F.count_if(c.isNull()).alias(f"{i}.nulls"))
        if not isinstance(f.dataType, (ArrayType, MapType, StructType, BinaryType, VariantType)):
            out += [F.min(c).cast("string").alias(f"{i}.low"), F.max(c).cast("string").alias(f"{i}.high")]
    return out


def as_rows(columns: list[str], seen: dict, operation: str, run: str, success: bool, error: str | None, seconds: float) -> list[tuple]:
    """One row a column; a run that failed has one row without a column."""
    if not success:
        return [(operation, run, False, error, seconds, None, None, None, None, None)]
    return [(operation, run, True, None, seconds, c, seen["rows"], seen.get(f"{i}.nulls"), seen.get(f"{i}.low"), seen.get(f"{i}.high")) for i, c in enumerate(columns)]


def monitored(df: DataFrame, operation: str, action: Callable[[DataFrame], object], store: str, run: str = "") -> object:
    """Run an action on the table and append its metrics to a table at ``store``; what the action raises is recorded and raised again.

    Of columns that share a name only the rows are counted. An action that reads no row of the table (or reads it twice) has the figures of the first
    pass that ends.
    """
    spark, observed, began = df.sparkSession, Observation(), time.perf_counter()
    rows: list[tuple] = []
    try:
        result = action(df.observe(observed, *measures(df)))
        rows = as_rows(df.columns, observed.get, operation, run, True, None, time.perf_counter() - began)
        return result
    except Exception as error:
        rows = as_rows(df.columns, {}, operation, run, False, type(error).__name__, time.perf_counter() - began)
        raise
    finally:
        spark.createDataFrame(rows, METRICS).coalesce(1).write.mode("append").parquet(store)


def metrics(spark: SparkSession, store: str) -> DataFrame:
    return spark.read.schema(METRICS).parquet(store)


class StreamMetrics(StreamingQueryListener):
    """The observed figures of a stream's last batches; give the stream ``observe(name, *measures(stream))``."""

    def __init__(self, name: str, columns: list[str], most: int = 1000) -> None:
        self.name, self.columns = name, columns
        self.rows: deque[tuple] = deque(maxlen=most * max(1, len(columns)))

    def onQueryStarted(self, event) -> None:
        pass

    def onQueryProgress(self, event) -> None:
        seen = event.progress.observedMetrics.get(self.name)
        if seen is not None and seen["rows"]:
            self.rows.extend(as_rows(self.columns, seen.asDict(), self.name, str(event.progress.batchId), True, None, event.progress.batchDuration / 1000))

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryTerminated(self, event) -> None:
        if event.exception:
            self.rows.extend(as_rows(self.columns, {}, self.name, "", False, event.exception.split(":")[0], 0.0))

    def table(self, spark: SparkSession) -> DataFrame:
        return spark.createDataFrame(list(self.rows), METRICS)
