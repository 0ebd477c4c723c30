"""Work on a stream that may fail on a row: results to one sink, error records to another, replay of what failed.

An error does not end the stream: its row goes to the error sink with the kind of the error and its message. Each micro-batch writes both
sinks under its number, so a batch that is repeated after a failure between the two overwrites what it had written. Where a batch
has more errors than allowed, it is written to both sinks first, and then the stream fails, so no error is lost with it.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DataType, StringType, StructField, StructType, _parse_datatype_string


class TooManyErrors(RuntimeError):
    """A batch had more errors than allowed; both sinks hold its rows."""


def attempt(work: Callable, column: Column | str, kind: str | DataType) -> Column:
    """A struct of the work's result and, where it raised, error_type and message; a null value is not worked on."""
    result = _parse_datatype_string(kind) if isinstance(kind, str) else kind
    schema = StructType([StructField("result", result), StructField("error_type", StringType()), StructField("message", StringType())])

    @F.pandas_udf(schema)
    def tried(values: pd.Series) -> pd.DataFrame:
        rows = []
        for value in values:
            try:
                rows.append((None if value is None else work(value), None, None))
            except Exception as error:  # noqa: BLE001 whatever the work raises is what is asked for
                rows.append((None, type(error).__name__, str(error)))
        return pd.DataFrame(rows, columns=["result", "error_type", "message"]).astype(object)

    return tried(column)


def two_sinks(stream: DataFrame, tried: str, good: str, bad: str, done: str, most_errors: int | None = None, between: Callable[[int], None] | None = None) -> None:
    """Run a stream with a column from ``attempt`` over all that is there. ``between`` is called between the two writes, for tests of failures.

    A row is worked on once: it goes to the shared folder as an intermediate of its batch, and both sinks are read from there.
    """

    def sink(batch: DataFrame, number: int) -> None:
        staged = f"{good}-staged/batch={number}"
        batch.write.mode("overwrite").parquet(staged)
        rows = batch.sparkSession.read.schema(batch.schema).parquet(staged)
        plain = [c for c in rows.columns if c != tried]
        rows.filter(F.col(f"{tried}.error_type").isNull()).select(*plain, f"{tried}.result").write.mode("overwrite").parquet(f"{good}/batch={number}")
        if between:
            between(number)
        errors = rows.filter(F.col(f"{tried}.error_type").isNotNull()).select(*plain, f"{tried}.error_type", f"{tried}.message", F.lit(0).alias("retries"))
        errors.write.mode("overwrite").parquet(f"{bad}/batch={number}")
        at = batch.sparkSession._jvm.org.apache.hadoop.fs.Path(staged)
        at.getFileSystem(batch.sparkSession._jsc.hadoopConfiguration()).delete(at, True)
        if most_errors is not None and batch.sparkSession.read.schema(errors.schema).parquet(f"{bad}/batch={number}").count() > most_errors:
            raise TooManyErrors(f"batch {number} has more than {most_errors} errors")

    stream.writeStream.option("checkpointLocation", done).foreachBatch(sink).trigger(availableNow=True).start().awaitTermination()


def replayed(letters: DataFrame, work: Callable, column: str, kind: str, most: int = 3) -> DataFrame:
    """Dead letters after another try: state (processed, failed, or remaining once their tries are spent), retries, result and the newest error."""
    spent = F.col("retries") >= most
    tried = letters.withColumn("_t", attempt(work, F.when(~spent, F.col(column)), kind))
    failed = F.col("_t.error_type").isNotNull()
    return tried.select(
        *[c for c in letters.columns if c not in ("retries", "error_type", "message")],
        F.when(spent, "remaining").when(failed, "failed").otherwise("processed").alias("state"),
        F.when(spent, F.col("retries")).otherwise(F.col("retries") + 1).alias("retries"),
        F.col("_t.result").alias("result"),
        F.when(spent, F.col("error_type")).when(failed, F.col("_t.error_type")).alias("error_type"),
        F.when(spent, F.col("message")).when(failed, F.col("_t.message")).alias("message"),
    )


def error_counts(errors: DataFrame) -> Iterator[tuple[str, int]]:
    """Errors by kind; as many rows as kinds."""
    return ((r["error_type"], r["n"]) for r in errors.groupBy("error_type").agg(F.count("*").alias("n")).orderBy("error_type").toLocalIterator())
