"""Sinks: metrics as Prometheus text, delimited and JSON lines; alerts as daily JSON lines; dead letters; Markdown."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def prometheus(metrics: DataFrame) -> DataFrame:
    """metrics(category, name, value) as gauge lines; rows without a number are left out."""
    name = F.regexp_replace(F.lower(F.concat_ws("_", "category", "name")), "[.-]", "_")
    return metrics.filter("value IS NOT NULL").select(F.explode(F.array(F.concat(F.lit("# TYPE "), name, F.lit(" gauge")), F.concat(name, F.lit(" "), F.col("value").cast("string")))).alias("line"))


def csv_lines(df: DataFrame) -> DataFrame:
    """A row as one delimited line; fields with a comma, quote or line end are quoted."""

    def field(c: str) -> Column:
        text = F.coalesce(F.col(c).cast("string"), F.lit(""))
        return F.when(text.rlike('[",\n]'), F.concat(F.lit('"'), F.replace(text, F.lit('"'), F.lit('""')), F.lit('"'))).otherwise(text)

    return df.select(F.array_join(F.array(*[field(c) for c in df.columns]), ",").alias("line"))


def json_lines(df: DataFrame) -> DataFrame:
    """A row as one JSON line."""
    return df.select(F.to_json(F.struct(*df.columns)).alias("line"))


def markdown_rows(df: DataFrame) -> DataFrame:
    """A row as a line of a Markdown table."""
    return df.select(F.concat(F.lit("| "), F.array_join(F.array(*[F.coalesce(F.replace(F.col(c).cast("string"), F.lit("|"), F.lit("\\|")), F.lit("")) for c in df.columns]), " | "), F.lit(" |")).alias("line"))


def write_daily(df: DataFrame, path: str, ts: str = "ts") -> None:
    """Append rows as JSON lines, one folder a day."""
    df.withColumn("day", F.to_date(ts)).write.mode("append").partitionBy("day").json(path)


def redacted(df: DataFrame, secret: tuple[str, ...] = ("password", "api_key")) -> DataFrame:
    """Request rows with secrets masked in their JSON column ``data``."""
    out = F.col("data")
    for name in secret:
        out = F.regexp_replace(out, rf'("{name}"\s*:\s*)"[^"]*"', '$1"***"')
    return df.withColumn("data", out)


def dead_letters(df: DataFrame, error: str) -> DataFrame:
    """Failed documents with the error, no retries yet, and an id that depends on both."""
    return df.withColumn("error", F.lit(error)).withColumn("retries", F.lit(0)).withColumn("entry", F.sha2(F.concat_ws("|", F.lit(error), *[F.col(c).cast("string") for c in df.columns]), 256))
