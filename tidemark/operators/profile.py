"""Profile of all columns of a table in one pass: kinds of values, statistics, mergeable distinct counts, contained columns."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import NumericType

#: What a text column's values are tried for, the narrowest kind first.
KINDS = {"boolean": r"^(true|false)$", "integer": r"^[+-]?[0-9]+$", "number": r"^[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?$", "date": r"^[0-9]{4}-[0-9]{2}-[0-9]{2}$"}
#: The sketch holds 2^12 registers: a standard error of about 1.04 / 64.
LG_K, STANDARD_ERROR = 12, 1.04 / 64
PROFILE = ["column", "type", "kind", "rows", "nulls", "shortest", "longest", "low", "high", "mean", "deviation"]


def _of(c: str, i: int) -> Column:
    return F.col("s").getField(f"{i}.{c}")


def _measures(df: DataFrame, sketches: bool) -> list[Column]:
    out: list[Column] = [F.count(F.lit(1)).alias("rows")]
    for i, f in enumerate(df.schema.fields):
        c, text = F.col(f"`{f.name}`"), F.col(f"`{f.name}`").cast("string")
        number = c.cast("double") if isinstance(f.dataType, NumericType) else F.expr(f"try_cast(CASE WHEN CAST(`{f.name}` AS string) RLIKE '{KINDS['number']}' THEN CAST(`{f.name}` AS string) END AS double)")
        own = {"n": F.count(c), "shortest": F.min(F.length(text)), "longest": F.max(F.length(text)), "low": F.min(text), "high": F.max(text), "least": F.min(number), "most": F.max(number), "mean": F.avg(number), "deviation": F.stddev_pop(number)}
        own |= {k: F.count_if(F.lower(text).rlike(p)) for k, p in KINDS.items()}
        if sketches:
            own["sketch"] = F.hll_sketch_agg(text, F.lit(LG_K))
        out += [v.alias(f"{i}.{k}") for k, v in own.items()]
    return out


def profile(df: DataFrame, sketches: bool = False) -> DataFrame:
    """One row a column: type, kind of its values, rows, nulls, lengths, extremes, mean and deviation, and on demand a distinct-count sketch.

    ``kind`` is the narrowest of boolean, integer, number and date that all values have as text, else text; ``empty`` without a value. Extremes of integers
    and numbers go by value and come as numbers' text, others by text. All is one aggregation, combined in the tasks; sketches of parts of a table can be united. Columns of nested
    types have to be left out by the caller; an empty table gives a row a column with no values.
    """
    one = df.agg(F.struct(*_measures(df, sketches)).alias("s"))
    rows = []
    for i, f in enumerate(df.schema.fields):
        n = _of("n", i)
        kind = reduce(lambda found, k: F.when(_of(k, i) == n, F.lit(k)).otherwise(found), reversed(list(KINDS)), F.lit("text"))
        kind = F.when(n == 0, F.lit("empty")).otherwise(kind)
        numeric = kind.isin("integer", "number")
        own = [F.lit(f.name).alias("column"), F.lit(f.dataType.simpleString()).alias("type"), kind.alias("kind"), F.col("s.rows").alias("rows"), (F.col("s.rows") - n).alias("nulls"), _of("shortest", i).alias("shortest"), _of("longest", i).alias("longest")]
        own += [F.when(numeric, F.col("s").getField(f"{i}.{a}").cast("string")).otherwise(_of(b, i)).alias(b) for a, b in (("least", "low"), ("most", "high"))]
        own += [F.when(numeric, _of(c, i)).alias(c) for c in ("mean", "deviation")]
        if sketches:
            own.append(_of("sketch", i).alias("sketch"))
        rows.append(F.struct(*own))
    return one.select(F.explode(F.array(*rows)).alias("r")).select("r.*")


def distinct_counts(profiled: DataFrame) -> DataFrame:
    """column and the estimated number of its distinct values, from a profile's sketches."""
    return profiled.select("column", F.coalesce(F.hll_sketch_estimate("sketch"), F.lit(0)).alias("distinct"))


def united(profiles: DataFrame) -> DataFrame:
    """Distinct values of each column over several profiles' tables, from the union of their sketches."""
    return profiles.groupBy("column").agg(F.hll_sketch_estimate(F.hll_union_agg("sketch")).alias("distinct"))


def contained(profiled: DataFrame, slack: float = 3 * STANDARD_ERROR) -> DataFrame:
    """Pairs of columns whose values may lie within another column's: the union of both sketches counts no more than the larger.

    A candidate by sketches, within their error; as many pairs as the table has columns, squared.
    """
    a = profiled.filter("rows > nulls").select(F.col("column").alias("inner"), F.col("kind"), F.col("sketch").alias("x"))
    b = profiled.filter("rows > nulls").select(F.col("column").alias("outer"), F.col("kind"), F.col("sketch").alias("y"))
    outer, both = F.hll_sketch_estimate("y"), F.hll_sketch_estimate(F.hll_union("x", "y"))
    return a.join(b, "kind").filter("inner <> outer").filter(both <= outer * (1 + slack)).select("inner", "outer", F.hll_sketch_estimate("x").alias("inner_values"), outer.alias("outer_values"))
