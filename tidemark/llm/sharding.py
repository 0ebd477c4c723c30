"""Sharding along a Hilbert curve over quantised metadata (operator 5, native).

Language, source and length are quantised to ``bits`` bits each by equal depth: a value's place is the share of rows
before it in the order of values, so neighbouring values share or adjoin cells, and crowded ranges get more cells
than empty ones. Length, which filters name least, takes half the range, so that the curve parts languages and sources
first. A document's cell is its place on the Hilbert curve through that grid. Documents are ordered by
(curve index, keyed hash, doc_id, size, checksum) and the order is cut into equal runs. A run covers a compact part of
the grid, so its files have narrow ranges of all three dimensions, and a filter on any of them skips most files. The
law is ``rows``: shards differ by one document at most.

No step sorts all rows. The distinct values of a dimension are range-partitioned and numbered in two levels. Equal
rows are counted first, then each cell is divided into strips of about ``strip_rows`` rows by the keyed hash; the
prefix sums run over strips, and row numbers within them. A cell with a third of all rows is just more strips, and a
value with as many is joined by broadcast.

Defined cases: a null text has size 1 and checksum 0; null lang and source come before all others, null doc_id is a
value of its own; repeated rows take consecutive places; ties in the order are equal rows; only the metadata of a long text
moves; extra columns are not read; an empty table gives an empty result; with fewer rows than shards the first
shards hold a row each, as the cut falls.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.llm.common import join_hot, small_enough, stored, unit_hash


def hilbert_index(axes: Column, bits: int, dims: int) -> Column:
    """Place on the Hilbert curve of a point given as an array of ``dims`` integers of ``bits`` bits.

    Axes become the transposed index by undoing excess work from the top bit down, then by Gray encoding.
    State lives in an array folded over a sequence, so the expression stays small.
    """
    steps = F.array(*[F.struct(F.lit(1 << b).alias("q"), F.lit(d).alias("d")) for b in range(bits - 1, 0, -1) for d in range(dims)])

    def set_at(x: Column, at: Column, value: Column, zero: Column) -> Column:
        return F.transform(x, lambda v, i: F.when(i == 0, zero).when(i == at, value).otherwise(v))

    def step(x: Column, s: Column) -> Column:
        p = s["q"] - 1
        first, own = F.get(x, F.lit(0)), F.get(x, s["d"])
        inverted = first.bitwiseXOR(p)
        swap = first.bitwiseXOR(own).bitwiseAND(p)
        return F.when(own.bitwiseAND(s["q"]) != 0, set_at(x, s["d"], own, inverted)).otherwise(set_at(x, s["d"], own.bitwiseXOR(swap), first.bitwiseXOR(swap)))

    def bound(value: Column, body) -> Column:
        """body(value) with the value computed once."""
        return F.get(F.transform(F.array(value), body), F.lit(0))

    # Gray encoding: each axis takes the exclusive or of those before it, then the last axis's excess is spread.
    encoded = F.aggregate(F.aggregate(steps, axes, step), F.array().cast("array<int>"), lambda done, v: F.concat(done, F.array(F.when(F.size(done) == 0, v).otherwise(v.bitwiseXOR(F.element_at(done, -1))))))
    powers = F.array(*[F.lit(1 << b) for b in range(bits - 1, 0, -1)])

    def transposed(e: Column) -> Column:
        spread = F.aggregate(powers, F.lit(0), lambda t, q: F.when(F.element_at(e, -1).bitwiseAND(q) != 0, t.bitwiseXOR(q - 1)).otherwise(t))
        return bound(spread, lambda t: F.transform(e, lambda v: v.bitwiseXOR(t)))

    places = F.array(*[F.struct(F.lit(b).alias("b"), F.lit(d).alias("d")) for b in range(bits - 1, -1, -1) for d in range(dims)])
    interleaved = lambda x: F.aggregate(places, F.lit(0).cast("long"), lambda h, s: h * 2 + F.when(F.get(x, s["d"]).bitwiseAND(F.call_function("shiftleft", F.lit(1), s["b"])) != 0, 1).otherwise(0))
    return bound(bound(encoded, transposed), interleaved)


def curve_table(spark: SparkSession, bits: int, dims: int) -> DataFrame:
    """Every cell of the grid with its curve index: 2 ** (bits * dims) rows, a bound set by the parameters."""
    n = 1 << bits
    axes = F.array(*[(F.floor(F.col("id") / (n**d)) % n).cast("int") for d in range(dims)])
    return spark.range(n**dims).select(F.col("id").alias("cell"), hilbert_index(axes, bits, dims).alias("curve"))


def depths(rows: DataFrame, value: str, bits: int) -> DataFrame:
    """(value, axis, n), stored: each distinct value's cell of the axis, by the share of rows before its middle row."""
    counts = stored(rows.groupBy(value).agg(F.count("*").alias("n")).repartitionByRange(value).withColumn("part", F.spark_partition_id()), "values")
    parts = counts.groupBy("part").agg(F.sum("n").alias("m"))  # a row a partition
    before = F.coalesce(F.sum("m").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    parts = parts.select("part", before.alias("before"), F.sum("m").over(Window.partitionBy()).alias("total"))
    inside = F.coalesce(F.sum("n").over(Window.partitionBy("part").orderBy(value).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    share = (F.col("before") + F.col("inside") + F.col("n") / 2) / F.col("total")
    return stored(counts.withColumn("inside", inside).join(F.broadcast(parts), "part").select(value, F.floor(share * (1 << bits)).cast("int").alias("axis"), "n"), "depths")


def on_axis(rows: DataFrame, value: str, axis: str, bits: int) -> DataFrame:
    """The rows with their cell of one axis in place of the value."""
    places = depths(rows, value, bits).withColumnRenamed("axis", axis)
    met = rows.join(F.broadcast(places.drop("n")), value) if small_enough(places, 100_000) else join_hot(rows, places, value, "n")
    return met.drop(value)


def axes(rows: DataFrame, bits: int) -> DataFrame:
    """rows(lang, source, size, ...) with ``cell``, the number of the grid cell, in place of lang and source."""
    n = 1 << bits
    # Lengths in steps of a quarter of a power of two.
    named = rows.withColumns({"_v0": F.coalesce(F.concat(F.lit("v"), "source"), F.lit("")), "_v1": F.coalesce(F.concat(F.lit("v"), "lang"), F.lit("")), "_v2": F.floor(F.log2(F.col("size").cast("double")) * 4).cast("int")}).drop("lang", "source")
    for d in range(3):  # length takes half the range
        named = on_axis(named, f"_v{d}", f"_a{d}", bits - (d == 2))
    return named.withColumn("cell", (F.col("_a0") + F.col("_a1") * n + F.col("_a2") * n * n).cast("long")).drop("_a0", "_a1", "_a2")


def hilbert_shards(rows: DataFrame, shards: int = 16, bits: int = 5, strip_rows: int = 4096, seed: str = "shard") -> DataFrame:
    """rows(doc_id, size, text_crc32, lang, source) to doc_id, size, text_crc32, curve, shard, slot."""
    spark, by = rows.sparkSession, ["curve", "strip"]
    cells = F.broadcast(curve_table(spark, bits, 3))  # a bound from the parameters: 32,768 rows at 5 bits
    narrow = stored(rows.select("doc_id", "size", "text_crc32", "lang", "source"), "metadata")
    same = axes(narrow, bits).groupBy("cell", "doc_id", "size", "text_crc32").agg(F.count("*").alias("copies"))
    same = stored(same.join(cells, "cell").select("curve", "doc_id", "size", "text_crc32", "copies", unit_hash(seed, F.col("doc_id"), F.col("size"), F.col("text_crc32")).alias("h")), "cells")
    width = F.broadcast(same.groupBy("curve").agg(F.ceil(F.count("*") / strip_rows).alias("strips")))  # at most one row a cell
    placed = same.join(width, "curve").withColumn("strip", F.floor(F.col("h") / F.lit(float(1 << 60)) * F.col("strips")).cast("long")).drop("strips")
    # One row a strip of thousands of rows: the sums over them are in two levels, by cell and within the cell.
    strips = placed.groupBy(*by).agg(F.sum("copies").alias("n"))
    sums = strips.groupBy("curve").agg(F.sum("n").alias("n"))  # at most one row a cell
    before = sums.withColumn("before", F.coalesce(F.sum("n").over(Window.orderBy("curve").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).withColumn("total", F.sum("n").over(Window.partitionBy())).drop("n")
    inside = F.coalesce(F.sum("n").over(Window.partitionBy("curve").orderBy("strip").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = strips.withColumn("within", inside).join(F.broadcast(before), "curve").select(*by, (F.col("before") + F.col("within")).alias("start"), "total")
    order = Window.partitionBy(*by).orderBy("h", "doc_id", "size", "text_crc32")
    first = F.coalesce(F.sum("copies").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    ranked = placed.withColumn("first", first).join(starts, by).withColumn("copy", F.explode(F.sequence(F.lit(0).cast("long"), F.col("copies") - 1)))
    place = F.col("start") + F.col("first") + F.col("copy")
    ranked = ranked.withColumn("place", place.cast("long")).withColumn("shard", F.expr(f"cast((place * {shards}L) div total as int)"))
    return ranked.select("doc_id", "size", "text_crc32", "curve", "shard", (F.col("place") - F.expr(f"(shard * total + {shards - 1}L) div {shards}L")).alias("slot"))


def document_sizes(docs: DataFrame) -> DataFrame:
    """The metadata that sharding needs, without the texts."""
    text = F.col("text")
    return docs.select("doc_id", (F.coalesce(F.octet_length(text), F.lit(0)) + 1).cast("long").alias("size"), F.coalesce(F.crc32(text.cast("binary")), F.lit(0)).cast("long").alias("text_crc32"), "lang", "source")


def write_shards(docs: DataFrame, path: str, shards: int = 16) -> None:
    """Write the documents as Parquet, one folder a shard, each in curve order.

    The places are joined back by (doc_id, size, checksum), of which equal rows share a run of slots.
    """
    key = ["doc_id", "size", "text_crc32"]
    places = hilbert_shards(document_sizes(docs), shards).groupBy(*key).agg(F.min("shard").alias("shard"), F.min("slot").alias("slot"))
    sized = docs.withColumns({"size": (F.coalesce(F.octet_length("text"), F.lit(0)) + 1).cast("long"), "text_crc32": F.coalesce(F.crc32(F.col("text").cast("binary")), F.lit(0)).cast("long")})
    joined = sized.alias("d").join(places.alias("p"), [F.col(f"d.{k}").eqNullSafe(F.col(f"p.{k}")) for k in key])
    joined.select("d.*", "p.shard", "p.slot").repartitionByRange(shards, "shard", "slot").sortWithinPartitions("shard", "slot").drop("slot", "size", "text_crc32").write.partitionBy("shard").parquet(path)


def shard_report(docs: DataFrame, shards: int = 16) -> DataFrame:
    """One row a document: doc_id, size, text_crc32, law, shard, slot, grown_shard and the curve index."""
    return hilbert_shards(document_sizes(docs), shards).select(
        "doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), "curve"
    )
