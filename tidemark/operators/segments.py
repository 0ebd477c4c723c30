"""Results of several engines over the segments of a page made one: assignment by capability and load, boxes on the page, reading order.

Engines are a small table (engine, place, takes, most): ``takes`` lists the kinds of segments that an engine is able to read, ``most`` how many of
a kind it takes on a page (null: all). Engines come in order of their place.

What the engines read comes as rows, or within the segments' own rows, as a column ``reads``; then nothing has to be joined.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.session import shared_dir

#: What an engine of a speciality reads.
TAKES = {"table_extraction": ("table",), "formula_recognition": ("formula",), "general": ("text", "title", "paragraph", "caption", "header", "footer")}


def assigned(segments: DataFrame, engines: DataFrame) -> DataFrame:
    """Segments (page, segment, kind, x1, y1, x2, y2) with their engine.

    The segments of a kind are counted down a page; the first engine that is able takes as many as its load allows, the next the following, and so
    on. A segment that none takes has a null engine; a page of such segments alone goes whole to the first engine. Segments that lie by page stay where they are.
    """
    loads = engines.select("engine", "place", F.explode("takes").alias("kind"), F.coalesce(F.col("most").cast("long"), F.lit(1 << 40)).alias("most"))
    upto = F.sum("most").over(Window.partitionBy("kind").orderBy("place").rowsBetween(Window.unboundedPreceding, 0))
    spans = F.broadcast(loads.select("engine", "place", F.col("kind").alias("kind_"), (upto - F.col("most")).alias("low"), upto.alias("high")))
    down = F.row_number().over(Window.partitionBy("page", "kind").orderBy("y1", "x1", "segment"))
    placed = segments.withColumn("n_", down).join(spans, (F.col("kind") == F.col("kind_")) & (F.col("n_") > F.col("low")) & (F.col("n_") <= F.col("high")), "left")
    any_taken = F.max(F.col("engine").isNotNull()).over(Window.partitionBy("page"))
    first = engines.agg(F.min_by("engine", "place").alias("e"), F.min("place").alias("p")).first()
    return placed.withColumn("whole", ~any_taken).select(
        *segments.columns, F.when(F.col("whole"), F.lit(first["e"])).otherwise(F.col("engine")).alias("engine"), F.when(F.col("whole"), F.lit(first["p"])).otherwise(F.col("place")).alias("place"), "whole"
    )


def on_page(placed: DataFrame, results: DataFrame | None = None) -> DataFrame:
    """Blocks (page, segment, engine, block, bx1, by1, bx2, by2, text, confidence) of the engines that segments went to, moved from their segment's corner to the page's.

    Without ``results`` the segments hold them: ``reads``, an array of structs (engine, block, ...) of all engines' blocks.
    """
    own = placed.filter("engine IS NOT NULL").withColumns({"dx": F.when(F.col("whole"), 0).otherwise(F.col("x1")), "dy": F.when(F.col("whole"), 0).otherwise(F.col("y1"))})
    keys = ["page", "segment", "kind", "engine", "place", "dx", "dy"]
    if results is None:
        met = own.select(*keys, F.explode(F.filter("reads", lambda r: r["engine"] == F.col("engine"))).alias("r")).select(*keys, *[f"r.{c}" for c in ("block", "bx1", "by1", "bx2", "by2", "text", "confidence")])
    else:
        met = results.join(own.select(*keys), ["page", "segment", "engine"])
    moved = {f"x{i}": F.col(f"bx{i}") + F.col("dx") for i in (1, 2)} | {f"y{i}": F.col(f"by{i}") + F.col("dy") for i in (1, 2)}
    return met.select("page", "segment", "kind", "engine", "place", "block", *[v.alias(k) for k, v in moved.items()], "text", "confidence")


def reading_order(blocks: DataFrame, height: float | None = None, most: int = 50_000) -> DataFrame:
    """Blocks with their place on the page, from 1: from top to bottom; within a band of ``height`` (bands begin at the page's top) from left to right.

    Blocks are stored once. A page is one window; on pages of more than ``most`` blocks places are counted in two levels, in bands and before
    them, so a long page is many tasks' work.
    """
    band: Column = F.floor(F.col("y1") / height) if height else F.floor("y1")
    order = ["x1", "y1"] if height else ["y1"]
    ties = ["place", "segment", "block"]
    path = f"{shared_dir(blocks.sparkSession)}/blocks-{uuid.uuid4().hex}"
    blocks.withColumn("band_", band).filter("page IS NOT NULL AND band_ IS NOT NULL").write.parquet(path)
    banded = blocks.sparkSession.read.parquet(path)
    long = [r["page"] for r in banded.groupBy("page").count().filter(F.col("count") > most).select("page").collect()]  # a page for ``most`` rows, at most
    inside = lambda *by: F.row_number().over(Window.partitionBy("page", *by).orderBy("band_", *order, *ties))
    if not long:
        return banded.withColumn("position", inside().cast("long")).drop("band_")
    known = F.broadcast(blocks.sparkSession.createDataFrame([(p,) for p in long], banded.select("page").schema))
    short, rest = banded.join(known, "page", "left_anti"), banded.join(known, "page", "left_semi")
    before = F.sum("n_").over(Window.partitionBy("page").orderBy("band_")) - F.col("n_")
    bands = rest.groupBy("page", "band_").agg(F.count("*").alias("n_")).select("page", "band_", before.alias("before_"))
    counted = rest.withColumn("inside_", inside("band_")).join(bands, ["page", "band_"]).withColumn("position", F.col("before_") + F.col("inside_")).drop("inside_", "before_")
    return short.withColumn("position", inside().cast("long")).unionByName(counted).drop("band_")


def pages(placed: DataFrame, results: DataFrame | None = None) -> DataFrame:
    """One row a page: its segments read, engines used in their order, mean confidence of the segments' results, 0 without any."""
    per = on_page(placed, results).groupBy("page", "segment", "engine", "place").agg(F.avg("confidence").alias("c"))
    used = F.array_join(F.transform(F.array_sort(F.collect_set(F.struct("place", "engine"))), lambda e: e["engine"]), ",")  # as many as engines
    got = per.groupBy("page").agg(F.count("*").alias("segments"), used.alias("engines"), F.round(F.avg("c"), 6).alias("confidence"))
    return placed.select("page").distinct().join(got, "page", "left").na.fill({"segments": 0, "engines": "", "confidence": 0.0})
