"""A stored vector index of inverted lists, and exact search in it that says which cells it read.

``build`` fits centroids on a bounded sample and writes every row into a table partitioned by its cell; large cells are split into
blocks. ``search`` reads, for each query, cells in the order of the least distance that they can hold, in rounds: after each the query's k-th
best score leaves out all cells that cannot hold a better row. A round reads only the folders of the cells that some query asks for, and holds
each block once, or small cells together, while those queries pass by, once each with the cells that they ask for. With ``probes`` a query stops after so many cells, and results may be incomplete.

Defined cases: rows without an id, without a vector, or with a null or non-finite component are not indexed and ask nothing; a zero vector has
cosine 0 with all; ties go to the smaller id; repeated rows are found as often as they are there; a query's own id is never among its results; an empty
table gives an empty index and empty results.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.operators.cells import SLACK, cores, distances, fit, in_cells, passing_by, portions, units, usable
from tidemark.operators.vectors import FOUND, Rows, best_of, ranked
from tidemark.session import shared_dir


@dataclass
class Index:
    """Where an index lies, and its cells: centroid, rows, blocks and radius of each. As many numbers as the cells, a parameter, have components."""

    path: str
    centroids: np.ndarray
    sizes: np.ndarray
    blocks: np.ndarray
    radius: np.ndarray

    def rows(self, spark: SparkSession, cells: list[int]) -> DataFrame:
        """The rows of some cells; other cells' folders are not read."""
        table = spark.read.schema("vec_id long, embedding array<double>, block int, cell int").parquet(f"{self.path}/rows")
        return table.filter(F.col("cell").isin(cells))


def build(vectors: DataFrame, path: str, cells: int | None = None, block: int = 4096, sample: int = 100_000, seed: int = 7) -> Index:
    """Index every row at a path; ``cells`` is about the square root of the number of rows, at most 4,096, unless given."""
    spark, n = vectors.sparkSession, usable(vectors).count()
    cells = cells or min(4096, max(1, round(n**0.5)))
    centroids = fit(vectors, cells, sample, seed=seed)
    in_cells(vectors, centroids).write.parquet(f"{path}/assigned")
    assigned = spark.read.parquet(f"{path}/assigned")
    sizes = assigned.groupBy("cell").agg(F.count("*").alias("n"), F.max("far").alias("radius")).withColumn("blocks", F.ceil(F.col("n") / block).cast("int"))
    sizes.write.parquet(f"{path}/sizes")
    # A cell's folder has a file for each of its blocks, so no file is small by the number of tasks.
    dealt = assigned.join(F.broadcast(spark.read.parquet(f"{path}/sizes").select("cell", "blocks")), "cell").withColumn("block", F.pmod(F.xxhash64("vec_id", "embedding"), F.col("blocks")).cast("int"))
    dealt.select("vec_id", "embedding", "block", "cell").repartition("cell", "block").write.partitionBy("cell").parquet(f"{path}/rows")
    spark.createDataFrame([(i, c.tolist()) for i, c in enumerate(centroids)], "cell int, centroid array<double>").coalesce(1).write.parquet(f"{path}/centroids")
    at = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/assigned")
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)
    return load(spark, path)


def load(spark: SparkSession, path: str) -> Index:
    """Open an index; a row a cell reaches the driver."""
    centroids = np.stack([r["centroid"] for r in spark.read.parquet(f"{path}/centroids").orderBy("cell").collect()])
    sizes, blocks, radius = np.zeros(len(centroids), np.int64), np.zeros(len(centroids), np.int64), np.full(len(centroids), -1.0)
    for r in spark.read.parquet(f"{path}/sizes").collect():
        sizes[r["cell"]], blocks[r["cell"]], radius[r["cell"]] = r["n"], r["blocks"], r["radius"]
    return Index(path, centroids, sizes, blocks, radius)


def next_cells(index: Index, k: int, round_: int, probes: int | None):
    """For a query with its k-th best score and the number of cells read, the cells of the next round.

    All cells have one order for a query, by the least distance that they can hold and then by that of their centroids, so a number says which
    were read. A round reads as many cells as all before it, at least enough for k rows, and none whose least distance is beyond the k-th best.
    """

    def task(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        full = np.flatnonzero(index.sizes > 0)
        for batch in (part for rows in batches for part in portions(rows, len(full))):
            far = distances(units(batch.embedding), index.centroids[full])
            least = np.maximum(far - index.radius[full][None, :] - SLACK, 0)
            out = []
            for i, (read, worst) in enumerate(zip(batch.read, batch.worst, strict=True)):
                order = np.lexsort((far[i], least[i]))
                # A rounded cosine is at most 1e-6 from the true one; a zero query, or row, is as near as any by its cosine of 0.
                limit = np.inf if np.isnan(worst) or worst <= 1e-6 else np.sqrt(max(0.0, 2 - 2 * (worst - 1e-6)))
                able = int((least[i] <= limit).sum())
                enough = int(np.searchsorted(np.cumsum(index.sizes[full][order]), k + 1)) + 1
                upto = min(max(2 * read, enough), able, probes if probes is not None else len(order))
                out.append(full[order[read:upto]].tolist())
            yield batch.assign(cells=out)[["query_id", "embedding", "read", "worst", "cells"]]

    return task


#: Small cells share a task until they have so many rows together.
TASK = 4096


def places(index: Index, wanted: list[int], parts: int) -> np.ndarray:
    """For each cell its first task, -1 if it is not wanted: a block each of a large cell, and small cells together, in ``parts`` tasks at least if rows allow."""
    full = min(TASK, max(1, int(index.sizes[wanted].sum()) // max(1, parts)))
    first, task, room = np.full(len(index.sizes), -1, dtype=np.int64), -1, 0
    for c in sorted(wanted):
        n, blocks = int(index.sizes[c]), int(index.blocks[c])
        if blocks > 1 or n > room:
            task, room = task + 1, full
        first[c], room = task, room - n
        if blocks > 1:
            task, room = task + blocks - 1, 0
    return first


def visits(index: Index, first: np.ndarray):
    """A query's rows for the tasks that hold cells of its plan, each with those cells."""

    tasks = len(np.unique(first))

    def task(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in (part for rows in batches for part in portions(rows, 64 * tasks)):
            out = []
            for i, cells in enumerate(batch.cells):
                cells = np.sort(np.asarray(cells, dtype=np.int64))
                at, starts = np.unique(first[cells], return_index=True)
                for t, own in zip(at.tolist(), np.split(cells, starts[1:]), strict=True):
                    out += [(i, t + b, own) for b in range(int(index.blocks[own].max()))]
            rows = [i for i, _, _ in out]
            yield pd.DataFrame({"task": [t for _, t, _ in out], "vec_id": batch.query_id.to_numpy()[rows], "embedding": batch.embedding.to_numpy()[rows], "cells": [c for _, _, c in out], "worst": batch.worst.to_numpy()[rows]})

    return task


class Cells(Rows):
    """A task's rows with their cells."""

    def __init__(self, rows: pd.DataFrame) -> None:
        super().__init__(rows)
        self.cells, self.at = np.unique(rows.cell.to_numpy(dtype=np.int64), return_inverse=True)


def _asked_for(block: Cells, asked: pd.DataFrame, score: np.ndarray) -> None:
    """Rows of cells that a query has not planned, or that are below its k-th best, do not count."""
    wanted = np.zeros((len(asked), len(block.cells)), dtype=bool)
    own = np.concatenate(asked.cells.to_list()).astype(np.int64)
    rows = np.repeat(np.arange(len(asked)), asked.cells.map(len).to_numpy())
    at = np.minimum(np.searchsorted(block.cells, own), len(block.cells) - 1)
    here = block.cells[at] == own
    wanted[rows[here], at[here]] = True
    score[~wanted[:, block.at]] = -np.inf
    score[score < asked.worst.fillna(-np.inf).to_numpy(dtype=float)[:, None]] = -np.inf


def search(spark: SparkSession, index: Index, queries: DataFrame, k: int, probes: int | None = None) -> tuple[DataFrame, DataFrame]:
    """(query_id, vec_id, score, rank) of the k nearest rows of each query (vec_id, embedding), and (query_id, cells, rows) that it read.

    Each round is written to the shared folder; a query without cells left is done.
    """
    folder = f"{shared_dir(spark)}/search-{uuid.uuid4().hex}"
    asked = usable(queries).select(F.col("vec_id").alias("query_id"), "embedding").withColumns({"read": F.lit(0), "worst": F.lit(None).cast("double")})
    best = spark.createDataFrame([], "query_id long, vec_id long, score double, rank int")
    probed = spark.createDataFrame([], "query_id long, cell int")
    round_ = 0
    while index.sizes.sum():
        round_ += 1
        planned = asked.mapInPandas(next_cells(index, k, round_, probes), "query_id long, embedding array<double>, read int, worst double, cells array<int>")
        planned.filter(F.size("cells") > 0).write.parquet(f"{folder}/plan-{round_}")
        plan = spark.read.parquet(f"{folder}/plan-{round_}")
        met = plan.select("query_id", F.explode("cells").alias("cell"))
        wanted = [r["cell"] for r in met.select("cell").distinct().collect()]  # at most as many as cells
        if not wanted:
            break
        first = places(index, wanted, cores(spark))
        known = F.broadcast(spark.createDataFrame([(c, int(first[c])) for c in wanted], "cell int, first int"))
        held = index.rows(spark, wanted).join(known, "cell").select((F.col("first") + F.col("block")).alias("task"), "vec_id", "embedding", "cell")
        come = plan.select("query_id", "embedding", "worst", "cells").mapInPandas(visits(index, first), "task int, vec_id long, embedding array<double>, cells array<int>, worst double")
        tasks = int(min(max(cores(spark), max(first[c] + index.blocks[c] for c in wanted)), 10_000))
        found = passing_by(held, come, tasks, Cells, best_of(k, _asked_for), FOUND)
        ranked(best.drop("rank").unionByName(found), k).write.parquet(f"{folder}/best-{round_}")
        best = spark.read.parquet(f"{folder}/best-{round_}")
        probed = probed.unionByName(met)
        worst = best.filter(F.col("rank") == k).select("query_id", F.col("score").alias("worst"))
        # A query that is done in a round is not planned again: no cell that was left out can come back.
        asked = plan.select("query_id", "embedding", (F.col("read") + F.size("cells")).alias("read")).join(worst, "query_id", "left")
    counts = F.broadcast(spark.createDataFrame([(i, int(n)) for i, n in enumerate(index.sizes)], "cell int, n long"))
    return best, probed.join(counts, "cell").groupBy("query_id").agg(F.count("*").alias("cells"), F.sum("n").alias("rows"))
