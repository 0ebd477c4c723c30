"""Vectors in cells: centroids from a bounded sample, the nearest cell of each vector, cells' radii, and bounds between them.

All vectors are made unit vectors; the distance of two is sqrt(2 - 2 cosine). By the triangle inequality no vector of a cell is
nearer to a query than the query's distance to the centroid less the cell's radius, and no pair of two cells nearer than their centroids less both radii.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Distances are doubles: bounds give way by so much.
SLACK = 1e-7
#: A matrix of scores or distances in a task has about so many numbers, whatever the rows of a batch.
SCORES = 1 << 20
#: Results leave a task from so many rows on.
TOGETHER = 10_000


def usable(vectors: DataFrame, *others: str) -> DataFrame:
    """vec_id, embedding (and other columns) of rows with an id and a vector of finite components."""
    finite = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x.cast("double")) & (F.abs(x.cast("double")) < float("inf")))
    return vectors.select("vec_id", F.col("embedding").cast("array<double>").alias("embedding"), *others).filter("vec_id IS NOT NULL AND embedding IS NOT NULL").filter(finite)


def units(column: pd.Series) -> np.ndarray:
    """A column of vectors as rows of unit length; a zero vector stays zero."""
    x = np.stack(column.to_numpy()).astype(np.float64)
    norm = np.sqrt((x * x).sum(1, keepdims=True))
    return np.divide(x, norm, out=np.zeros_like(x), where=norm > 0)


def fit(vectors: DataFrame, cells: int, sample: int = 100_000, rounds: int = 8, seed: int = 7) -> np.ndarray:
    """Centroids by k-means over a sample of at most about ``sample`` rows, chosen by a hash of their ids. ``cells`` vectors reach the driver, at most."""
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.feature import Normalizer
    from pyspark.ml.functions import array_to_vector

    rows = usable(vectors)
    n = rows.count()
    if not n:
        return np.zeros((1, 1))
    if cells <= 1:
        return np.array([rows.select("embedding").first()["embedding"]])
    share = min(1.0, sample / n)
    chosen = rows.filter(F.pmod(F.xxhash64(F.lit(seed), "vec_id", "embedding"), F.lit(1_000_000)) < max(1, round(share * 1_000_000)))
    unit = Normalizer(inputCol="vector", outputCol="features").transform(chosen.select(array_to_vector("embedding").alias("vector"))).select("features")
    model = KMeans(k=cells, maxIter=rounds, seed=seed).fit(unit.persist())
    unit.unpersist()
    return np.stack(model.clusterCenters())


def portions(rows: pd.DataFrame, wide: int) -> Iterator[pd.DataFrame]:
    """A batch's rows, so many at a time that a matrix with ``wide`` numbers for each of them is bounded."""
    step = max(1, SCORES // max(1, wide))
    for at in range(0, len(rows), step):
        yield rows.iloc[at : at + step]


def distances(unit: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    return np.sqrt(np.maximum((unit * unit).sum(1)[:, None] - 2 * unit @ centroids.T + (centroids * centroids).sum(1)[None, :], 0))


def in_cells(vectors: DataFrame, centroids: np.ndarray, *others: str) -> DataFrame:
    """vec_id, embedding, other columns, cell and distance to its centroid."""
    rows = usable(vectors, *others)
    schema = ", ".join(f"{c} {t}" for c, t in rows.dtypes) + ", cell int, far double"

    def task(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for part in portions(batch, len(centroids)):
                d = distances(units(part.embedding), centroids)
                yield part.assign(cell=d.argmin(1).astype("int32"), far=d.min(1))

    return rows.mapInPandas(task, schema)


def passing_by(rows: DataFrame, visitors: DataFrame, tasks: int, prepare: Callable, compare: Callable, schema: str) -> DataFrame:
    """Rows and visitors of a column ``task``: each task's rows are held once, prepared, and its visitors pass by batch by batch.

    Memory is one task's rows and a batch of visitors, whatever their number; ``compare(prepared, visitors)`` gives frames of the schema, and makes
    no more of a batch at a time than is bounded (``portions``).
    """
    columns = sorted(set(rows.columns) | set(visitors.columns))
    both = rows.withColumn("visits", F.lit(False)).unionByName(visitors.withColumn("visits", F.lit(True)), allowMissingColumns=True).select("visits", *columns)

    def compared(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        at, held, ready = None, [], None
        for batch in batches:
            if not len(batch):
                continue
            key, visits = batch.task.to_numpy(), batch.visits.to_numpy(dtype=bool)
            cuts = (np.flatnonzero((key[1:] != key[:-1]) | (visits[1:] != visits[:-1])) + 1).tolist()
            for low, high in zip([0, *cuts], [*cuts, len(batch)], strict=True):
                if key[low] != at:
                    at, held, ready = key[low], [], None
                if not visits[low]:
                    held.append(batch.iloc[low:high])
                elif held or ready is not None:
                    if ready is None:
                        ready, held = prepare(pd.concat(held)), []
                    yield from compare(ready, batch.iloc[low:high])

    def task(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        # Tasks may be many and small: their frames leave together.
        out, n = [], 0
        for frame in compared(batches):
            out.append(frame)
            n += len(frame)
            if n >= TOGETHER or len(out) >= 1000:
                yield pd.concat(out)
                out, n = [], 0
        if out:
            yield pd.concat(out)

    return both.repartition(max(1, tasks), "task").sortWithinPartitions("task", "visits").mapInPandas(task, schema)


def cores(spark: SparkSession) -> int:
    return max(1, spark.sparkContext.defaultParallelism)
