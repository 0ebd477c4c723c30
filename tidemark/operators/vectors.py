"""Vector operators: cosine, top-k, similarity joins by label blocks, late interaction, fusion.

Arithmetic is in double. A search brings a stated set of queries to all blocks of rows, which are dealt once; the similarity join
brings rows to the blocks of all cells that are near enough.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from functools import cached_property

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.operators.cells import SCORES, SLACK, cores, fit, in_cells, passing_by, portions, usable
from tidemark.session import shared_dir


def dot(a: Column | str, b: Column | str) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column | str) -> Column:
    return F.sqrt(F.aggregate(F.transform(a, lambda x: x.cast("double") * x.cast("double")), F.lit(0.0), lambda s, x: s + x))


def cosine(a: Column | str, b: Column | str) -> Column:
    """Cosine, 0 for a null or zero vector."""
    return F.coalesce(dot(a, b) / F.nullif(norm(a) * norm(b), F.lit(0.0)), F.lit(0.0))


FOUND = "query_id long, vec_id long, score double"
#: A block of the similarity join has at most about so many components.
COMPONENTS = 1 << 19
#: So many blocks' group passes by a task's block.
PASSING = 8


class Rows:
    """A block's rows as a matrix with norms."""

    def __init__(self, rows: pd.DataFrame) -> None:
        self.ids, self.x = rows.vec_id.to_numpy(dtype=np.int64), np.stack(rows.embedding.to_numpy()).astype(np.float64)
        self.norm = np.sqrt((self.x * self.x).sum(1))
        self.label = rows.label.to_numpy() if "label" in rows else None

    @cached_property
    def unit(self) -> np.ndarray:
        """Unit vectors in single precision; a zero vector stays zero."""
        return np.divide(self.x, self.norm[:, None], out=np.zeros_like(self.x), where=self.norm[:, None] > 0).astype(np.float32)

    def cosines(self, others: Rows) -> np.ndarray:
        """Rounded cosines, a row for each of the others; 0 for a zero vector."""
        long = np.outer(others.norm, self.norm)
        return np.round(np.divide(others.x @ self.x.T, long, out=np.zeros_like(long), where=long > 0), 6)


def best_of(k: int, allowed=None):
    """For ``passing_by``: the k best of a block's rows for each query, without its own id; ``allowed`` sets what else does not count to -inf."""

    def compare(block: Rows, queries: pd.DataFrame) -> Iterator[pd.DataFrame]:
        for part in portions(queries, len(block.ids)):
            asked = Rows(part)
            score = block.cosines(asked)
            score[asked.ids[:, None] == block.ids[None, :]] = -np.inf
            if allowed is not None:
                allowed(block, part, score)
            # All rows that tie with the k-th stay until ids decide.
            least = np.partition(score, -k, axis=1)[:, -k, None] if len(block.ids) > k else -np.inf
            q, r = np.nonzero((score >= least) & np.isfinite(score))
            own = score[q, r]
            order = np.lexsort((block.ids[r], -own, q))
            q, r, own = q[order], r[order], own[order]
            first = np.arange(len(q)) - np.searchsorted(q, q) < k
            yield pd.DataFrame({"query_id": asked.ids[q[first]], "vec_id": block.ids[r[first]], "score": own[first]})

    return compare


def ranked(found: DataFrame, k: int) -> DataFrame:
    """The k best rows of each query; at most k a block come together."""
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)


def top_k(vectors: DataFrame, queries: DataFrame, k: int, block: int = 4096) -> DataFrame:
    """The k nearest rows of each query by cosine, ties to the smaller id; any number of queries.

    Rows are dealt once into blocks by a hash, and the queries are brought to every block: a task holds its block and the queries
    pass by. Where there are fewer blocks than cores, blocks are held more than once, each time for a part of the queries.
    """
    rows, asked = usable(vectors), usable(queries)
    blocks = max(1, -(-rows.count() // block))
    groups = -(-cores(vectors.sparkSession) // blocks)
    each = lambda of: F.explode(F.sequence(F.lit(0), F.lit(of - 1)))
    at = lambda b, g: (b * groups + g).alias("task")
    own = rows.select(F.pmod(F.xxhash64("vec_id", "embedding"), F.lit(blocks)).cast("int").alias("b"), each(groups).alias("g"), "vec_id", "embedding").select(at(F.col("b"), F.col("g")), "vec_id", "embedding")
    come = asked.select(each(blocks).alias("b"), F.pmod(F.xxhash64(F.lit(1), "vec_id"), F.lit(groups)).cast("int").alias("g"), "vec_id", "embedding").select(at(F.col("b"), F.col("g")), "vec_id", "embedding")
    return ranked(passing_by(own, come, blocks * groups, Rows, best_of(k), FOUND), k)


def _pairs_of(least: float, across: bool):
    def compare(block: Rows, others: pd.DataFrame) -> Iterator[pd.DataFrame]:
        slack = 1e-6 + (block.x.shape[1] + 8) * 1.2e-7  # more than single precision and rounding make of a cosine
        for part in portions(others, len(block.ids)):
            come = Rows(part)
            p, q = np.divmod(np.flatnonzero(come.unit @ block.unit.T >= least - slack), len(block.ids))
            # Rows of the block itself pass by too: there each pair counts once. A repeated row is no pair with itself.
            keep = (come.ids[p] != block.ids[q]) & (~part.same.to_numpy(dtype=bool)[p] | (come.ids[p] < block.ids[q]))
            if across:
                keep &= come.label[p] != block.label[q]
            p, q = p[keep], q[keep]
            step = max(1, SCORES // block.x.shape[1])
            for at in range(0, len(p), step):
                yield _exact(block, come, p[at : at + step], q[at : at + step], least)

    return compare


def _exact(block: Rows, come: Rows, p: np.ndarray, q: np.ndarray, least: float) -> pd.DataFrame:
    """Those of the pairs that reach the limit by their rounded cosines in double."""
    long = come.norm[p] * block.norm[q]
    score = np.round(np.divide(np.einsum("ij,ij->i", come.x[p], block.x[q]), long, out=np.zeros_like(long), where=long > 0), 6)
    keep = score >= least
    a, b = come.ids[p[keep]], block.ids[q[keep]]
    return pd.DataFrame({"a": np.minimum(a, b), "b": np.maximum(a, b), "score": score[keep]})


def packed(rows: DataFrame, kind: str, *others: str) -> DataFrame:
    """Rows of a block as one row: ids, labels and all their components in a line, as ``kind`` (an array type that holds them exactly)."""
    own = F.collect_list(F.struct("vec_id", "label", F.col("embedding").cast(kind).alias("embedding"))).alias("own")
    return rows.groupBy("block", *others).agg(own).select("block", *others, F.col("own.vec_id").alias("ids"), F.col("own.label").alias("labels"), F.flatten("own.embedding").alias("xs"))


def unpacked(packs: pd.DataFrame) -> Iterator[pd.DataFrame]:
    for pack in packs.itertuples():
        x = np.asarray(pack.xs, dtype=np.float64).reshape(len(pack.ids), -1)
        yield pd.DataFrame({"vec_id": pack.ids, "label": pack.labels, "embedding": list(x), "same": pack.same})


def near_cells(centroids: np.ndarray, radius: np.ndarray, least: float) -> list[list[int]]:
    """For each cell the cells from it on that may hold a vector with a cosine of at least ``least`` to one of its own."""
    most = np.sqrt(max(0.0, 2 - 2 * (least - 1e-6))) + SLACK
    out = []
    for i in range(len(centroids)):
        gap = np.sqrt(np.maximum(((centroids[i:] - centroids[i]) ** 2).sum(1), 0)) - radius[i:] - radius[i]
        out.append((np.flatnonzero((gap <= most) & (radius[i] >= 0) & (radius[i:] >= 0)) + i).tolist())
    return out


def similar_pairs(vectors: DataFrame, least: float, block: int = 8192, across: bool = True, cells: int | None = None) -> DataFrame:
    """All pairs (of different labels, unless ``across`` is off) with a cosine of at least ``least``.

    Vectors lie in cells; pairs of cells whose centroids and radii leave no such pair are never met. A cell's rows are split into blocks of about
    ``block`` rows (fewer of long vectors) that move as one row each. Of two blocks one is held and the other passes by, in turns, so that all
    blocks are passed by about as many; those that pass are dealt over several tasks, at most ``PASSING`` blocks each. Pairs are
    told apart in single precision and only those near the limit worked out in double. Rows without an id, label or vector are in no pair.
    With a limit of 0 or less zero vectors would count too, so nothing is left out then.
    """
    named = vectors.select("vec_id", "label", "embedding").dropna()
    n, width = named.agg(F.count("*"), F.max(F.size("embedding"))).first()
    block = max(1, min(block, COMPONENTS // max(1, width or 1)))
    cells = cells or min(4096, max(1, n // block))
    centroids = fit(named, cells)
    path = f"{shared_dir(vectors.sparkSession)}/cells-{uuid.uuid4().hex}"
    in_cells(named, centroids, "label").dropDuplicates(["vec_id", "label", "embedding"]).write.parquet(path)  # repeated rows would share a block
    rows = vectors.sparkSession.read.parquet(path)
    sizes = {r["cell"]: (r["n"], r["far"]) for r in rows.groupBy("cell").agg(F.count("*").alias("n"), F.max("far").alias("far")).collect()}  # a row a cell
    radius = np.array([sizes[c][1] if c in sizes else -1.0 for c in range(len(centroids))])
    near = near_cells(centroids, radius, least) if least > 0 else [[j for j in range(i, len(centroids)) if j in sizes] if i in sizes else [] for i in range(len(centroids))]
    blocks = [-(-sizes[c][0] // block) if c in sizes else 0 for c in range(len(centroids))]
    first = np.concatenate([[0], np.cumsum(blocks)]).tolist()
    # Blocks that a cell's blocks meet: its own, and those of all cells that it is near.
    meets: list[list[int]] = [[] for _ in centroids]
    for i, own in enumerate(near):
        for j in own:
            meets[j] += range(first[i], first[i + 1])
            if i != j:
                meets[i] += range(first[j], first[j + 1])
    known = lambda made, schema: F.broadcast(vectors.sparkSession.createDataFrame(made, schema))
    split = known([(c, first[c], blocks[c]) for c in sizes], "cell int, first int, blocks int")
    placed = rows.join(split, "cell").withColumn("block", F.col("first") + F.pmod(F.xxhash64("vec_id", "embedding"), F.col("blocks")).cast("int"))
    kind = dict(vectors.dtypes)["embedding"]
    packs = packed(placed, kind if kind == "array<float>" else "array<double>", "cell").join(known([(c, meets[c]) for c in sizes], "cell int, meets array<int>"), "cell")
    # Tasks are numbered by the block that they hold and by a group of blocks that pass it.
    groups = -(-first[-1] // PASSING)
    task = lambda held, passing: held * groups + F.floor(passing / PASSING)
    own = F.col("block")
    turns = F.filter("meets", lambda x: (x == own) | ((x < own) == ((x + own) % 2 == 1)))
    held = packs.select(F.explode(F.array_distinct(F.transform("meets", lambda x: task(own, x)))).alias("task"), F.lit(True).alias("same"), "ids", "labels", "xs")
    come = packs.select(F.explode(turns).alias("held"), "block", "ids", "labels", "xs").select(task(F.col("held"), F.col("block")).alias("task"), (F.col("held") == F.col("block")).alias("same"), "ids", "labels", "xs")
    pairs = _pairs_of(least, across)

    def compare(block: Rows, others: pd.DataFrame) -> Iterator[pd.DataFrame]:
        for rows in unpacked(others):
            yield from pairs(block, rows)

    return passing_by(held, come, first[-1] * groups, lambda packs: Rows(pd.concat(unpacked(packs))), compare, "a long, b long, score double").distinct()


def parts(v: Column | str, n: int, width: int) -> Column:
    """A long vector as n vectors."""
    return F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda i: F.slice(v, i * width + 1, F.lit(width)))


def max_sim(a: Column, b: Column) -> Column:
    """Mean over a's vectors of the best cosine with one of b's."""
    best = F.transform(a, lambda x: F.array_max(F.transform(b, lambda y: cosine(x, y))))
    return F.aggregate(best, F.lit(0.0), lambda s, x: s + x) / F.size(a)


def document_similarity(a: Column | str, b: Column | str, n: int, width: int) -> Column:
    """.3 cosine of the whole and .7 MaxSim of the parts."""
    return 0.3 * cosine(a, b) + 0.7 * max_sim(parts(a, n, width), parts(b, n, width))


def unit(a: Column | str) -> Column:
    n = F.nullif(norm(a), F.lit(0.0))
    return F.transform(a, lambda x: x.cast("double") / n)


def late_fusion(a: Column | str, b: Column | str, wa: float = 0.5, wb: float = 0.5) -> Column:
    """Weighted sum of unit vectors, normalised."""
    return unit(F.zip_with(unit(a), unit(b), lambda x, y: wa * x + wb * y))


def centroids(vectors: DataFrame) -> DataFrame:
    """Mean vector of each label by dimension: partial sums, no collected groups."""
    return vectors.select("label", F.posexplode("embedding").alias("dim", "x")).groupBy("label", "dim").agg(F.round(F.avg(F.col("x").cast("double")), 6).alias("mean"))
