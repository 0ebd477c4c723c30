"""Exact top-k inner-product search with a bit-sliced index (operator 3).

Each component x of a vector becomes the integer floor(1024 * x). A block of rows is indexed as bit slices:
for every dimension and bit, a bitmap over the block's rows. A query's score is a weighted sum of slices. Of
each attribute only the slices from bit ``CUT`` up are added, by carry-save adders over bitmaps, which gives a
sum of slices; its k-th greatest value is found from the most significant slice downward. The slices left
out can change a score only within a range that the query's own components give, so every row outside that
range of the k-th value is decided; the boundary rows are resolved with their exact integer scores.

Rows are dealt once into blocks of about ``BLOCK_CELLS`` components; a block is indexed once, and the queries come to it
in batches. Where there are fewer blocks than cores, each block serves as many groups of queries as that takes. A block
gives its own k best rows a query, and a window over those keeps the k best of all. Rows that are repeated exactly are
one indexed row with a count, so they make no block hot.

Defined cases: a vector that is null or holds a component that is null or not finite (or is not after the scaling) takes
no part; vectors of different lengths meet as if the shorter ended in zeros; equal scores go to the smaller
vec_id; repeated rows count as rows of their own, except that a query never meets a row with its own vec_id and
is asked once; rows of one vec_id with different vectors are queries of their own; rows whose vec_id is null are no queries or
candidates; an empty table gives an empty result; extra columns are not read. Where the squares of a vector's integers
add up to less than 2 ** 62, every score of two such vectors is a long. Vectors beyond that meet all others in exact
arithmetic of unbounded integers; a pair whose score is no long is left out, and only that pair.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.common import stored

SCALE = 1024
#: Bits of each attribute below this one stay out of the slice sum.
CUT = 4
#: Components of a block of rows.
BLOCK_CELLS = 4_194_304


def usable(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(vec_id, v array<int>, w array<double>) of the vectors that take part: v of those whose scores are longs, else w."""
    v = F.col(vector_col)
    fine = F.col(id_col).isNotNull() & v.isNotNull() & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x.cast("double") * SCALE) < float("inf")))
    whole = lambda d: F.when(F.abs(d) < float(1 << 52), F.floor(d).cast("double")).otherwise(d)
    rows = vectors.filter(fine).select(F.col(id_col).cast("long").alias("vec_id"), F.transform(v, lambda x: whole(x.cast("double") * SCALE)).alias("w"))
    short = F.aggregate("w", F.lit(0.0), lambda s, x: s + x * x) < float(1 << 62)
    return rows.select("vec_id", F.when(short, F.transform("w", lambda x: x.cast("int"))).alias("v"), F.when(~short, F.col("w")).alias("w"))


def _matrix(column: pd.Series, dims: int, dtype: type = np.int64) -> np.ndarray:
    """Vectors as rows, with zeros after their end; as Python's integers where dtype is object."""
    out = np.zeros((len(column), dims), dtype=dtype)
    for i, v in enumerate(column):
        out[i, : len(v)] = v if dtype is not object else [int(x) for x in v]
    return out


def signed_digits(weight: int) -> Iterator[tuple[int, int]]:
    """(exponent, 1 or -1) of the powers of two that add up to the weight, with the fewest possible."""
    at = 0
    while weight:
        if weight & 1:
            digit = 2 - (weight & 3)
            yield at, digit
            weight -= digit
        weight, at = weight >> 1, at + 1


class SliceIndex:
    """Bit slices of a block of integer vectors: ``slices[1][d, b]`` is a bitmap of the rows that have bit b in dimension d."""

    def __init__(self, rows: np.ndarray) -> None:
        self.rows, (self.n, self.dims) = rows, rows.shape
        self.low = rows.min(initial=0)
        shifted = rows - self.low
        self.bits = max(1, int(shifted.max(initial=0)).bit_length())
        words = -(-self.n // 64)
        planes = np.zeros((self.dims, self.bits, words * 64), dtype=bool)
        for b in range(self.bits):
            planes[:, b, : self.n] = ((shifted >> b) & 1).astype(bool).T
        slices = np.packbits(planes, axis=-1, bitorder="little").view(np.uint64)
        self.valid = np.packbits(np.arange(words * 64) < self.n, bitorder="little").view(np.uint64)
        #: The slices, and their complements.
        self.slices = {1: slices, -1: ~slices & self.valid}

    def add_up(self, query: np.ndarray, cut: int) -> tuple[list[np.ndarray], int]:
        """Slices, least first, of the weighted sum of the attributes' bits from ``cut`` up, and their common weight's exponent.

        Weights are taken in signed digits. A negative digit adds the complement; the constants that this leaves aside
        are the same for all rows.
        """
        columns: dict[int, list[np.ndarray]] = {}
        for d in np.flatnonzero(query).tolist():
            for at, sign in signed_digits(int(query[d])):
                for b in range(cut, self.bits):
                    columns.setdefault(at + b, []).append(self.slices[sign][d, b])
        if not columns:
            return [], 0
        total, least, at = [], min(columns), min(columns)
        while at <= max(columns):
            stack = columns.get(at, [])
            carries = columns.setdefault(at + 1, []) if len(stack) > 1 else columns.get(at + 1, [])
            while len(stack) >= 3:  # a full adder turns three bitmaps of one weight into one and a carry
                a, b, c = stack.pop(), stack.pop(), stack.pop()
                half = a ^ b
                stack.append(half ^ c)
                carries.append((a & b) | (half & c))
            if len(stack) == 2:
                a, b = stack
                stack = [a ^ b]
                carries.append(a & b)
            total.append(stack[0] if stack else np.zeros_like(self.valid))
            columns.pop(at, None)
            at += 1
            if not columns:
                break
        return total, least

    def threshold(self, total: list[np.ndarray], k: int) -> int:
        """The k-th greatest value of the sum, from the most significant slice downward."""
        sure, maybe, value = 0, self.valid, 0
        for b in range(len(total) - 1, -1, -1):
            with_bit = maybe & total[b]
            n = sure + int(np.bitwise_count(with_bit).sum())
            if n >= k:
                maybe, value = with_bit, value | (1 << b)
            else:
                sure, maybe = n, maybe & ~total[b]
        return value

    def at_least(self, total: list[np.ndarray], value: int) -> np.ndarray:
        """Row numbers whose sum is at least the value."""
        if value <= 0:
            return np.arange(self.n)
        if value >> len(total):
            return np.empty(0, dtype=np.int64)
        above, equal = np.zeros_like(self.valid), self.valid
        for b in range(len(total) - 1, -1, -1):
            if value >> b & 1:
                equal = equal & total[b]
            else:
                above = above | (equal & total[b])
                equal = equal & ~total[b]
        return np.flatnonzero(np.unpackbits((above | equal).view(np.uint8), bitorder="little"))

    def candidates(self, query: np.ndarray, k: int) -> np.ndarray:
        """Rows that can be among the k best: those whose slice sum is within the undecided range of the k-th."""
        if self.n <= k:
            return np.arange(self.n)
        cut = min(CUT, self.bits - 1)
        total, least = self.add_up(query, cut)
        if not total:
            return np.arange(self.n)
        # Bits below the cut add between -rest * sum of negative weights and rest * sum of positive ones.
        undecided = ((1 << cut) - 1) * int(np.abs(query).sum())
        return self.at_least(total, self.threshold(total, k) - (undecided >> least) - 1)


class Block:
    """A block of rows: an index over those with short integers, and the few others as they are."""

    def __init__(self, rows: pd.DataFrame) -> None:
        rows = rows.sort_values("vec_id", kind="stable")
        wide = rows.v.isna().to_numpy()
        self.short, self.wide = rows[~wide], rows[wide]
        self.dims = max(1, *self.short.v.str.len()) if len(self.short) else 1
        self.index = SliceIndex(_matrix(self.short.v, self.dims))
        #: Most rows that a query's own vec_id can take.
        self.own = int(self.short.vec_id.value_counts().max()) if len(self.short) else 0

    def search(self, query: int, v: np.ndarray | None, w: np.ndarray | None, k: int) -> pd.DataFrame:
        """vec_id, score and copies of the k best rows, without the query's own."""
        if v is None:
            found = [self._exactly(self.short, self.short.v, w), self._exactly(self.wide, self.wide.w, w)]
        else:
            asked = _matrix([v], max(self.dims, len(v)))[0][: self.dims]
            at = self.index.candidates(asked, k + self.own)
            found = [self._frame(self.short.iloc[at], self.index.rows[at] @ asked)]
            if len(self.wide):
                found.append(self._exactly(self.wide, self.wide.w, v))
        found = pd.concat(found)
        found = found[found.vec_id != query]
        return found.iloc[np.lexsort((found.vec_id, -found.score))[:k]]

    @staticmethod
    def _frame(rows: pd.DataFrame, score: np.ndarray) -> pd.DataFrame:
        return pd.DataFrame({"vec_id": rows.vec_id.to_numpy(), "score": score.astype(np.int64), "copies": rows.copies.to_numpy()})

    def _exactly(self, rows: pd.DataFrame, vectors: pd.Series, query: np.ndarray) -> pd.DataFrame:
        """All rows whose score is a long, by unbounded integers."""
        dims = max([len(query), *map(len, vectors)])
        score = _matrix(vectors, dims, object) @ _matrix([query], dims, object)[0]
        fits = np.array([-(1 << 63) <= x < 1 << 63 for x in score], dtype=bool)
        return self._frame(rows[fits], score[fits])


def _search(k: int):
    def task(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """Partitions sorted by task, rows before queries: a task's block is indexed once, then its queries pass by."""
        held: list[pd.DataFrame] = []
        at, block = None, None
        for batch in batches:
            for key, part in batch.groupby("task", sort=False):
                if key != at:
                    at, block, held = key, None, []
                rows, queries = part[~part.asked], part[part.asked]
                if len(rows):
                    held.append(rows)
                if not len(queries) or not held:
                    continue
                block = block or Block(pd.concat(held))
                found = [block.search(q, v, w, k).assign(query_id=q, sign=s) for q, s, v, w in zip(queries.vec_id, queries.sign, queries.v, queries.w, strict=True)]
                yield pd.concat(found)[["query_id", "sign", "vec_id", "score", "copies"]]

    return task


def top_k(vectors: DataFrame, k: int = 10, every: int = 100) -> DataFrame:
    """The k best rows of each query (vec_id divisible by ``every``): query_id, rank, vec_id, score."""
    spark = vectors.sparkSession
    counted = usable(vectors).groupBy("vec_id", "v", "w").agg(F.count("*").alias("copies"))
    rows = stored(counted.withColumn("sign", F.xxhash64("vec_id", "v", "w")), "vectors")
    total, dims = rows.agg(F.count("*"), F.max(F.size(F.coalesce(F.col("v").cast("array<double>"), "w")))).first()
    blocks = max(1, -(-total * max(1, dims or 1) // BLOCK_CELLS))
    cores = max(1, spark.sparkContext.defaultParallelism)
    groups = -(-cores // blocks)
    each = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    block = F.pmod("sign", F.lit(blocks)).cast("int")
    group = F.pmod(F.xxhash64(F.lit("query"), "sign"), F.lit(groups)).cast("int")
    own = rows.select(block.alias("b"), each(groups).alias("g"), F.lit(False).alias("asked"), "vec_id", "sign", "copies", "v", "w")
    asked = rows.filter(F.col("vec_id") % every == 0).select(each(blocks).alias("b"), group.alias("g"), F.lit(True).alias("asked"), "vec_id", "sign", "copies", "v", "w")
    met = own.union(asked).select((F.col("b") * groups + F.col("g")).alias("task"), "asked", "vec_id", "sign", "copies", "v", "w")
    dealt = met.repartition(blocks * groups, "task").sortWithinPartitions("task", "asked")
    found = dealt.mapInPandas(_search(k), "query_id long, sign long, vec_id long, score long, copies long")
    # A repeated row comes as often as it is there, at most k times.
    found = found.withColumn("copy", F.explode(F.sequence(F.lit(1), F.least("copies", F.lit(k)).cast("int"))))
    order = Window.partitionBy("query_id", "sign").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
