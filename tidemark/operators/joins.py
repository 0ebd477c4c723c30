"""Joins with a table of one row a key, where a key of the other side may hold a large part of all rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.session import shared_dir

#: A key with more rows than this is hot; a table of at most so many rows may be broadcast, if its rows are no wider than so many bytes together.
HOT, FEW, FEW_BYTES = 50_000, 100_000, 64_000_000


def checkpointed(df: DataFrame) -> DataFrame:
    """Cut lineage in the checkpoint folder that the session names."""
    context = df.sparkSession.sparkContext
    if not context._jsc.sc().getCheckpointDir().isDefined():
        context.setCheckpointDir(shared_dir(df.sparkSession))
    return df.checkpoint()


def few(df: DataFrame, most: int | None = None, width: int = 200) -> bool:
    """Whether a checkpointed table has so few rows that it may be broadcast, by a count of at most that many and by the width of a row."""
    bound = min(FEW if most is None else most, FEW_BYTES // max(1, width))
    return df.limit(bound + 1).count() <= bound


def join_counted(rows: DataFrame, known: DataFrame, key: str, count: str, width: int = 200) -> DataFrame:
    """Inner join with a checkpointed table that has one row a key, and in ``count`` how many rows that key has.

    A small table is broadcast. Of a large one the hot keys are, as there is at most one for every ``HOT`` rows, and the rest is joined by
    shuffle; so rows of a hot key never meet in one task. Should even the hot keys be many, the join is left to adaptive execution.
    """
    if few(known, width=width):
        return rows.join(F.broadcast(known.drop(count) if count in rows.columns else known), key)
    mine = known.drop(count) if count in rows.columns else known
    hot_keys = known.filter(F.col(count) > HOT).select(key)
    if few(hot_keys, 0) or not few(hot_keys, width=width):
        return rows.join(mine, key)
    hot_known = mine.join(F.broadcast(hot_keys), key, "left_semi")
    cold = rows.join(F.broadcast(hot_keys), key, "left_anti").join(mine.join(F.broadcast(hot_keys), key, "left_anti"), key)
    return cold.unionByName(rows.join(F.broadcast(hot_known), key))
