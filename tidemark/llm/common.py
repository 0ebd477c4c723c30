"""What the corpus operators share: words, shared-folder tables, checked broadcasts, keyed digests."""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.session import shared_dir

#: A word is a run of characters other than the ASCII white space characters.
WORD = r"[^\x20\x09-\x0D]+"
#: Those white space characters, as text.
BLANKS = " \t\n\x0b\x0c\r"


#: Tables written inside the innermost ``scratch``.
_SCRATCH: list[list[str]] = []


def stored(df: DataFrame, what: str) -> DataFrame:
    """Write a table to the shared folder and read it back: lineage is cut, and a lost executor loses nothing."""
    path = f"{shared_dir(df.sparkSession)}/{what}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    if _SCRATCH:
        _SCRATCH[-1].append(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


@contextmanager
def scratch(spark: SparkSession, keep: int = 0) -> Iterator[None]:
    """Tables stored inside are deleted at the end, but for the last ``keep``: what is computed from them must be stored by then."""
    _SCRATCH.append([])
    try:
        yield
    finally:
        paths = _SCRATCH.pop()
        if _SCRATCH:
            _SCRATCH[-1].extend(paths[len(paths) - keep :])
        for path in paths[: len(paths) - keep]:
            at = spark._jvm.org.apache.hadoop.fs.Path(path)
            at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def small_enough(df: DataFrame, most: int) -> bool:
    """Whether a stored table has at most so many rows; the check reads Parquet footers."""
    return df.limit(most + 1).count() <= most


def broadcast_if_small(df: DataFrame, most: int = 100_000) -> DataFrame:
    """Broadcast a stored table of few narrow rows; a larger one is left to a shuffle join."""
    return F.broadcast(df) if small_enough(df, most) else df


#: A key with more rows than this is hot.
HOT = 50_000


def join_hot(rows: DataFrame, known: DataFrame, key: str, count: str, most: int = HOT) -> DataFrame:
    """Inner join of rows with a stored table that has one row a key and, in ``count``, how many rows that key has.

    Rows of hot keys never meet in one task: they are joined by broadcast, the rest by shuffle. There is at most one hot
    key for every ``most`` rows; should even those be many, the join is left to adaptive execution.
    """
    hot = known.filter(F.col(count) > most)
    if small_enough(hot, 0) or not small_enough(hot, 100_000):
        return rows.join(known.drop(count), key)
    cold = rows.join(F.broadcast(hot.select(key)), key, "left_anti").join(known.filter(F.col(count) <= most).drop(count), key)
    return cold.unionByName(rows.join(F.broadcast(hot.drop(count)), key))


def unit_hash(*cols: Column | str) -> Column:
    """A keyed 60-bit number from MD5, which DuckDB can form too."""
    text = F.concat_ws("|", *[F.coalesce(c.cast("string"), F.lit("~")) if isinstance(c, Column) else F.lit(c) for c in cols])
    return F.conv(F.substring(F.md5(text), 1, 15), 16, 10).cast("long")


def free_names(df: DataFrame, *wanted: str) -> list[str]:
    """Names that clash with no column of the table, whatever their case."""
    taken = {c.lower() for c in df.columns}
    out = []
    for name in wanted:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out
