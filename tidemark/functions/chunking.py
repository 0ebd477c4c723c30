"""Chunks of texts as arrays, folded in the row: fixed windows, headed sections, packed sentences."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from tidemark.functions.text import sentences

# What makes a line a heading.
HEADINGS = [
    r"^#+\s+.*$",
    r"^[A-Z][\w\s]+:$",
    r"^\d+\.\d+\s+[A-Z][\w\s]+$",
    r"^\d+\.\s+[A-Z][\w\s]+$",
    r"^[A-Z][A-Z\s]+$",
]
#: Where a fixed window may end.
STOP = re.compile(r"[.\n ]")


def fixed_windows(text: Column, size: int = 1000, overlap: int = 200) -> Column:
    """array<struct<start, end>> of overlapping windows, each extended to the next full stop, line end or blank; stops at the end of the text.

    A text is walked once: a place in it is found without counting its characters from the start for each window.
    """

    def cuts(t: str) -> list[tuple[int, int]]:
        n, at, out, stops = len(t), 0, [], True
        while 0 <= at < n:
            end = min(at + size, n)
            if end < n and stops:
                stop = STOP.search(t, end)
                stops = stop is not None  # without one here there is none further on
                end = stop.end() if stop else end
            out.append((at, end))
            at = end - overlap if end < n and size > overlap else -1
        return out

    @F.pandas_udf("array<struct<start:int,end:int>>")
    def windows(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            yield pd.Series([None if t is None else [{"start": a, "end": b} for a, b in cuts(t)] for t in texts], dtype=object)

    return windows(text)


def section_starts(text: Column, most: int = 2000) -> Column:
    """Numbers of the lines that start a chunk: a heading, or the line after a chunk has passed the size."""
    lines = F.transform(F.split(text, "\n"), lambda x, i: F.struct(i.alias("i"), (F.length(x) + 1).alias("n"), x.rlike("|".join(HEADINGS)).alias("head")))
    none = F.struct(F.lit(0).alias("size"), F.array().cast("array<int>").alias("starts"))

    def step(s: Column, x: Column) -> Column:
        cut = (x["i"] == 0) | x["head"] | (s["size"] > most)
        return F.struct((F.when(cut, F.lit(0)).otherwise(s["size"]) + x["n"]).alias("size"), F.when(cut, F.concat(s["starts"], F.array(x["i"]))).otherwise(s["starts"]).alias("starts"))

    return F.aggregate(lines, none, step)["starts"]


def packed_sentences(text: Column, most: int = 1000) -> Column:
    """Sentences joined by blanks up to a length; a longer sentence is a segment of its own."""
    none = F.struct(F.lit("").alias("open"), F.array().cast("array<string>").alias("done"))

    def step(s: Column, x: Column) -> Column:
        fits = F.length(s["open"]) + F.length(x) + 1 <= most
        joined = F.when(s["open"] == "", x).otherwise(F.concat(s["open"], F.lit(" "), x))
        closed = F.when(s["open"] == "", s["done"]).otherwise(F.concat(s["done"], F.array(s["open"])))
        return F.struct(F.when(fits, joined).otherwise(x).alias("open"), F.when(fits, s["done"]).otherwise(closed).alias("done"))

    folded = F.aggregate(sentences(text), none, step, lambda s: F.when(s["open"] == "", s["done"]).otherwise(F.concat(s["done"], F.array(s["open"]))))
    return F.when(F.length(text) <= most, F.array(text)).otherwise(folded)


def adaptive_sizes(complexity: Column, formulas: Column, tables: Column) -> Column:
    """Window and overlap by the document's nature."""
    return F.when((complexity > 0.7) | formulas, F.struct(F.lit(800).alias("size"), F.lit(250).alias("overlap"))).when(tables, F.struct(F.lit(1200).alias("size"), F.lit(200).alias("overlap"))).otherwise(F.struct(F.lit(1500).alias("size"), F.lit(150).alias("overlap")))
