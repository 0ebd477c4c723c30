"""Layout and paragraph relations of a document's entities. Entities meet within their page or paragraph only."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.operators.cells import passing_by
from tidemark.operators.stateful import anchored_groups, box_relations


def aligned_pairs(items: DataFrame, page: str, key: str, x: str, y: str, tolerance: float) -> DataFrame:
    """Pairs of a page's items in the same row or column (E06, E07), with confidence .9."""
    out = None
    for kind, centre in (("same_row", y), ("same_column", x)):
        groups = anchored_groups(items.select(page, key, centre), page, key, centre, tolerance)
        a, b = groups.select(page, "anchor", F.col(key).alias("a")), groups.select(page, "anchor", F.col(key).alias("b"))
        pairs = a.join(b, [page, "anchor"]).filter("a < b").select(page, "a", "b", F.lit(kind).alias("kind"), F.lit(0.9).alias("confidence"))
        out = pairs if out is None else out.unionByName(pairs)
    return out


class Needles:
    """The entities of a page as one automaton."""

    def __init__(self, rows: pd.DataFrame) -> None:
        import ahocorasick

        self.page, self.found = rows.task.iloc[0], ahocorasick.Automaton()
        for e in rows.entity:
            self.found.add_word(e, e)
        self.found.make_automaton()


def _inside(page: Needles, blocks: pd.DataFrame) -> Iterator[pd.DataFrame]:
    out = [(page.page, b, e, t == e) for b, t in zip(blocks.block, blocks.text, strict=True) for e in {e for _, e in page.found.iter(t)}]
    if out:
        yield pd.DataFrame(out, columns=["page", "block", "entity", "exact"])


def occurrences(entities: DataFrame, blocks: DataFrame, page: str) -> DataFrame:
    """(page, block, entity, exact) wherever a block of a page contains an entity of that page; exact where it is the whole block.

    A page's entities become one automaton, and its blocks pass by: the work grows with the page's text and what is found in it. Empty entities and
    rows with nulls are in nothing.
    """
    kinds = dict(entities.dtypes) | dict(blocks.dtypes)
    known = entities.select(F.col(page).alias("task"), "entity").filter("entity <> ''").dropna().distinct()
    come = blocks.select(F.col(page).alias("task"), "block", "text").dropna()
    tasks = int(entities.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return passing_by(known, come, tasks, Needles, _inside, f"page {kinds[page]}, block {kinds['block']}, entity string, exact boolean").withColumnRenamed("page", page)


def placed_in_blocks(entities: DataFrame, blocks: DataFrame, page: str) -> DataFrame:
    """For each entity (page, entity) the block it equals, else the first block that contains it; blocks(page, block, text)."""
    best = occurrences(entities, blocks, page).groupBy(page, "entity").agg(F.min(F.struct((~F.col("exact")).alias("part"), F.col("block"))).alias("best"))
    return best.select(page, "entity", "best.block", (~F.col("best.part")).alias("exact"))


def same_paragraph(entities: DataFrame, paragraphs: DataFrame, page: str) -> DataFrame:
    """Pairs of a document's entities in one paragraph, with how many paragraphs they share; paragraphs(page, block, text)."""
    within = occurrences(entities, paragraphs, page).select(page, "block", "entity")
    a, b = within.withColumnRenamed("entity", "a"), within.withColumnRenamed("entity", "b")
    return a.join(b, [page, "block"]).filter("a < b").groupBy(page, "a", "b").agg(F.count("*").alias("n"))


def authors(entities: DataFrame, author: str, kind: str = "person") -> DataFrame:
    """author_of edges from entities of a kind whose text holds the document's author."""
    return entities.filter((F.col("kind") == kind) & F.contains("entity", F.col(author))).select("doc_id", "entity", F.lit("document").alias("target"), F.lit("author_of").alias("relation"), F.lit(0.9).alias("confidence"))


def visual_relations(boxes: DataFrame, page: str, key: str, wide: float, high: float, least: float = 0.5) -> DataFrame:
    """Relations of a page's boxes, brought to a page of width and height 1, with a confidence of at least ``least``."""
    to = {"x1": wide, "x2": wide, "y1": high, "y2": high}
    return box_relations(boxes.select(page, key, *[(F.col(c) / n).alias(c) for c, n in to.items()]), page, key).filter(F.col("confidence") >= least)


def regions_of_interest(maps: DataFrame, key: str, cells: str, share: float = 0.5) -> DataFrame:
    """4-connected regions above a share of the map's maximum, as normalised boxes; a map is an array of rows, and one row's work."""
    kind = dict(maps.dtypes)[key]

    def task(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for k, rows in zip(batch[key], batch[cells], strict=True):
                grid = [list(r) for r in rows] if rows is not None else []
                limit = share * max((x for r in grid for x in r), default=0.0)
                left = {(i, j) for i, r in enumerate(grid) for j, x in enumerate(r) if x > limit}
                while left:
                    stack, region = [left.pop()], []
                    while stack:
                        i, j = stack.pop()
                        region.append((i, j))
                        for near in ((i - 1, j), (i + 1, j), (i, j - 1), (i, j + 1)):
                            if near in left:
                                left.remove(near)
                                stack.append(near)
                    ys, xs = [i for i, _ in region], [j for _, j in region]
                    high, wide = len(grid), max(map(len, grid))
                    out.append((k, min(xs) / wide, min(ys) / high, (max(xs) + 1) / wide, (max(ys) + 1) / high, len(region)))
            yield pd.DataFrame(out, columns=[key, "x1", "y1", "x2", "y2", "cells"])

    return maps.select(key, cells).mapInPandas(task, f"{key} {kind}, x1 double, y1 double, x2 double, y2 double, cells long")
