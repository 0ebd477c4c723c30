"""Order-dependent operators: anchor grouping, greedy clusters, retries, cache eviction, box relations."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def sparse_runs(df: DataFrame, by: list[str], at: str, width: float, into: str) -> DataFrame:
    """The rows with the number of their run: consecutive rows of a key, each less than ``width`` after the one before.

    Rows of one bucket of that width are in one run anyway, so only buckets, not rows, are brought in order.
    """
    buckets = df.withColumn("_b", F.floor(F.col(at) / width))
    edges = buckets.groupBy(*by, "_b").agg(F.min(at).alias("_low"), F.max(at).alias("_high"))
    w = Window.partitionBy(*by).orderBy("_b")
    new = F.when(F.col("_low") - F.lag("_high").over(w) >= width, 1).otherwise(0)
    runs = edges.withColumn("_new", new).select(*by, "_b", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0)).alias(into))
    return buckets.join(runs, [*by, "_b"]).drop("_b")


def folded(df: DataFrame, by: list[str], order: list[str], step, schema: str) -> DataFrame:
    """A fold over the sorted rows of each key, a batch at a time: step(rows, state) gives (result, state); a new key starts with None.

    A key is one task's work, in order, but never held: memory is a batch, however long the key.
    """

    def task(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        last, state = None, None
        for batch in batches:
            for key, rows in batch.groupby(by, sort=False, dropna=False):
                state = state if key == last else None
                last = key
                out, state = step(rows, state)
                yield out

    return df.repartition(*by).sortWithinPartitions(*by, *order).mapInPandas(task, schema)


def anchored_groups(df: DataFrame, by: str, key: str, centre: str, tolerance: float) -> DataFrame:
    """Items in order of their centre; an item joins the group while within the tolerance of the group's FIRST item.

    Items further apart than the tolerance start a run of their own, so a page's runs are folded apart from each other.
    """
    kinds = dict(df.dtypes)

    def task(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        # Pages and runs are many and short: a row is a step of one loop, whatever its page, and a batch gives one frame.
        last, anchor = None, None
        for rows in batches:
            anchors = []
            for page, run, c in zip(rows[by].tolist(), rows._run.tolist(), rows[centre].astype(float).tolist(), strict=True):
                if (page, run) != last:
                    last, anchor = (page, run), c
                elif c - anchor > tolerance:
                    anchor = c
                anchors.append(anchor)
            yield pd.DataFrame({by: rows[by], key: rows[key], "anchor": np.array(anchors, dtype=float)})

    # Runs are cut where the gap is beyond the tolerance, by the next double above it.
    runs = sparse_runs(df.select(by, key, centre), [by], centre, float(np.nextafter(tolerance, np.inf)), "_run")
    return runs.repartition(by, "_run").sortWithinPartitions(by, "_run", centre, key).mapInPandas(task, f"{by} {kinds[by]}, {key} {kinds[key]}, anchor double")


def ratio(a: str, b: str) -> float:
    """Matching-blocks similarity of two strings."""
    from difflib import SequenceMatcher

    return SequenceMatcher(None, a, b).ratio()


def string_ratio(a: Column | str, b: Column | str) -> Column:
    """H34 as a column, in Arrow batches."""

    @F.pandas_udf("double")
    def similar(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for x, y in batches:
            yield pd.Series([ratio(p or "", q or "") for p, q in zip(x, y, strict=True)], dtype="float64")

    return similar(a, b)


class LikelySeeds:
    """Seeds in their order, and those whose ratio with a text may reach the limit, by counts of characters in 64 cells."""

    CELLS = 64

    def __init__(self, least: float) -> None:
        self.least, self.known = least, []
        self.counts, self.sizes = np.zeros((16, self.CELLS), dtype=np.int32), np.zeros(16, dtype=np.int64)

    def _counts(self, text: str) -> np.ndarray:
        return np.bincount(np.frombuffer(text.encode("utf-32-le"), dtype="<u4") % self.CELLS, minlength=self.CELLS).astype(np.int32)

    def add(self, key, text: str) -> None:
        n = len(self.known)
        if n == len(self.sizes):
            self.counts, self.sizes = np.concatenate([self.counts, np.zeros_like(self.counts)]), np.concatenate([self.sizes, np.zeros_like(self.sizes)])
        self.counts[n], self.sizes[n] = self._counts(text), len(text)
        self.known.append((key, text))

    def for_text(self, text: str) -> Iterator[tuple]:
        """What two texts have in common in cells is at least what their matching blocks hold."""
        n = len(self.known)
        both = np.minimum(self.counts[:n], self._counts(text)).sum(1)
        likely = 2 * both >= self.least * (self.sizes[:n] + len(text)) - 1e-9
        return (self.known[i] for i in np.flatnonzero(likely).tolist())


def greedy_clusters(df: DataFrame, block: str, key: str, label: str, least: float) -> DataFrame:
    """Within a block and in key order, an item joins the first cluster whose SEED is similar enough, else it seeds one.

    Items of one label always join the same cluster, so only a block's distinct labels meet in a task, each with its least
    key; choose blocks (type, first letters, length band) whose labels are few. The characters that two labels share, with how
    often, bound their ratio; that is one array operation over all seeds, and only seeds within the bound are matched.
    """
    kind = dict(df.dtypes)
    named = df.select(F.col(block).alias("_block"), F.col(key).alias("_key"), F.coalesce(label, F.lit("")).alias("_label"))

    def task(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("_first", kind="stable")
        seeds = LikelySeeds(least)
        out = []
        for k, text in zip(rows._first, rows._label, strict=True):
            for seed, name in seeds.for_text(text):
                if ratio(name, text) >= least:
                    break
            else:
                seed = k
                seeds.add(k, text)
            out.append(seed)
        return pd.DataFrame({"_b": rows._block, "_l": rows._label, "seed": out})

    once = named.groupBy("_block", "_label").agg(F.min("_key").alias("_first"))
    if kind[block].startswith("struct"):  # pandas groups by plain values
        once = once.withColumn("_block", F.to_json("_block"))
        named = named.withColumn("_json", F.to_json("_block"))
    else:
        named = named.withColumn("_json", F.col("_block"))
    kinds = dict(once.dtypes)
    seeds = once.groupBy("_block").applyInPandas(task, f"_b {kinds['_block']}, _l string, seed {kind[key]}")
    met = named.join(seeds, F.col("_json").eqNullSafe(F.col("_b")) & (F.col("_label") == F.col("_l")))
    return met.select(F.col("_block").alias(block), F.col("_key").alias(key), "seed")


def retried(entries: DataFrame, most: int = 3) -> DataFrame:
    """Failed entries with their next state: retried, or remaining once the retries are spent."""
    spent = F.col("retries") >= most
    return entries.select("entry", F.when(spent, "remaining").when(F.col("succeeds"), "processed").otherwise("failed").alias("state"), F.when(spent, F.col("retries")).otherwise(F.col("retries") + 1).alias("retries"))


def evicted(entries: DataFrame, as_of: str, max_age_days: int, budget: float) -> DataFrame:
    """What a cache keeps: entries young enough, and of those the most recently used whose sizes fit the budget.

    Sums run in two levels, by day and within the day, so no task sorts all entries.
    """
    young = entries.filter(F.col("last_used") >= F.lit(as_of).cast("timestamp_ntz") - F.expr(f"interval {max_age_days} day")).withColumn("day", F.to_date("last_used"))
    days = young.groupBy("day").agg(F.sum("size").alias("n"))
    after = F.coalesce(F.sum("n").over(Window.orderBy(F.desc("day")).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))  # one row a day
    inside = F.sum("size").over(Window.partitionBy("day").orderBy(F.desc("last_used"), F.desc("entry")).rowsBetween(Window.unboundedPreceding, 0))
    held = young.withColumn("inside", inside).join(F.broadcast(days.select("day", after.alias("newer"))), "day")
    return held.filter(F.round(F.col("newer") + F.col("inside"), 4) <= budget).select("entry", "size")


def box_relations(boxes: DataFrame, page: str, key: str) -> DataFrame:
    """Relations of a page's box pairs (x1, y1, x2, y2): containment, overlap, or direction, with a confidence.

    Boxes that meet have their overlap over the smaller one as confidence, directions .8.
    Pairs meet within their page only.
    """
    side = lambda name, mark: boxes.select(page, F.col(key).alias(name), *[F.col(c).alias(f"{mark}{c}") for c in ("x1", "y1", "x2", "y2")], ((F.col("x2") - F.col("x1")) * (F.col("y2") - F.col("y1"))).alias(f"{mark}area"))
    p, q = ({c: F.col(f"{mark}{c}") for c in ("x1", "y1", "x2", "y2", "area")} for mark in ("_p", "_q"))
    wide = F.least(p["x2"], q["x2"]) - F.greatest(p["x1"], q["x1"])
    high = F.least(p["y2"], q["y2"]) - F.greatest(p["y1"], q["y1"])
    both = wide * high
    meets = (wide > 0) & (high > 0)
    part = lambda of: both / F.nullif(of, F.lit(0.0)) > 0.9
    apart = {"above": p["y2"] < q["y1"], "below": q["y2"] < p["y1"], "left_of": p["x2"] < q["x1"], "right_of": q["x2"] < p["x1"]}
    kind = F.when(meets & part(q["area"]), "contains").when(meets & part(p["area"]), "contained_by").when(meets, "overlaps")
    some = meets
    for name, holds in apart.items():
        kind, some = kind.when(holds, name), some | holds
    sure = F.when(meets, both / F.nullif(F.least(p["area"], q["area"]), F.lit(0.0))).otherwise(F.lit(0.8))
    # Pairs without a relation are left out by its own short condition: a filter on the relation would have the join work out all of it for each pair.
    return side("a", "_p").join(side("b", "_q"), page).filter("a != b").filter(some).select(page, "a", "b", kind.alias("relation"), sure.alias("confidence"))


def joined_parts(parts: DataFrame) -> DataFrame:
    """parts of a key in order of position, joined by line ends."""
    return parts.groupBy("key").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("pos", "part"))), lambda x: x["part"]), "\n").alias("joined"))


def word_error_rate(reference: Column, hypothesis: Column) -> Column:
    """Edit distance over words divided by the reference's words: each distinct word becomes one character."""
    words = lambda c: F.filter(F.split(F.lower(c), r"\s+"), lambda w: w != "")
    known = F.array_distinct(F.concat(words(reference), words(hypothesis)))
    coded = lambda c: F.array_join(F.transform(words(c), lambda w: F.decode(F.unhex(F.lpad(F.hex(F.array_position(known, w) + 0x4E00), 4, "0")), "UTF-16BE")), "")
    return F.levenshtein(coded(reference), coded(hypothesis)) / F.greatest(F.lit(1), F.size(words(reference)))
