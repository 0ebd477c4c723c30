"""how well a graph agrees with a reference graph: one-to-one alignment of entities, precision, recall and F1 of entities and relations.

Entities are aligned in rounds: of all candidate pairs each side takes its best, and pairs that are each other's best are matched and leave;
the rounds end when no candidates are left, so the matching is maximal. Candidates share a block; scores are of the caller's making. Edges then agree
where both their ends are aligned with the ends of a reference edge of the same kind: semi and anti joins.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.session import shared_dir

#: Rounds after which the matching gives up; each matches at least the best pair of all.
MOST_ROUNDS = 200


def candidates(found: DataFrame, reference: DataFrame, score: Column, least: float) -> DataFrame:
    """(a, b, score) of entities (id, kind, label, block) of both sides that share kind and block, from a score on.

    ``score`` is an expression over ``label`` and ``label_``. Entities of one label in a block are met once, as one, so a block
    costs as much as its distinct labels, not its rows; choose blocks whose labels are few.
    """
    one = lambda df, mark: df.dropna(subset=["id", "kind", "label", "block"]).select("kind", "block", F.col("label").alias(f"label{mark}")).distinct()
    met = one(found, "").join(one(reference, "_"), ["kind", "block"]).withColumn("score", score).filter(F.col("score") >= least)
    a = found.select("kind", "block", "label", F.col("id").alias("a"))
    b = reference.select("kind", "block", F.col("label").alias("label_"), F.col("id").alias("b"))
    # The n-th entity of a label may only meet the n-th of another, so repeated labels make no pairs of all with all.
    place = lambda df, label, key: df.withColumn("place", F.row_number().over(Window.partitionBy("kind", "block", label).orderBy(key)))
    return met.join(place(a, "label", "a"), ["kind", "block", "label"]).join(place(b, "label_", "b"), ["kind", "block", "label_", "place"]).select("a", "b", "score")


def matched(pairs: DataFrame) -> DataFrame:
    """A maximal one-to-one matching of scored pairs (a, b, score) by rounds of mutual best matches; ties go to the smaller b, then the smaller a.

    Each round is written to the shared folder. The best pair of all is mutual, so every round matches something.
    """
    spark, folder = pairs.sparkSession, f"{shared_dir(pairs.sparkSession)}/matching-{uuid.uuid4().hex}"
    pairs.select("a", "b", "score").dropna().groupBy("a", "b").agg(F.max("score").alias("score")).write.parquet(f"{folder}/left-0")
    left, out = spark.read.parquet(f"{folder}/left-0"), None
    for n in range(1, MOST_ROUNDS + 1):
        if left.isEmpty():
            return out if out is not None else left
        # The same order for both sides: by score, then b, then a. So best pairs of a side cannot wait for each other in a circle.
        rank = F.struct((-F.col("score")).alias("s"), F.col("b").alias("b"), F.col("a").alias("a"))
        best_a = left.groupBy("a").agg(F.min(rank).alias("r")).select("r.a", "r.b")
        best_b = left.groupBy("b").agg(F.min(rank).alias("r")).select("r.a", "r.b")
        left.join(best_a, ["a", "b"], "left_semi").join(best_b, ["a", "b"], "left_semi").write.parquet(f"{folder}/matched-{n}")
        done = spark.read.parquet(f"{folder}/matched-{n}")
        out = done if out is None else out.unionByName(done)
        left.join(done.select("a"), "a", "left_anti").join(done.select("b"), "b", "left_anti").write.parquet(f"{folder}/left-{n}")
        left = spark.read.parquet(f"{folder}/left-{n}")
    raise RuntimeError(f"the matching is not complete after {MOST_ROUNDS} rounds")


def agreeing_edges(edges: DataFrame, reference: DataFrame, matching: DataFrame) -> DataFrame:
    """The edges (source, target, kind) whose ends are aligned with those of a reference edge of the same kind; each edge once."""
    to = lambda c: matching.select(F.col("a").alias(c), F.col("b").alias(f"{c}_"))
    named = edges.select("source", "target", "kind").distinct().join(to("source"), "source").join(to("target"), "target")
    there = reference.select(F.col("source").alias("source_"), F.col("target").alias("target_"), "kind").distinct()
    return named.join(there, ["source_", "target_", "kind"], "left_semi").select("source", "target", "kind")


def _scores(what: str, right: Column, found: Column, wanted: Column) -> list[Column]:
    over = lambda a, b: F.coalesce(a / F.nullif(b, F.lit(0)), F.lit(0.0))
    return [F.lit(what).alias("what"), right.alias("matched"), found.alias("found"), wanted.alias("wanted"), F.round(over(right, found), 6).alias("precision"), F.round(over(right, wanted), 6).alias("recall"), F.round(over(2 * right, found + wanted), 6).alias("f1")]


def accuracy(nodes: DataFrame, edges: DataFrame, reference_nodes: DataFrame, reference_edges: DataFrame, matching: DataFrame) -> DataFrame:
    """what ('entities', 'relations'), matched, found, wanted, precision, recall and F1; 0 where there is nothing to divide by."""
    count = lambda df, side, what: df.select(F.lit(what).alias("what"), F.lit(side).alias("side"))
    once = lambda e: e.select("source", "target", "kind").distinct()
    every = (
        count(matching, "right", "entities").unionAll(count(nodes.select("id").distinct(), "found", "entities")).unionAll(count(reference_nodes.select("id").distinct(), "wanted", "entities"))
        .unionAll(count(agreeing_edges(edges, reference_edges, matching), "right", "relations")).unionAll(count(once(edges), "found", "relations")).unionAll(count(once(reference_edges), "wanted", "relations"))
    )
    sums = every.groupBy("what").agg(*[F.count_if(F.col("side") == s).alias(s) for s in ("right", "found", "wanted")])
    rows = every.sparkSession.createDataFrame([("entities",), ("relations",)], "what string").join(sums, "what", "left").na.fill(0)
    return rows.select(F.col("what").alias("w"), "right", "found", "wanted").select(*[c if i else F.col("w").alias("what") for i, c in enumerate(_scores("", F.col("right"), F.col("found"), F.col("wanted")))])
