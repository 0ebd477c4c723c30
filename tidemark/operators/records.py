"""Record operators: links between documents and entities, claims, ontology checks, merging of results, selection."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def both_indexes(links: DataFrame, a: str, b: str) -> tuple[DataFrame, DataFrame]:
    """The number of distinct partners from either side of a link table."""
    once = links.select(a, b).distinct()
    return once.groupBy(a).agg(F.count("*").alias("n")), once.groupBy(b).agg(F.count("*").alias("n"))


def relevance(label: Column, properties: list[Column], terms: list[str], mentions: dict[str, float], type_weight: Column) -> Column:
    """.7 times the confidence of mentions that share the label, .5 a term in the label, .3 a term in a property, times the type's weight, at most 1."""
    low, total = F.lower(label), F.lit(0.0)
    for mention, confidence in mentions.items():
        total = total + F.when(F.contains(low, F.lit(mention.lower())) | F.contains(F.lit(mention.lower()), low), 0.7 * confidence).otherwise(0.0)
    for term in terms:
        total = total + F.when(F.contains(low, F.lit(term.lower())), 0.5).otherwise(0.0)
        for p in properties:
            total = total + F.when(F.contains(F.lower(p.cast("string")), F.lit(term.lower())), 0.3).otherwise(0.0)
    return F.least(F.lit(1.0), total * type_weight)


def relevant_subgraph(nodes: DataFrame, edges: DataFrame, n: int = 10, least: float = 0.3, edge_least: float = 0.4) -> DataFrame:
    """Edges whose ends are both among the n best nodes above a score, and whose mean score passes."""
    best = nodes.filter(F.col("score") > least).orderBy(F.desc("score"), "id").limit(n).select("id", "score")
    a, b = best.select(F.col("id").alias("source"), F.col("score").alias("sa")), best.select(F.col("id").alias("target"), F.col("score").alias("sb"))
    out = edges.join(F.broadcast(a), "source").join(F.broadcast(b), "target")  # n rows each
    return out.withColumn("score", F.round((F.col("sa") + F.col("sb")) / 2, 6)).filter(F.col("score") > edge_least).select("source", "target", "score")


def label_support(texts: DataFrame, key: str, text: str, labels: DataFrame, label: str, needle: str, most: int = 1000) -> DataFrame:
    """(label, support): in how many texts each label's needle occurs; a text is searched once, for all needles.

    labels holds at most ``most`` rows (an ontology's), which become one pattern; overlapping needles are found by looking ahead.
    """
    known = [r[0] for r in labels.select(needle).distinct().limit(most + 1).collect()]
    if len(known) > most:
        raise ValueError(f"more than {most} labels")
    # Needles of one length at a time: a look-ahead finds those that overlap.
    found = F.lit(None).cast("array<string>")
    for n in sorted({len(k) for k in known}):
        pattern = "(?=(" + "|".join(re.escape(k) for k in sorted(known) if len(k) == n) + "))"
        here = F.array_distinct(F.regexp_extract_all(text, F.lit(pattern), F.lit(1)))
        found = here if n == min(map(len, known)) else F.concat(found, here)
    met = texts.select(key, F.explode(found).alias(needle))
    return met.join(labels.select(label, needle), needle).groupBy(label).agg(F.count("*").alias("support"))


def claim_status(verified: Column, contradicted: Column, total: Column) -> Column:
    """invalid where contradictions exceed .3, valid from .7 verified, else uncertain; valid without claims."""
    v, c = verified / F.nullif(total, F.lit(0)), contradicted / F.nullif(total, F.lit(0))
    return F.when(total == 0, "valid").when(c > 0.3, "invalid").when(v >= 0.7, "valid").otherwise("uncertain")


def repeated(claims: DataFrame, claim: str, group: str) -> DataFrame:
    """claims of a group that occur more than once."""
    return claims.groupBy(group, claim).agg(F.count("*").alias("n")).filter("n > 1")


def merged_results(parts: DataFrame, key: str, text: str, confidence: str, position: str) -> DataFrame:
    """texts joined in order, confidence weighted by length, and its plain mean."""
    n = F.length(text)
    joined = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct(F.col(position).alias("p"), F.col(text).alias("t")))), lambda x: x["t"]), "\n")
    return parts.groupBy(key).agg(F.md5(joined).alias("text_md5"), F.round(F.sum(F.col(confidence) * n) / F.nullif(F.sum(n), F.lit(0)), 6).alias("weighted"), F.round(F.avg(confidence), 6).alias("mean"))


def with_alternatives(scores: DataFrame, by: str, item: str, score: str) -> DataFrame:
    """The best item of each key, and the next two with their distance from it."""
    w = Window.partitionBy(by).orderBy(F.desc(score), item)
    ranked = scores.withColumn("rank", F.row_number().over(w)).withColumn("best", F.max(score).over(Window.partitionBy(by))).filter("rank <= 3")
    return ranked.select(by, item, "rank", F.round(F.col("best") - F.col(score), 6).alias("gap"))


def resolution_report(members: DataFrame, kind: str, cluster: str) -> DataFrame:
    """members, clusters, merged members and the reduction in percent, by kind."""
    return members.groupBy(kind).agg(F.count("*").alias("before"), F.countDistinct(cluster).alias("after")).select(kind, "before", "after", (F.col("before") - F.col("after")).alias("merged"), F.round(100.0 * (F.col("before") - F.col("after")) / F.col("before"), 6).alias("reduction_pct"))


def language_runs(turns: DataFrame, by: str, at: str, language: Column) -> DataFrame:
    """Consecutive rows of equal language as one run."""
    w = Window.partitionBy(by).orderBy(at)
    marked = turns.withColumn("_l", language).withColumn("_new", F.when(F.col("_l") == F.lag("_l").over(w), 0).otherwise(1)).withColumn("_run", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return marked.groupBy(by, F.col("_run").alias("run")).agg(F.min("_l").alias("language"), F.count("*").alias("n"))


def byte_ranges(size: Column, chunk: int) -> Column:
    """ceil(size / chunk) ranges of bytes."""
    n = F.ceil(size / chunk).cast("int")
    return F.when(n > 0, F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.struct((i * chunk).alias("start"), F.least((i + 1) * chunk, size).alias("end")))).otherwise(F.array().cast("array<struct<start:int,end:int>>"))
