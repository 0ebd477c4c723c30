"""Entity resolution: weighted similarity of entities, clusters in two phases, and merging of a cluster's records.

Records are merged by keys, not by collected clusters: each property and reference finds its own winner in a grouped
aggregate, so a cluster may have any number of members.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.operators.stateful import greedy_clusters

# Weights of labels, properties and embeddings.
LABEL, PROPERTY, EMBEDDING = 0.5, 0.3, 0.2


def entity_similarity(kinds: tuple[Column, Column], label: Column, properties: Column, embedding: Column | None = None) -> Column:
    """0 for known kinds that differ; else the weighted mean of the similarities, the weights of those that are there made to add up to 1."""
    a, b = (F.lower(F.coalesce(k, F.lit("unknown"))) for k in kinds)
    parts = [(LABEL, label), (PROPERTY, properties)] + ([(EMBEDDING, embedding)] if embedding is not None else [])
    total = sum((w / sum(w for w, _ in parts) * x for w, x in parts), F.lit(0.0))
    return F.when((a != "unknown") & (b != "unknown") & (a != b), 0.0).otherwise(total)


def numeric_similarity(a: Column, b: Column) -> Column:
    """1 - |a - b| / max(|a|, |b|); 1 for two zeros."""
    most = F.greatest(F.abs(a), F.abs(b))
    return F.when(most > 0, 1.0 - F.abs(a - b) / most).otherwise(1.0)


def resolved_in_batches(entities: DataFrame, block: str, key: str, label: str, least: float, batches: int) -> DataFrame:
    """Clusters within (block, batch) first, then clusters of their seeds within the block: block, key, seed."""
    dealt = entities.select(F.struct(F.col(block).alias("b"), F.pmod(F.xxhash64(key), F.lit(batches)).cast("int").alias("batch")).alias("part"), block, key, label)
    first = greedy_clusters(dealt, "part", key, label, least).select(F.col("part.b").alias(block), key, F.col("seed").alias("own"))
    seeds = entities.join(first.filter(F.col(key) == F.col("own")).select(key), key, "left_semi")
    second = greedy_clusters(seeds, block, key, label, least).select(F.col(key).alias("own"), "seed")
    return first.join(second, "own").select(block, key, "seed")


def merged_properties(entities: DataFrame) -> DataFrame:
    """(cluster, property, value) of merged records; entities(cluster, id, properties).

    The record with the most properties is the base, then the next, ties to the smaller id; the first value of a property stays.
    """
    rank = F.struct(-F.size("properties"), F.col("id"))
    each = entities.select("cluster", rank.alias("rank"), F.explode("properties").alias("property", "value")).filter("value IS NOT NULL")
    return each.groupBy("cluster", "property").agg(F.min_by("value", "rank").alias("value"))


def merged_references(references: DataFrame) -> DataFrame:
    """(cluster, source, ref, confidence): each external reference once, with its greatest confidence."""
    return references.groupBy("cluster", "source", "ref").agg(F.max("confidence").alias("confidence"))


def merged_records(entities: DataFrame) -> DataFrame:
    """Cluster, base (the most complete record's id), merged (members), and the merged properties as a map."""
    heads = entities.groupBy("cluster").agg(F.min_by("id", F.struct(-F.size("properties"), F.col("id"))).alias("base"), F.count("*").alias("merged"))
    # A record has as many properties as there are names, however many members the cluster has.
    maps = merged_properties(entities).groupBy("cluster").agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("property", "value")))).alias("properties"))
    return heads.join(maps, "cluster", "left")


def best_match(matches: DataFrame, by: str, key: str, score: str) -> DataFrame:
    """The match of the best score of each entity, ties to the smaller key."""
    return matches.groupBy(by).agg(F.max_by(key, F.struct(F.col(score), -F.col(key))).alias(key), F.max(score).alias(score))


def distinct_titles(results: DataFrame, block: str, key: str, exact: str, title: str, score: str, least: float = 0.85) -> DataFrame:
    """One result an exact identifier, then one a cluster of alike titles, best score first."""
    w = Window.partitionBy(block, exact).orderBy(F.desc(score), key)
    once = results.withColumn("_r", F.row_number().over(w)).filter("_r = 1").drop("_r")
    seeds = greedy_clusters(once, block, key, title, least).filter(F.col(key) == F.col("seed")).select(key)
    return once.join(seeds, key, "left_semi")
