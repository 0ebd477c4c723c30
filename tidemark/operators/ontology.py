"""Checks and suggestions against an ontology: kinds(kind, required, optional) and edge kinds(kind, sources, targets), both small tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def checked_entities(entities: DataFrame, kinds: DataFrame) -> DataFrame:
    """entities(id, kind, properties array) with ``valid`` and the required properties that are missing; an unknown kind is not valid."""
    met = entities.join(kinds.select("kind", "required"), "kind", "left")
    missing = F.array_except("required", "properties")
    return met.select("id", "kind", (F.col("required").isNotNull() & (F.size(missing) == 0)).alias("valid"), F.coalesce(F.array_join(missing, ","), F.lit("")).alias("missing"))


def checked_edges(edges: DataFrame, nodes: DataFrame, rules: DataFrame) -> DataFrame:
    """Edges with ``valid``: the kind is known and takes both ends' kinds; an empty list takes every kind."""
    ends = edges.join(nodes.select(F.col("id").alias("source"), F.col("kind").alias("_from")), "source").join(nodes.select(F.col("id").alias("target"), F.col("kind").alias("_to")), "target")
    met = ends.join(rules, "kind", "left")
    takes = lambda side, of: (F.size(side) == 0) | F.array_contains(side, F.col(of))
    return met.select("source", "target", "kind", F.coalesce(takes("sources", "_from") & takes("targets", "_to"), F.lit(False)).alias("valid"))


def _share(own: Column, of: Column) -> Column:
    return F.coalesce(F.size(F.array_intersect(own, of)) / F.nullif(F.size(of), F.lit(0)), F.lit(0.0))


def suggested_kinds(entities: DataFrame, kinds: list[tuple[str, list[str], list[str]]]) -> DataFrame:
    """(id, kind, score, rank): .7 of the required and .3 of the optional properties that an entity has, for each kind of the ontology, best first."""
    array = lambda names: F.array(*map(F.lit, names)).cast("array<string>")
    table = F.array(*[F.struct(F.lit(k).alias("kind"), array(r).alias("required"), array(o).alias("optional")) for k, r, o in kinds])
    each = entities.select("id", "properties", F.explode(table).alias("k")).select("id", F.col("k.kind").alias("kind"), F.round(0.7 * _share(F.col("properties"), F.col("k.required")) + 0.3 * _share(F.col("properties"), F.col("k.optional")), 9).alias("score"))
    best = F.sort_array(F.collect_list(F.struct((-F.col("score")).alias("s"), F.col("kind").alias("kind"))))
    ranked = each.groupBy("id").agg(best.alias("b")).select("id", F.posexplode("b").alias("rank", "b"))
    return ranked.select("id", F.col("b.kind").alias("kind"), F.abs(F.col("b.s")).alias("score"), (F.col("rank") + 1).alias("rank"))


def suggested_edges(pairs: DataFrame, rules: DataFrame) -> DataFrame:
    """For pairs (source_kind, target_kind) the edge kinds that take both, with .5 (1/|sources| + 1/|targets|), .3 for one without limits."""
    ends = pairs.select("source_kind", "target_kind").distinct()
    takes = lambda side, of: (F.size(side) == 0) | F.array_contains(side, F.col(of))
    # Kinds of both sides and the rules are ontology-sized: each rule lists the pairs that it takes.
    listed = rules.filter((F.size("sources") > 0) & (F.size("targets") > 0)).select("kind", F.explode("sources").alias("source_kind"), "targets", F.size("sources").alias("ns"), F.size("targets").alias("nt"))
    listed = listed.select("kind", "source_kind", F.explode("targets").alias("target_kind"), F.round(0.5 * (1 / F.col("ns") + 1 / F.col("nt")), 9).alias("score"))
    strict = ends.join(listed, ["source_kind", "target_kind"]).select("source_kind", "target_kind", "kind", "score")
    open_ = rules.filter((F.size("sources") == 0) | (F.size("targets") == 0)).withColumn("one", F.lit(1))
    loose = ends.withColumn("one", F.lit(1)).join(open_, "one").filter(takes("sources", "source_kind") & takes("targets", "target_kind")).select("source_kind", "target_kind", "kind", F.lit(0.3).alias("score"))
    return strict.unionByName(loose)


def checked_hyperedges(incidence: DataFrame, nodes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(edges whose nodes all exist, with their size; edges that are refused, with the number of unknown nodes); incidence(edge, node)."""
    once = incidence.select("edge", "node").distinct()
    known = once.join(nodes.select("node").distinct().withColumn("_known", F.lit(1)), "node", "left")
    sizes = known.groupBy("edge").agg(F.count("*").alias("size"), F.count_if(F.col("_known").isNull()).alias("unknown"))
    return sizes.filter("unknown = 0").select("edge", "size"), sizes.filter("unknown > 0").select("edge", "unknown")
