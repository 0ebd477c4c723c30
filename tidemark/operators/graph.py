"""Knowledge-graph operators over an entity table (id, kind, label, confidence) and an edge table (source, target, kind, confidence).

Iterative operators expand distinct frontiers by equi-joins and write each round to reliable storage, so
lineage stays short and a lost executor loses nothing; the driver sees counts only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.operators.joins import checkpointed, join_counted


def complete_edges(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Edges with both ends among the nodes."""
    ids = nodes.select("id")
    return edges.join(ids.withColumnRenamed("id", "source"), "source", "left_semi").join(ids.withColumnRenamed("id", "target"), "target", "left_semi")


def dangling_edges(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """The edges that the build drops."""
    ids = nodes.select("id")
    first = edges.join(ids.withColumnRenamed("id", "source"), "source", "left_anti")
    return first.unionByName(edges.join(ids.withColumnRenamed("id", "source"), "source", "left_semi").join(ids.withColumnRenamed("id", "target"), "target", "left_anti"))


def updated(nodes: DataFrame, edges: DataFrame, added: DataFrame, removed: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Insert the nodes that are absent, delete by id, and delete edges of deleted nodes."""
    fresh = added.join(nodes.select("id"), "id", "left_anti").dropDuplicates(["id"])
    left = nodes.unionByName(fresh).join(removed.select("id"), "id", "left_anti")
    gone = removed.select("id")
    cascade = edges.join(gone.withColumnRenamed("id", "source"), "source", "left_anti").join(gone.withColumnRenamed("id", "target"), "target", "left_anti")
    return left, cascade


def pruned(nodes: DataFrame, edges: DataFrame, least: float, most: int, min_degree: int) -> tuple[DataFrame, DataFrame]:
    """Nodes by confidence, the ``most`` best of them, edges between them, then nodes of a least degree, once."""
    kept = nodes.filter(F.col("confidence") >= least).orderBy(F.desc("confidence"), "id").limit(most)
    inner = complete_edges(edges, kept)
    ends = inner.select(F.col("source").alias("id")).unionAll(inner.select(F.col("target").alias("id")))
    enough = ends.groupBy("id").agg(F.count("*").alias("degree")).filter(F.col("degree") >= min_degree)
    final = kept.join(enough.select("id"), "id", "left_semi")
    return final, complete_edges(inner, final)


def page(nodes: DataFrame, edges: DataFrame, number: int, size: int) -> tuple[DataFrame, DataFrame, Column]:
    """One page of nodes by id, and the edges with both ends on it."""
    own = nodes.orderBy("id").offset((number - 1) * size).limit(size)
    return own, complete_edges(edges, own), F.ceil(F.count("*") / size)


def displayed(nodes: DataFrame) -> DataFrame:
    """Nodes of confidence .5 or more (1 where missing), a label of 20 characters, and sizes."""
    c = F.coalesce("confidence", F.lit(1.0))
    return nodes.filter(c >= 0.5).select("id", F.substring("label", 1, 20).alias("label"), F.round(c * 10, 6).alias("size"), F.round(c * 3, 6).alias("width"))


def merged_nodes(nodes: DataFrame) -> DataFrame:
    """Nodes by id: the first's kind and label, the greatest confidence; (source order in ``ord``)."""
    first = lambda c: F.min_by(c, "ord").alias(c)
    return nodes.groupBy("id").agg(first("kind"), first("label"), F.max("confidence").alias("confidence"), F.count("*").alias("sources"))


def distinct_edges(edges: DataFrame, directed: bool = True) -> DataFrame:
    """Edges once for each (source, target, kind); undirected edges have sorted ends."""
    a, b = (F.col("source"), F.col("target")) if directed else (F.least("source", "target"), F.greatest("source", "target"))
    return edges.groupBy(a.alias("source"), b.alias("target"), "kind").agg(F.max("confidence").alias("confidence"))


def degrees(edges: DataFrame) -> DataFrame:
    """Degrees of the simple undirected graph."""
    simple = edges.filter("source != target").select(F.least("source", "target").alias("a"), F.greatest("source", "target").alias("b")).distinct()
    return simple.select(F.explode(F.array("a", "b")).alias("id")).groupBy("id").agg(F.count("*").alias("degree"))


def structure(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """nodes, distinct undirected edges, mean degree, density."""
    one = F.lit(1).alias("one")
    simple = edges.filter("source != target").select(F.least("source", "target").alias("a"), F.greatest("source", "target").alias("b")).distinct()
    n, m = nodes.agg(F.count("*").alias("nodes")).select("nodes", one), simple.agg(F.count("*").alias("edges")).select("edges", one)
    return n.join(m, "one").select("nodes", "edges", F.round(2 * F.col("edges") / F.col("nodes"), 6).alias("avg_degree"), F.round(2 * F.col("edges") / F.nullif(F.col("nodes") * (F.col("nodes") - 1), F.lit(0)), 9).alias("density"))


def components(nodes: DataFrame, edges: DataFrame, most_rounds: int = 200) -> DataFrame:
    """(id, component): the least id that a node is connected with.

    Alternating stars: a node's greater neighbours go to the least of its neighbourhood, then a node and its lesser neighbours go to the least of
    them, until no edge changes. Rounds grow with the logarithm of the longest path; should they run out, that is an error. Stars of hubs are joined
    apart from the others, so no hub is one task's work; a row of counts a round reaches the driver.
    """
    stars = checkpointed(edges.filter("source != target").select(F.greatest("source", "target").alias("u"), F.least("source", "target").alias("v")).dropna().distinct())
    state = None
    for _ in range(most_rounds):
        both = stars.select("u", "v").unionAll(stars.select(F.col("v").alias("u"), F.col("u").alias("v")))
        centre = checkpointed(both.groupBy("u").agg(F.least("u", F.min("v")).alias("m"), F.count("*").alias("n")))
        large = checkpointed(join_counted(both.filter("v > u"), centre, "u", "n").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u != v").distinct())
        lower = large.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n"))
        # A node with one lesser neighbour, as nearly all have after the first round, needs no join.
        several = checkpointed(lower.filter("n > 1"))
        moved = join_counted(large, several, "u", "n").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u != v")
        stars = checkpointed(moved.unionAll(lower.select("u", F.col("m").alias("v"))).distinct())
        now = stars.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == state:
            break
        state = now
    else:
        raise RuntimeError(f"components are not settled after {most_rounds} rounds")
    return nodes.select("id").join(stars.select(F.col("u").alias("id"), F.col("v").alias("component")), "id", "left").select("id", F.coalesce("component", "id").alias("component"))


def reached(edges: DataFrame, seeds: DataFrame, hops: int, directed: bool = False) -> DataFrame:
    """(id, hop) of every node within so many hops of the seeds; each frontier is distinct."""
    step = edges.select("source", "target")
    if not directed:
        step = step.unionAll(edges.select(F.col("target").alias("source"), F.col("source").alias("target")))
    step = step.distinct()
    found = checkpointed(seeds.select("id").distinct().withColumn("hop", F.lit(0)))
    frontier = found
    for hop in range(1, hops + 1):
        new = frontier.join(step, F.col("id") == F.col("source")).select(F.col("target").alias("id")).distinct().join(found.select("id"), "id", "left_anti")
        frontier = checkpointed(new.withColumn("hop", F.lit(hop)))
        found = found.unionByName(frontier)
        if not frontier.limit(1).count():
            break
    return found


def term_subgraph(nodes: DataFrame, edges: DataFrame, query: str) -> tuple[DataFrame, DataFrame]:
    """The nodes whose label or kind holds a word of the query, their neighbours, and all edges between these; nothing for a blank query."""
    text, hit = F.lower(F.concat_ws(" ", "label", "kind")), F.lit(False)
    for term in dict.fromkeys(query.lower().split()):
        hit = hit | F.contains(text, F.lit(term))
    own = nodes.filter(hit).select("id")
    near = lambda a, b: edges.select(F.col(a).alias("id"), F.col(b).alias("other")).join(own, "id", "left_semi").select(F.col("other").alias("id"))
    every = own.unionAll(near("source", "target")).unionAll(near("target", "source")).distinct()
    kept = nodes.join(every, "id", "left_semi")
    return kept, complete_edges(edges, kept)


def paths(edges: DataFrame, starts: DataFrame, hops: int) -> DataFrame:
    """(start, id, path) of every node within so many directed hops: a shortest path as an array of ids, the first by order of ids.

    A frontier holds one path a start and node, so paths never multiply.
    """
    step = edges.select("source", "target").distinct()
    frontier = checkpointed(starts.select(F.col("id").alias("start"), "id", F.array("id").alias("path")).distinct())
    found = frontier
    for _ in range(hops):
        more = frontier.join(step, F.col("id") == F.col("source")).select("start", F.col("target").alias("id"), F.concat("path", F.array("target")).alias("path"))
        first = more.groupBy("start", "id").agg(F.min("path").alias("path")).join(found.select("start", "id"), ["start", "id"], "left_anti")
        frontier = checkpointed(first)
        found = found.unionByName(frontier)
        if not frontier.limit(1).count():
            break
    return found


def ontology_counts(nodes: DataFrame, edges: DataFrame, kinds: list[str], rules: DataFrame) -> DataFrame:
    """Valid entities (kind known) and valid edges (kind allows both ends' kinds); rules(kind, domain, range)."""
    good = nodes.agg(F.count("*").alias("entities"), F.count(F.when(F.col("kind").isin(*kinds), 1)).alias("valid_entities")).withColumn("one", F.lit(1))
    ends = edges.join(nodes.select(F.col("id").alias("source"), F.col("kind").alias("domain")), "source").join(nodes.select(F.col("id").alias("target"), F.col("kind").alias("range")), "target")
    valid = ends.join(F.broadcast(rules), ["kind", "domain", "range"], "left_semi").agg(F.count("*").alias("valid_edges")).withColumn("one", F.lit(1))
    total = edges.agg(F.count("*").alias("edges")).withColumn("one", F.lit(1))
    out = good.join(valid, "one").join(total, "one")
    return out.select("entities", "valid_entities", "edges", "valid_edges", F.round((F.col("valid_entities") + F.col("valid_edges")) / F.nullif(F.col("entities") + F.col("edges"), F.lit(0)), 6).alias("consistency"))


def completeness(df: DataFrame, by: str, required: list[str]) -> DataFrame:
    """present over required properties, by kind."""
    present = sum((F.when(F.col(c).isNotNull() & (F.col(c).cast("string") != ""), 1).otherwise(0) for c in required), F.lit(0))
    return df.groupBy(by).agg(F.count("*").alias("entities"), F.round(F.avg(present / len(required)), 6).alias("completeness"), *[F.count(c).alias(f"has_{c}") for c in required])


def contradictions(edges: DataFrame) -> DataFrame:
    """(source, kind, target) that occur more than once."""
    return edges.groupBy("source", "kind", "target").agg(F.count("*").alias("n")).filter("n > 1")


def cooccurring(mentions: DataFrame, reach: int = 50) -> DataFrame:
    """Pairs of mentions of a document whose gap is at most ``reach``; mentions(doc_id, ent, start, end).

    A range join by bins: each mention looks into its own bin and the next, so a document's mentions are never
    all paired. Confidence is max(.5, 1 - gap / reach).
    """
    left = mentions.select("doc_id", F.col("ent").alias("a"), F.col("start").alias("a_start"), F.col("end").alias("a_end")).withColumn("bin", F.explode(F.array(F.floor(F.col("a_end") / reach), F.floor(F.col("a_end") / reach) + 1)))
    right = mentions.select("doc_id", F.col("ent").alias("b"), F.col("start").alias("b_start"), F.floor(F.col("start") / reach).alias("bin"))
    gap = F.col("b_start") - F.col("a_end")
    return left.join(right, ["doc_id", "bin"]).filter((F.col("b_start") > F.col("a_start")) & (gap >= 0) & (gap <= reach)).select("doc_id", "a", "b", gap.alias("gap"), F.round(F.greatest(F.lit(0.5), 1 - gap / reach), 6).alias("confidence"))
