"""Search over messages, documents and cached results; rank fusion, merging and deduplication of result lists."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def has(column: str, term: str) -> Column:
    """Case-insensitive containment."""
    return F.contains(F.lower(F.col(column)), F.lit(term.lower()))


def top(df: DataFrame, n: int, *order: Column) -> DataFrame:
    """The n first rows by an order: Spark keeps n rows a task and merges them."""
    return df.orderBy(*order).limit(n)


def search_messages(messages: DataFrame, term: str, role: str, n: int = 20) -> DataFrame:
    """A speaker's messages that contain a term, newest first."""
    return top(messages.filter(has("text", term) & (F.col("role") == role)), n, F.desc("conv_id"), F.desc("turn")).select("conv_id", "turn", "role")


def session_counts(messages: DataFrame, term: str) -> DataFrame:
    """Conversations whose first message contains a term, with their number of messages: one aggregation, no correlated count."""
    first = F.min_by("text", "turn")
    return messages.groupBy("conv_id").agg(first.alias("title"), F.count("*").alias("messages")).filter(has("title", term)).select("conv_id", "messages")


def dispatched(parts: dict[str, DataFrame]) -> DataFrame:
    """Results of several content types in one table, with their count by type."""
    out = None
    for kind, part in parts.items():
        own = part.select(F.lit(kind).alias("kind"), F.col(part.columns[0]).cast("long").alias("id"))
        out = own if out is None else out.unionByName(own)
    return out


def nested(column: str, path: str, default: str | None = None) -> Column:
    """A dotted path of a JSON column as text; null, or a default, where it is missing."""
    found = F.get_json_object(column, f"$.{path}")
    return found if default is None else F.coalesce(found, F.lit(default))


def mapped(df: DataFrame, fields: dict[str, str], column: str, limit: int = 200) -> DataFrame:
    """Fields of a JSON column under new names, '' where missing, cut to a length."""
    return df.select("*", *[F.substring(nested(column, path, ""), 1, limit).alias(name) for name, path in fields.items()])


def threads(messages: DataFrame) -> DataFrame:
    """For each root message (first turn) the number of direct replies (the next turn)."""
    roots = messages.filter("turn = 0").select("conv_id", F.col("role").alias("root_role"))
    replies = messages.filter("turn = 1").groupBy("conv_id").agg(F.count("*").alias("replies"))
    return roots.join(replies, "conv_id", "left").select("conv_id", "root_role", F.coalesce("replies", F.lit(0)).alias("replies"))


def distinct_content(df: DataFrame, key: str, content: str) -> DataFrame:
    """One row for each content, the first by key; grouped on a digest, so texts are not shuffled."""
    return df.select(key, F.md5(content).alias("digest")).groupBy("digest").agg(F.min(key).alias(key), F.count("*").alias("copies"))


def distinct_link(df: DataFrame, key: str, link: str) -> DataFrame:
    """One row for each link, the first by key; rows without a link go."""
    return df.filter(F.col(link).isNotNull()).groupBy(link).agg(F.min(key).alias(key))


def rank_fusion(ranked: DataFrame, item: str, k: int = 60) -> DataFrame:
    """Reciprocal rank fusion over lists: the sum of 1 / (k + rank) of each item."""
    return ranked.groupBy(item).agg(F.round(F.sum(1.0 / (k + F.col("rank"))), 9).alias("score"), F.count("*").alias("lists"))


def similarity_fusion(results: DataFrame, item: str, similarity: str, k: int = 60) -> DataFrame:
    """The variant that takes a rank from similarity: 1 / (k + max(1, floor(10 (1 - s)))), the best of each item."""
    rank = F.greatest(F.lit(1), F.floor((1 - F.col(similarity)) * 10))
    return results.groupBy(item).agg(F.round(F.max(1.0 / (k + rank)), 9).alias("score"))


def merged_scores(graph: DataFrame, vectors: DataFrame, key: str) -> DataFrame:
    """max(graph score) * .7 + (1 - i / n) * .3 by rank in the vector list, outer."""
    best = graph.groupBy(key).agg(F.max("score").alias("g"))
    score = F.coalesce(F.col("g") * 0.7, F.lit(0.0)) + F.coalesce((1 - F.col("i") / F.col("n")) * 0.3, F.lit(0.0))
    return best.join(vectors, key, "full").select(key, F.round(score, 6).alias("score"))


def hybrid(vectors: DataFrame, graph: DataFrame, key: str, n: int = 10) -> DataFrame:
    """(10 - rank) / 10 of both lists weighted .7 and .3, outer, the n best."""
    part = lambda c: F.greatest(F.lit(0.0), (10 - F.col(c)) / 10)
    both = vectors.select(key, F.col("rank").alias("v")).join(graph.select(key, F.col("rank").alias("g")), key, "full")
    score = 0.7 * F.coalesce(part("v"), F.lit(0.0)) + 0.3 * F.coalesce(part("g"), F.lit(0.0))
    return top(both.select(key, F.round(score, 6).alias("score")), n, F.desc("score"), F.col(key))


def unpivoted_ranks(rows: DataFrame, model: str, metrics: list[str], lower_is_better: tuple[str, ...] = ("_ms", "_cost")) -> DataFrame:
    """Per metric and model the sum over ALL rows (missing counts as 0), sample deviation (0 for one row), and a rank.

    Metrics whose name ends in one of the suffixes rank ascending. Sums are exact over values of at most twelve decimals, so a mean that lies
    between two roundings goes up whatever the order of the rows; a group with a value that is no such number (1e16 and more, infinite) is summed in double.
    """
    long = rows.unpivot([model], metrics, "metric", "x").withColumn("d", F.col("x").try_cast("decimal(28,12)"))
    all_exact = F.count("x") == F.count("d")
    mean = F.when(all_exact, F.round(F.coalesce(F.sum("d"), F.lit(0)) / F.count("*"), 6).cast("double")).otherwise(F.round(F.sum(F.coalesce("x", F.lit(0.0))) / F.count("*"), 6))
    present = F.when(all_exact, F.round(F.sum("d") / F.count("d"), 6).cast("double")).otherwise(F.round(F.avg("x"), 6))
    stats = long.groupBy("metric", model).agg(mean.alias("mean"), F.round(F.coalesce(F.stddev_samp("x"), F.lit(0.0)), 4).alias("std"), present.alias("avg_present"))
    up = F.lit(False)
    for suffix in lower_is_better:
        up = up | F.col("metric").endswith(suffix)
    order = F.when(up, F.col("mean")).otherwise(-F.col("mean"))
    return stats.withColumn("rank", F.row_number().over(Window.partitionBy("metric").orderBy(order, model)))


def previous_run(runs: DataFrame) -> DataFrame:
    """Each run's mean with the latest run before it as its baseline, and the change in percent."""
    before = F.lag("mean").over(Window.orderBy("run"))  # one row a run
    return runs.withColumn("baseline", before).select("run", "mean", "baseline", F.round(100.0 * (F.col("mean") - F.col("baseline")) / F.nullif(F.col("baseline"), F.lit(0.0)), 4).alias("change_pct"))
