"""Temperature mixing of sources to target weights (operator 4, native).

A source's share p of all tokens becomes the weight p ** a, normalised. The exponent a in [0, 1] is bisected:
to the target entropy (as a share of the greatest possible), and then, where a source would be repeated too
often, to the repetition limit. Weights times the token budget are the sources' targets. They are realised by
block permutations: a source's documents are dealt into blocks of about ``block_docs`` by a keyed hash; a full
epoch takes every block; the last, partial epoch takes blocks in an order permuted by a keyed hash of the
epoch, and of the block at the budget's edge the documents of least hash that still fit.

Only counts by (source, block) meet in a window; documents are never sorted. The exponent is found by rounds: Spark
sums the powered shares over all sources for a grid of exponents between the ends so far, and the driver,
which sees a few sums a grid point, keeps the interval where the limit is crossed. Seven halvings are one round. However many
sources there are, they are never gathered.

Defined cases: a null text has no tokens; a null source and the empty one are the same source; documents of no tokens ride
with their block; documents that are repeated rows of one doc_id are taken or left together, as are those of equal
hash (ties); a text of any length counts whole and is never cut to fit; extra columns travel in one struct, whatever their
names; an empty table gives an empty result; with a single source its weight is 1.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.common import WORD, broadcast_if_small, free_names, stored, unit_hash

#: Halvings of the exponent, and of one round.
STEPS, ROUND = 50, 7


def _point(low: float, high: float, parts: int, i):
    """The i-th of ``parts`` points from the low end; the same arithmetic here and in Spark."""
    return low + (high - low) * i / float(parts)


def _sums(shares: DataFrame, grids: dict[str, tuple[float, float, int]]) -> dict[tuple[str, int], tuple[float, float, float]]:
    """For each grid (low, high, points) and place in it the sums over sources of p ** a and p ** a * ln p, and the greatest p ** (a - 1); shares(p)."""
    grid = lambda g, low, high, parts: F.transform(F.sequence(F.lit(0), F.lit(parts - 1)), lambda i: F.struct(F.lit(g).alias("g"), i.alias("i"), _point(F.lit(low), F.lit(high), parts, i).alias("a")))
    points = F.concat(*[grid(g, *ends) for g, ends in grids.items()])
    each = shares.select(F.ln("p").alias("l"), F.explode(points).alias("x")).select("l", "x.*").withColumn("q", F.exp(F.col("a") * F.col("l")))
    found = each.groupBy("g", "i").agg(F.sum("q"), F.sum(F.col("q") * F.col("l")), F.max(F.exp((F.col("a") - 1) * F.col("l"))))
    return {(r[0], r[1]): (r[2], r[3], r[4]) for r in found.collect()}


def exponents(totals: DataFrame, entropy: float | None, repetition: float | None, budget: int | None = None, whole: bool = False) -> tuple[int, float, float, float]:
    """All tokens, the exponent, the sum of the powered shares, and the largest share; totals(tokens) are stored, one row a source."""
    total, n, most = totals.filter("tokens > 0").agg(F.sum("tokens"), F.count("*"), F.max("tokens")).first()
    if not n:
        return 0, 0.0, 0.0, 0.0
    largest = most / total
    shares = totals.filter("tokens > 0").select((F.col("tokens") / F.lit(float(total))).alias("p"))

    def by_entropy(a: float, z: float, s: float, top: float) -> bool:
        return math.log(z) - a * s / z > entropy * math.log(n)

    def by_limit(a: float, z: float, s: float, top: float) -> bool:
        """Whether the most repeated source comes too often: for the budget, or with the largest source once."""
        often = top / math.exp((a - 1) * math.log(largest)) if whole else top / z * (1.0 if budget is None else budget / total)
        return often > repetition

    rules = {k: f for k, f, given in (("entropy", by_entropy, entropy), ("limit", by_limit, repetition)) if given is not None}
    # Flatness falls as the exponent grows: the least exponent in [0, 1] that is not too flat, as 50 halvings find it.
    ends = dict.fromkeys(rules, (0.0, 1.0))
    done = 0
    while done < STEPS and rules:
        parts = 1 << min(ROUND, STEPS - done)
        sums = _sums(shares, {k: (*pair, parts) for k, pair in ends.items()})
        for k, (low, high) in ends.items():
            grid = [_point(low, high, parts, i) for i in range(parts)]
            flat = [i for i, a in enumerate(grid) if rules[k](a, *sums[k, i])]
            if not done and 0 not in flat:
                ends[k] = (0.0, 0.0)
            else:
                at = max(flat, default=0)
                ends[k] = (grid[at], [*grid, high][at + 1])
        done += parts.bit_length() - 1
    a = max([0.0, *[high for _, high in ends.values()]])
    return int(total), a, _sums(shares, {"a": (a, a, 1)})["a", 0][0], largest


def plan(docs: DataFrame, entropy: float | None, repetition: float | None, budget: int | None, whole: bool, block_docs: int, seed: str) -> tuple[DataFrame, DataFrame]:
    """(documents with ``_h`` and ``_block``, blocks with what is taken of each).

    docs has _source, _id, _tokens and a payload. A block row has _full (whole epochs), _rank (its place in the
    partial epoch) and _cut: null where the partial epoch leaves it out, else the greatest hash taken.
    ``whole`` raises the budget until every source is taken whole at least once.
    """
    counted = docs.groupBy("_source").agg(F.sum("_tokens").alias("tokens"), F.count("*").alias("docs"))
    totals = stored(counted, "totals")
    total, a, z, largest = exponents(totals, entropy, repetition, budget, whole)
    weight = F.exp(F.lit(a) * F.ln(F.col("tokens") / F.lit(float(total or 1)))) / F.lit(z or 1.0)
    given = float(total if budget is None else budget)
    # The largest source has the least weight over share; this budget takes it exactly once.
    if whole and total:
        given = float(math.ceil(total * largest * z / math.exp(a * math.log(largest))))
    goal = F.when(F.col("tokens") > 0, F.floor(weight * given + 1e-6).cast("long")).otherwise(F.lit(0).cast("long"))
    goals = totals.select("_source", "tokens", F.ceil(F.col("docs") / block_docs).cast("long").alias("blocks"), goal.alias("goal"), weight.alias("weight"))
    goals = broadcast_if_small(stored(goals, "goals"))
    h = unit_hash(seed, F.col("_source"), F.col("_id"))
    dealt = docs.withColumn("_h", h).join(goals.select("_source", F.col("blocks").alias("_blocks")), ["_source"])
    dealt = dealt.withColumn("_block", F.pmod("_h", "_blocks")).drop("_blocks")
    blocks = dealt.groupBy("_source", "_block").agg(F.sum("_tokens").alias("n"))
    full = F.when(F.col("tokens") > 0, F.floor(F.col("goal") / F.nullif(F.col("tokens"), F.lit(0)))).otherwise(F.lit(1)).cast("long")
    order = Window.partitionBy("_source").orderBy(unit_hash(seed, F.col("_source"), F.col("_full"), F.col("_block")), "_block")
    ranked = (
        blocks.join(goals, ["_source"])
        .withColumn("_full", full)
        .withColumn("left", F.when(F.col("tokens") > 0, F.col("goal") - F.col("_full") * F.col("tokens")).otherwise(0))
        .withColumn("_rank", F.row_number().over(order) - 1)
        .withColumn("before", F.coalesce(F.sum("n").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
        .select("_source", "_block", "_full", "_rank", "n", (F.col("left") - F.col("before")).alias("room"), "weight", "goal")
    )
    ranked = stored(ranked, "blocks")
    # One block a source lies on the edge: of its documents, those of least hash that fit.
    edge = ranked.filter("room > 0 AND room < n").select("_source", "_block", "room")
    within = Window.partitionBy("_source").orderBy("_h")
    cut = (
        dealt.join(broadcast_if_small(edge), ["_source", "_block"])
        .groupBy("_source", "_block", "room", "_h")
        .agg(F.sum("_tokens").alias("n"))
        .withColumn("upto", F.sum("n").over(within))
        .filter("upto <= room")
        .groupBy("_source", "_block")
        .agg(F.max("_h").alias("edge_cut"))
    )
    taken = ranked.join(broadcast_if_small(stored(cut, "cut")), ["_source", "_block"], "left").withColumn("_cut", F.when((F.col("room") > 0) & (F.col("room") >= F.col("n")), F.lit((1 << 60))).otherwise(F.col("edge_cut")))
    return dealt, stored(taken.select("_source", "_block", "_full", "_rank", "_cut", "weight", "goal"), "taken")


def _named(docs: DataFrame, payload: list[Column]) -> DataFrame:
    tokens = F.regexp_count(F.coalesce("text", F.lit("")), F.lit(WORD)).cast("long")
    return docs.select(F.coalesce("source", F.lit("")).alias("_source"), F.col("doc_id").alias("_id"), tokens.alias("_tokens"), *payload)


def _copies(dealt: DataFrame, taken: DataFrame) -> DataFrame:
    """A row for each time that a document is taken, with its ``_epoch`` and its block's rank in the partial epoch."""
    n = F.col("_full") + F.when(F.col("_h") <= F.col("_cut"), 1).otherwise(0)
    joined = dealt.join(broadcast_if_small(taken, 200_000), ["_source", "_block"])
    return joined.withColumn("_n", n).filter("_n > 0").withColumn("_epoch", F.explode(F.sequence(F.lit(0).cast("long"), F.col("_n") - 1)))


def mixture(docs: DataFrame, entropy: float | None = 0.95, repetition: float | None = 4.0, budget: int | None = None, block_docs: int = 1024, seed: str = "mix") -> DataFrame:
    """What the mixture takes: doc_id, source, n_tokens, epoch, block, and the block's place in the partial epoch (else null)."""
    named = stored(_named(docs, []), "tokens")
    dealt, taken = plan(named, entropy, repetition, budget, False, block_docs, seed)
    place = F.when(F.col("_epoch") == F.col("_full"), F.col("_rank"))
    return _copies(dealt, taken).select(F.col("_id").alias("doc_id"), F.col("_source").alias("source"), F.col("_tokens").alias("n_tokens"), F.col("_epoch").alias("epoch"), F.col("_block").alias("block"), place.cast("int").alias("place"))


def mixed(docs: DataFrame, entropy: float | None = 0.95, repetition: float | None = 2.0, budget: int | None = None, whole: bool = True, block_docs: int = 1024, seed: str = "mix") -> DataFrame:
    """The documents of the mixture with their own columns, repeated as the weights ask. By default none is left out."""
    (box,) = free_names(docs, "_row")
    named = _named(docs, [F.struct(*docs.columns).alias(box)])
    light = stored(_named(docs, []), "tokens")
    _, taken = plan(light, entropy, repetition, budget, whole, block_docs, seed)
    counts = light.groupBy("_source").agg(F.ceil(F.count("*") / block_docs).cast("long").alias("_blocks"))
    dealt = named.withColumn("_h", unit_hash(seed, F.col("_source"), F.col("_id"))).join(broadcast_if_small(stored(counts, "counts")), ["_source"]).withColumn("_block", F.pmod("_h", "_blocks"))
    return _copies(dealt, taken).select(f"{box}.*")
