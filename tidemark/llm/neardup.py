"""Near-duplicates by shingle similarity, for the pipeline: operator 7 with candidates completed and links verified.

Two documents are linked where the Jaccard similarity of their sets of ``size``-word shingles (64-bit hashes) is
``least`` or more; of each component one document stays. Texts with the same shingle set are one node from the start.

Candidates come from operator 7's Gray index over SimHash fingerprints of the shingles. Its reach of three bits finds a
part of the pairs only: at a similarity of .8 about ten of 64 bits differ, and no exact index is that wide. The rest comes
from MinHash bands (20 bands of 5 least values: a pair at .8 is missed with chance 4e-4, at .9 with 1e-8).

A bucket's nodes gather around its centre, the node of least keyed hash; the buckets of a cluster mostly have the same
centre, so a node joins few groups. Each node is compared in the largest of its groups first; after that only groups with nodes of several
components are compared. A group is one task; a task compares all pairs of its nodes on their whole sets, by products
of token matrices, and returns a spanning star for each component: candidate pairs never become rows. A group of more than ``MOST``
nodes or ``MOST_TOKENS`` shingles is compared in chunks: first all its nodes with some pivots, again with new pivots as long as
that joins enough; then the nodes outside the group's largest component with all nodes of the group. Pairs inside one component
are not compared, as they are joined already; all others are, so no link between components is lost. In a group of near copies nearly all nodes
hang on the pivots, and what is sent to tasks grows with its nodes. It grows with their square only in the nodes that
are similar to few others, beyond ``MOST`` of them.

Defined cases: null and blank texts have an empty set and are alike; shorter texts than a shingle are one shingle;
texts of any length are hashed whole; null doc_ids, repeated rows, empty tables and extra columns as in operator 7.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm import simhash
from tidemark.llm.common import broadcast_if_small, join_hot, small_enough, stored

SIZE, LEAST = 5, 0.8
BANDS, ROWS = 20, 5
#: Most nodes and shingles of a tile, and most columns of a token matrix.
MOST, MOST_TOKENS, SLAB = 2048, 2_000_000, 2048
#: Most pivots of a large group, and most rounds of pivots.
PIVOTS, PIVOT_ROUNDS = 128, 6
#: Texts whose results a worker holds at a time.
CHUNK = 500
_RANDOM = np.random.default_rng(42)
_TIMES = _RANDOM.integers(0, 1 << 63, BANDS * ROWS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_PLUS = _RANDOM.integers(0, 1 << 63, BANDS * ROWS, dtype=np.uint64)


def shingles(text: str | None, size: int = SIZE) -> np.ndarray:
    """The sorted distinct hashes of a text's shingles."""
    return np.unique(np.concatenate([np.empty(0, dtype=np.uint64), *simhash.shingle_hashes(text, size)]))


def bands(hashes: np.ndarray) -> list[int]:
    """A key for each band, from the least values of the set under ROWS permutations; none for an empty set."""
    import xxhash

    if not len(hashes):
        return []
    least = np.full(BANDS * ROWS, np.iinfo(np.uint64).max, dtype=np.uint64)
    for at in range(0, len(hashes), 1024):
        np.minimum(least, (hashes[at : at + 1024, None] * _TIMES + _PLUS).min(axis=0), out=least)
    keys = [xxhash.xxh64_intdigest(least[i * ROWS : (i + 1) * ROWS].tobytes(), seed=i) for i in range(BANDS)]
    return np.array(keys, dtype=np.uint64).view(np.int64).tolist()


def _pieces(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
    for batch in batches:
        for at in range(0, len(batch), CHUNK):
            yield batch.iloc[at : at + CHUNK]


def _signed(size: int):
    @F.pandas_udf("struct<_code:string,_size:int,_sim:long,_keys:array<long>>")
    def task(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        import xxhash

        for batch in _pieces(batches):
            sets = [shingles(x if isinstance(x, str) else None, size) for x in batch]
            sims = np.array([simhash.majority(np.split(h, range(65_536, len(h), 65_536))) for h in sets], dtype=np.uint64).view(np.int64)
            yield pd.DataFrame({"_code": [xxhash.xxh3_128_hexdigest(h.tobytes()) for h in sets], "_size": np.array([len(h) for h in sets], dtype="int32"), "_sim": sims, "_keys": [bands(h) for h in sets]})

    return task


def _sets(size: int):
    @F.pandas_udf("array<long>")
    def task(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in _pieces(batches):
            yield pd.Series([shingles(x if isinstance(x, str) else None, size).view(np.int64) for x in batch])

    return task


def alike(sets: list[np.ndarray], left: np.ndarray, right: np.ndarray, least: float) -> tuple[np.ndarray, np.ndarray]:
    """Places (in left, in right) of the pairs of sets that are similar enough; left and right list places in ``sets``."""
    sizes = np.array([len(s) for s in sets])
    token = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    held, count = token[1], token[2]
    # Tokens of one set only take no part in what two sets share.
    rank = np.where(count > 1, np.cumsum(count > 1) - 1, -1)[held]
    owner = np.repeat(np.arange(len(sets)), sizes)[rank >= 0]
    rank = rank[rank >= 0]
    order = np.argsort(rank, kind="stable")
    owner, rank = owner[order], rank[order]
    place_left, place_right = np.full(len(sets), -1), np.full(len(sets), -1)
    place_left[left], place_right[right] = np.arange(len(left)), np.arange(len(right))
    both = np.zeros((len(left), len(right)), dtype=np.float32)
    width = int(rank[-1]) + 1 if len(rank) else 0
    for start in range(0, width, SLAB):
        a, b = np.searchsorted(rank, [start, start + SLAB])
        who, what = owner[a:b], rank[a:b] - start
        x, y = (np.zeros((n, min(SLAB, width - start)), dtype=np.float32) for n in both.shape)
        for matrix, place in ((x, place_left), (y, place_right)):
            own = place[who] >= 0
            matrix[place[who][own], what[own]] = 1
        both += x @ y.T
    total = sizes[left][:, None] + sizes[right][None, :]
    return np.nonzero(both + 1e-6 >= least * (total - both))


def _stars(frame: pd.DataFrame, least: float) -> pd.DataFrame:
    """Links of a star for each component of each task's nodes."""
    key = frame[["centre", "i", "j"]].to_numpy()
    starts = np.concatenate(([0], np.flatnonzero((key[1:] != key[:-1]).any(axis=1)) + 1, [len(key)]))
    ids, sides, sets = frame.id.to_numpy(), frame.side.to_numpy(), frame.set.to_list()
    out = [np.empty((2, 0), dtype=np.int64)]
    for a, b in zip(starts[:-1].tolist(), starts[1:].tolist(), strict=True):
        if b - a < 2:
            continue
        side = sides[a:b]
        left = np.flatnonzero(side == 0)
        right = np.flatnonzero(side == 1) if key[a, 1] != key[a, 2] else left
        p, q = alike(sets[a:b], left, right, least)
        label = np.arange(b - a)
        simhash.join_labels(label, left[p], right[q])
        linked = np.flatnonzero(label != np.arange(b - a))
        out.append(np.stack([ids[a:b][linked], ids[a:b][label[linked]]]))
    u, v = np.concatenate(out, axis=1)
    return pd.DataFrame({"u": u, "v": v})


def _task_stars(least: float):
    def task(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """Whole tasks of a partition sorted by task, when a tile's worth of shingles is there."""
        held: list[pd.DataFrame] = []
        tokens = 0
        for batch in batches:
            held.append(batch)
            tokens += int(batch.set.str.len().sum())
            if tokens < MOST_TOKENS:
                continue
            frame = pd.concat(held)
            key = frame[["centre", "i", "j"]].to_numpy()
            open_ = (key == key[-1]).all(axis=1)
            yield _stars(frame[~open_], least)
            held, tokens = [frame[open_]], int(frame.set[open_].str.len().sum())
        if held:
            yield _stars(pd.concat(held), least)

    return task


def gathered(nodes: DataFrame) -> DataFrame:
    """(centre, id): the groups of nodes that are to be compared, each centre in its own; nodes(id, sim, keys)."""
    keyed = nodes.select("id", F.explode("keys").alias("key"))
    centre = F.min(F.struct(F.xxhash64("id").alias("at"), F.col("id").alias("id")))["id"]
    centres = stored(keyed.groupBy("key").agg(centre.alias("centre"), F.count("*").alias("of")).filter("of > 1"), "centres")
    by_band = join_hot(keyed, centres, "key", "of").select("centre", "id")
    # Fingerprints within reach: equal ones gather around one node, and these around the star's.
    same = stored(nodes.groupBy("sim").agg(F.min("id").alias("centre"), F.count("*").alias("of")), "fingerprints")
    by_code = join_hot(nodes.select("sim", "id"), same.filter("of > 1"), "sim", "of").select("centre", "id")
    stars = simhash.links(same.select(F.col("sim").alias("code")))
    node = lambda name, to: same.select(F.col("sim").alias(name), F.col("centre").alias(to))
    by_star = stars.join(node("u", "id"), "u").join(node("v", "centre"), "v").select("centre", "id")
    pairs = stored(by_band.union(by_code).union(by_star).filter("centre != id").distinct(), "pairs")
    return pairs.union(pairs.select("centre", F.col("centre").alias("id")).distinct())


def compared(placed: DataFrame, sets: DataFrame, least: float) -> DataFrame:
    """Links of the components of each task's nodes, stored; placed(centre, i, j, side, id), sets(id, set)."""
    n = int(placed.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    task = ["centre", "i", "j"]
    return stored(placed.join(sets, "id").repartition(n, *task).sortWithinPartitions(*task).mapInPandas(_task_stars(least), "u long, v long"), "links")


def _placed(rows: DataFrame, i: Column, j: Column, side: int) -> DataFrame:
    return rows.select("centre", i.cast("int").alias("i"), j.cast("int").alias("j"), F.lit(side).alias("side"), "id")


def large_groups(members: DataFrame, large: DataFrame, sets: DataFrame, least: float, known: DataFrame | None) -> DataFrame:
    """Links of the groups of large(centre, tiles), stored; members(centre, id, n) are their nodes, n the shingles of a node.

    ``known`` are links found before. Without any, one round of pivots is all that is done.
    """
    whole = members.join(large, "centre").withColumn("own", F.pmod(F.xxhash64("id", "centre"), F.col("tiles")).cast("int"))
    whole = stored(whole.select("centre", "id", "n", "tiles", "own"), "members")
    links, apart, before, first_only = known, whole, None, known is None
    for turn in range(PIVOT_ROUNDS):
        # About twice as many as wanted by a hash, then the first of those, as long as their shingles fit.
        counts = broadcast_if_small(stored(apart.groupBy("centre").agg(F.count("*").alias("of")), "counts"))
        drawn = apart.join(counts, "centre").withColumn("h", F.xxhash64(F.lit(turn), "id")).filter(F.pmod("h", F.col("of")) < 2 * PIVOTS)
        order = Window.partitionBy("centre").orderBy("h", "id")
        first = drawn.withColumns({"r": F.row_number().over(order), "t": F.sum("n").over(order.rowsBetween(Window.unboundedPreceding, 0))})
        pivots = stored(first.filter((F.col("r") == 1) | ((F.col("r") <= PIVOTS) & (F.col("t") <= MOST_TOKENS // 4))).select("centre", "id", "tiles"), "pivots")
        met = _placed(pivots.select("centre", "id", F.explode(F.sequence(F.lit(0), F.col("tiles") - 1)).alias("own")), F.col("own"), F.lit(-1), 1)
        found = compared(_placed(whole.join(pivots.select("centre").distinct(), "centre", "left_semi"), F.col("own"), F.lit(-1), 0).unionByName(met), sets, least)
        if first_only:
            return found
        links = links.unionByName(found)
        roots = simhash.components(links).withColumnRenamed("code", "id")
        rooted = whole.join(roots, "id", "left").withColumn("root", F.coalesce("root", "id"))
        sizes = rooted.groupBy("centre", "root").agg(F.count("*").alias("of"))
        main = broadcast_if_small(stored(sizes.groupBy("centre").agg(F.max_by("root", F.struct("of", "root")).alias("main")), "main"))
        rooted = stored(rooted.join(main, "centre").withColumn("apart", F.col("root") != F.col("main")).drop("root", "main"), "rooted")
        apart = rooted.filter("apart").drop("apart")
        left = stored(apart.groupBy("centre").agg(F.count("*").alias("of"), F.sum("n").alias("tokens")), "left")
        now = left.agg(F.coalesce(F.sum("of"), F.lit(0)), F.coalesce(F.max(F.greatest(F.col("of") / MOST, F.col("tokens") / MOST_TOKENS)), F.lit(0.0))).first()
        if now[1] <= 1 or (before is not None and 4 * now[0] > 3 * before):
            break
        before = now[0]
    if not now[0]:
        return links
    # What lies apart meets everything: its own tiles pair by pair, and the tiles of the largest component.
    tiles = F.greatest(F.ceil(F.col("of") / MOST), F.ceil(F.col("tokens") / MOST_TOKENS)).cast("int")
    tiled = rooted.join(broadcast_if_small(stored(left.select("centre", tiles.alias("o")), "apart")), "centre").withColumn("at", F.pmod(F.xxhash64(F.lit("apart"), "id", "centre"), F.col("o")).cast("int"))
    each = lambda n: F.sequence(F.lit(0), n - 1)
    away = tiled.filter("apart")
    pairs = away.select("centre", "id", F.explode(F.transform(each(F.col("o")), lambda x: F.struct(F.least("at", x).alias("i"), F.greatest("at", x).alias("j"), (F.col("at") > x).cast("int").alias("side")))).alias("m")).select("centre", "m.*", "id")
    outside = _placed(away.select("centre", "id", "at", "o", F.explode(each(F.col("tiles"))).alias("c")), F.col("at"), F.col("o") + F.col("c"), 0)
    inside = _placed(tiled.filter("NOT apart").select("centre", "id", "o", "own", F.explode(each(F.col("o"))).alias("x")), F.col("x"), F.col("o") + F.col("own"), 1)
    return links.unionByName(compared(pairs.unionByName(outside).unionByName(inside), sets, least))


def grouped_links(members: DataFrame, sets: DataFrame, least: float, known: DataFrame | None) -> DataFrame:
    """Links within the groups of members(centre, id, n), stored; without links known before, of large groups those to some pivots only."""
    members = stored(members, "grouped")
    large = members.groupBy("centre").agg(F.count("*").alias("k"), F.sum("n").alias("tokens")).filter((F.col("k") > MOST) | (F.col("tokens") > MOST_TOKENS))
    # Each large group stands for thousands of nodes.
    large = stored(large.select("centre", F.greatest(F.ceil(F.col("k") / MOST), F.ceil(F.col("tokens") / MOST_TOKENS)).cast("int").alias("tiles")), "large")
    some, large = not small_enough(large, 0), broadcast_if_small(large)
    found = compared(_placed(members.join(large, "centre", "left_anti") if some else members, F.lit(0), F.lit(0), 0), sets, least)
    return found.unionByName(large_groups(members, large, sets, least, known)) if some else found


def answers(rows: DataFrame, text: Column, size: int = SIZE, least: float = LEAST) -> DataFrame:
    """For each shingle set (_code) its component's root and smallest doc_id, and its documents (_n); rows(_rid, _id, _code, _size, _sim, _keys) are stored."""
    nodes = stored(
        rows.groupBy("_code").agg(F.min("_rid").alias("id"), F.min("_id").alias("low"), F.count("*").alias("of"), F.first("_size").alias("n"), F.first("_sim").alias("sim"), F.first("_keys").alias("keys")), "nodes"
    )
    groups = stored(gathered(nodes.select("id", "sim", "keys")), "groups")
    # A node's id is that of one of its rows, so its set is made once, from that row.
    wanted = broadcast_if_small(stored(groups.select(F.col("id").alias("_rid")).distinct(), "wanted"), 500_000)
    sets = stored(rows.select("_rid", text.alias("text")).join(wanted, "_rid").select(F.col("_rid").alias("id"), _sets(size)("text").alias("set")), "sets")
    sized = stored(groups.join(nodes.select("id", "n"), "id"), "sized")
    # A node is first compared in the largest of its groups alone; that joins most clusters. What is left are the groups with nodes of several components.
    counts = stored(sized.groupBy("centre").agg(F.count("*").alias("k"), F.count("*").alias("size")), "group-sizes")
    home = join_hot(sized, counts, "centre", "k").groupBy("id").agg(F.max_by(F.struct("centre", "n"), F.struct("size", "centre")).alias("g"))
    links = grouped_links(home.select("g.centre", "id", "g.n"), sets, least, None)
    roots = simhash.components(links).withColumnRenamed("code", "id")
    rooted = sized.select("centre", "id").join(roots, "id", "left").withColumn("root", F.coalesce("root", "id"))
    several = stored(rooted.groupBy("centre").agg(F.min("root").alias("a"), F.max("root").alias("b"), F.count("*").alias("k")).filter("a != b").select("centre", "k"), "several")
    if not small_enough(several, 0):
        links = links.unionByName(grouped_links(join_hot(sized, several, "centre", "k"), sets, least, links))
    found = links
    known = simhash.rooted(nodes.select(F.col("id").alias("code"), "low", "of"), simhash.components(found))
    return stored(known.withColumnRenamed("_code", "id").join(nodes.select("id", F.col("_code")), "id").select("_code", "_root", "_component", "_n"), "answers")


def deduplicated(docs: DataFrame, size: int = SIZE, least: float = LEAST) -> DataFrame:
    """The document with the smallest doc_id of each component, with its own columns, once."""

    def coded(rows: DataFrame, keep: list[str]) -> DataFrame:
        return stored(rows.select(*keep, F.monotonically_increasing_id().alias("_rid"), F.col("doc_id").alias("_id"), _signed(size)("text").alias("_s")).select(*keep, "_rid", "_id", "_s.*"), "codes")

    return simhash.first_of_each(docs, coded, lambda rows, box: answers(rows, F.col(f"{box}.text"), size, least))
