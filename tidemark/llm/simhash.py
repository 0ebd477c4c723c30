"""SimHash near-duplicates with a Gray-order hierarchical index (operator 7).

Fingerprints: over the XXH64 values (seed 42) of a text's 3-word shingles, repeats included, a bit is 1 if it
is set in more than half of them. Documents are linked where fingerprints differ in at most three bits. Equal
fingerprints are one node from the start.

Of two nodes within three bits, one half of the code differs in one bit at most. So the index is built twice, over
the codes and over the codes turned by 32 bits, and in each the first half may differ in one bit and the whole in
three; every pair within reach is found in one of them at least.

In Gray order, neighbours differ in few bits and a run of codes shares its leading bits. The upper level of the index
is cut in Spark: codes with the same leading bits (about ``GROUP`` codes a group) are a node with that masked pattern.
Groups whose patterns differ in more than one bit are pruned whole: they never meet. A group is at home in one task,
and the codes of groups one bit away visit it. A group of more than ``TILE`` codes is dealt out in tiles, and more than
``MOST_VISITORS`` visitors in chunks, so no task holds a hot group. In the task, home and visitors are sorted by Gray
rank and become trees whose nodes hold the bits that all codes below share. Both trees are descended together;
differences are accumulated on the way down, counting only bits not shared further up, and pairs of
nodes beyond the reach are dropped with all that is below them. What remains is compared code by code. A task returns a
spanning star for each of its components, never all pairs.

Stars of all tasks become components by alternating large-star and small-star steps, written to the shared folder
after each round. Hot stars and hot fingerprints are joined apart from the rest (``join_hot``).

Defined cases: a null or blank text has fingerprint zero and is linked like any other; a null doc_id does not
count for component_id (null if a component has no other); repeated rows share one component; an empty
table gives an empty result; texts of any length are hashed whole, in slices of 65,536 shingles; extra columns travel in
one struct, whatever their names.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType

from tidemark.llm.common import broadcast_if_small, free_names, join_hot, scratch, stored

REACH = 3
SEED = 42
#: Codes of a group on average, most codes that are at home in a task, and most that visit them.
GROUP, TILE, MOST_VISITORS = 2048, 4096, 65_536
LEAF, FANOUT = 8, 8
FIRST_HALF = np.uint64(0xFFFFFFFF00000000)
_WORD = re.compile(rb"[^\x20\x09-\x0D]+")
_UPPERCASE = bytes(range(65, 91))
_LOWER = bytes.maketrans(_UPPERCASE, _UPPERCASE.lower())


def shingle_hashes(text: str | None, size: int = 3) -> Iterator[np.ndarray]:
    """XXH64 of a whole text's shingles, repeats included, in slices of 65,536; a text of fewer words is one shingle."""
    import xxhash

    words = _WORD.findall((text or "").encode("utf-8", "surrogatepass").translate(_LOWER))
    if not words:
        return
    joined = b" ".join(words)
    ends = np.cumsum([len(w) + 1 for w in words]) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    size = min(size, len(words))
    first, last = starts[: len(words) - size + 1].tolist(), ends[size - 1 :].tolist()
    digest = xxhash.xxh64_intdigest
    for at in range(0, len(first), 65_536):
        yield np.array([digest(joined[a:b], SEED) for a, b in zip(first[at : at + 65_536], last[at : at + 65_536], strict=True)], dtype="<u8")


def majority(slices: Iterator[np.ndarray] | list[np.ndarray]) -> int:
    """The bits that are set in more than half of all hashes."""
    total, n = np.zeros(64, dtype=np.int64), 0
    for hashes in slices:
        total += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
        n += len(hashes)
    bits = (2 * total > n).astype(np.uint8)
    return int(np.packbits(bits, bitorder="little").view("<u8")[0])


def fingerprint(text: str | None, size: int = 3) -> int:
    """SimHash of a whole text."""
    return majority(shingle_hashes(text, size))


@F.pandas_udf(LongType())
def fingerprints(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
    for batch in batches:
        values = np.array([fingerprint(x if isinstance(x, str) else None) for x in batch], dtype=np.uint64)
        yield pd.Series(values.view(np.int64))


def gray_rank(x: np.ndarray) -> np.ndarray:
    """Place of each code in the Gray sequence."""
    x = x.copy()
    for shift in (1, 2, 4, 8, 16, 32):
        x ^= x >> np.uint64(shift)
    return x


def _spread(first: np.ndarray, count: np.ndarray) -> np.ndarray:
    """first[i], first[i] + 1, ... count[i] times, for each i in turn."""
    at = np.repeat(first - np.concatenate(([0], np.cumsum(count)[:-1])), count)
    return at + np.arange(len(at))


class GrayIndex:
    """A tree over codes in Gray order: leaves of ``LEAF`` codes, and nodes of ``FANOUT`` lower nodes up to a single root.

    A level, the root's first, has for each node the place of its first lower node (or code), how many there are, the mask
    of the bits that all codes below share, and their pattern.
    """

    def __init__(self, codes: np.ndarray) -> None:
        self.codes = codes
        at = np.arange(0, len(codes), LEAF)
        low, high = np.bitwise_and.reduceat(codes, at), np.bitwise_or.reduceat(codes, at)
        levels = [(at, np.diff(np.append(at, len(codes))), ~(low ^ high), low)]
        while len(at) > 1:
            nodes, at = len(at), np.arange(0, len(at), FANOUT)
            low, high = np.bitwise_and.reduceat(low, at), np.bitwise_or.reduceat(high, at)
            levels.append((at, np.diff(np.append(at, nodes)), ~(low ^ high), low))
        self.levels = levels[::-1]
        below = [levels[0][1]]
        for at, *_ in levels[1:]:
            below.append(np.add.reduceat(below[-1], at))
        self.below = below[::-1]


class Search:
    """Pairs of codes within reach of two trees (or of one), descended together from their roots.

    ``pruned`` and ``compared`` count the pairs of codes that were dropped with a pair of nodes and that were compared.
    """

    def __init__(self, a: GrayIndex, b: GrayIndex, a_label: np.ndarray, b_label: np.ndarray) -> None:
        self.a, self.b, self.same = a, b, a is b
        self.a_label, self.b_label = a_label, b_label
        self.pruned = self.compared = 0

    def pairs(self) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Places (in a, in b) within reach; labels hold components so far, and leaves of one component meet no more."""
        none = np.zeros(1, dtype=np.int64)
        yield from self._descend(0, 0, none, none, none, none, np.zeros(1, dtype=np.uint64))

    def _descend(self, i: int, j: int, x: np.ndarray, y: np.ndarray, first: np.ndarray, every: np.ndarray, known: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Nodes x of level i and y of level j, with the differences (in the first half, in all) among the bits known from above."""
        a, b = self.a.levels[i], self.b.levels[j]
        shared = a[2][x] & b[2][y]
        fresh = (a[3][x] ^ b[3][y]) & shared & ~known
        first, every = first + np.bitwise_count(fresh & FIRST_HALF), every + np.bitwise_count(fresh)
        near = (first <= 1) & (every <= REACH)
        self.pruned += int((self.a.below[i][x] * self.b.below[j][y])[~near].sum())
        x, y, first, every, shared = x[near], y[near], first[near], every[near], shared[near]
        left_a, left_b = len(self.a.levels) - 1 - i, len(self.b.levels) - 1 - j
        if not left_a and not left_b:
            yield from self._members(x, y)
            return
        # The higher tree goes down a level, or both where they are equally high.
        down_a, down_b = left_a >= left_b, left_b >= left_a
        one = np.ones(len(x), dtype=np.int64)
        m, n = a[1][x] if down_a else one, b[1][y] if down_b else one
        for at in _chunks(m * n):
            p, q = _product(a[0][x[at]] if down_a else x[at], m[at], b[0][y[at]] if down_b else y[at], n[at])
            carried = [np.repeat(c[at], m[at] * n[at]) for c in (first, every, shared)]
            if self.same:
                keep = p <= q
                p, q, carried = p[keep], q[keep], [c[keep] for c in carried]
            yield from self._descend(i + down_a, j + down_b, p, q, *carried)

    def _members(self, x: np.ndarray, y: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        a, b = self.a.levels[-1], self.b.levels[-1]
        for at in _chunks(a[1][x] * b[1][y]):
            least_a, most_a = np.minimum.reduceat(self.a_label, a[0]), np.maximum.reduceat(self.a_label, a[0])
            least_b, most_b = np.minimum.reduceat(self.b_label, b[0]), np.maximum.reduceat(self.b_label, b[0])
            u, v = x[at], y[at]
            apart = (least_a[u] != most_a[u]) | (least_b[v] != most_b[v]) | (least_a[u] != least_b[v])
            u, v = u[apart], v[apart]
            p, q = _product(a[0][u], a[1][u], b[0][v], b[1][v])
            if self.same:
                keep = p < q
                p, q = p[keep], q[keep]
            self.compared += len(p)
            near = np.bitwise_count(self.a.codes[p] ^ self.b.codes[q]) <= REACH
            yield p[near], q[near]


def _product(a: np.ndarray, n: np.ndarray, b: np.ndarray, m: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each i, all pairs of a[i], a[i] + 1, ... (n[i] of them) and b[i], b[i] + 1, ... (m[i])."""
    x, times = _spread(a, n), np.repeat(m, n)
    return np.repeat(x, times), _spread(np.repeat(b, n), times)


def _chunks(sizes: np.ndarray, most: int = 500_000) -> Iterator[np.ndarray]:
    """Places in order, cut so that a chunk's sizes add up to about ``most``."""
    if len(sizes):
        total = np.cumsum(sizes)
        yield from np.split(np.arange(len(sizes)), np.flatnonzero(np.diff(total // most)) + 1)


def join_labels(label: np.ndarray, a: np.ndarray, b: np.ndarray) -> None:
    """Merge components in place: each label is the least place of its component."""
    while len(a):
        x, y = label[a], label[b]
        differ = x != y
        if not differ.any():
            return
        a, b, x, y = a[differ], b[differ], x[differ], y[differ]
        np.minimum.at(label, np.maximum(x, y), np.minimum(x, y))
        while True:
            up = label[label]
            if (up == label).all():
                break
            label[:] = up


def meet(home: np.ndarray, visitors: np.ndarray, among_home: bool = True) -> tuple[np.ndarray, list[Search]]:
    """Labels of home and visitors, both in Gray order, after all links of the task; and the searches made."""
    label = np.arange(len(home) + len(visitors))
    own, others = label[: len(home)], label[len(home) :]
    tree = GrayIndex(home)
    searches = [Search(tree, tree, own, own)] if among_home else []
    if len(visitors):
        searches.append(Search(tree, GrayIndex(visitors), own, others))
    for search in searches:
        for a, b in search.pairs():
            join_labels(label, a, b if search.same else b + len(home))
    return label, searches


def _stars(frame: pd.DataFrame) -> pd.DataFrame:
    """Links of a star for each component of each task: (u, v) with v a code of the component."""
    codes, visiting = frame.code.to_numpy().view(np.uint64), frame.visiting.to_numpy()
    key = frame[["turn", "home", "tile", "chunk"]].to_numpy()
    run = np.concatenate(([0], np.cumsum((key[1:] != key[:-1]).any(axis=1))))
    order = np.lexsort((gray_rank(codes), visiting, run))
    codes, visiting, run, key = codes[order], visiting[order], run[order], key[order]
    out = []
    starts = np.concatenate(([0], np.flatnonzero(run[1:] != run[:-1]) + 1, [len(run)]))
    for start, end in zip(starts[:-1].tolist(), starts[1:].tolist(), strict=True):
        here = codes[start:end]
        home = int(np.count_nonzero(~visiting[start:end]))
        if not home or end - start < 2:
            continue
        label, _ = meet(here[:home], here[home:], among_home=bool(key[start, 3] == 0))
        linked = np.flatnonzero(label != np.arange(len(label)))
        pair = np.stack([here[linked], here[label[linked]]])
        out.append(pair << np.uint64(32) | pair >> np.uint64(32) if key[start, 0] else pair)
    u, v = np.concatenate(out, axis=1).view(np.int64) if out else np.empty((2, 0), dtype=np.int64)
    return pd.DataFrame({"u": u, "v": v})


def _task_stars(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Whole tasks of a partition sorted by task; about 200,000 rows at a time."""
    held: list[pd.DataFrame] = []
    rows = 0
    for batch in batches:
        held.append(batch)
        rows += len(batch)
        if rows < 200_000:
            continue
        frame = pd.concat(held)
        key = frame[["turn", "home", "tile", "chunk"]].to_numpy()
        open_ = (key == key[-1]).all(axis=1)
        yield _stars(frame[~open_])
        held, rows = [frame[open_]], int(open_.sum())
    if rows:
        yield _stars(pd.concat(held))


def group_bits(nodes: int) -> int:
    """Leading bits of a group, so that random codes make groups of about ``GROUP``; within the first half."""
    return max(0, min(32, (nodes // GROUP).bit_length()))


def dealt(nodes: DataFrame) -> DataFrame:
    """The upper level of the index: rows (turn, home, tile, chunk, code, visiting) of all tasks; nodes(code) are distinct."""
    bits = group_bits(nodes.count())
    swapped = F.shiftleft("code", 32).bitwiseOR(F.shiftrightunsigned("code", 32))
    both = nodes.select(F.explode(F.array(F.struct(F.lit(0).alias("turn"), F.col("code")), F.struct(F.lit(1).alias("turn"), swapped.alias("code")))).alias("c")).select("c.*")
    grouped = both.withColumn("group", F.shiftrightunsigned("code", 64 - bits) if bits else F.lit(0).cast("long"))
    # Of two groups one bit apart, the one without the bit is home to both.
    lower = F.filter(F.array(*[F.when(F.col("group").bitwiseAND(F.lit(1 << b)) != 0, F.col("group") - (1 << b)) for b in range(bits)]).cast("array<bigint>"), lambda g: g.isNotNull())
    counts = grouped.groupBy("turn", "group").agg(F.count("*").alias("n"))
    visits = counts.select("turn", F.explode(lower).alias("group"), "n").groupBy("turn", "group").agg(F.sum("n").alias("visitors"))
    sized = counts.join(visits, ["turn", "group"], "left").withColumn("meets", F.coalesce("visitors", F.lit(0)) + F.when(F.col("n") > TILE, F.col("n")).otherwise(0))
    # Only hot groups are listed: each stands for more than TILE of the codes or of their visits.
    hot = sized.filter((F.col("n") > TILE) | (F.col("meets") > MOST_VISITORS))
    hot = stored(hot.select("turn", F.col("group").alias("home"), F.ceil(F.col("n") / TILE).cast("int").alias("tiles"), F.greatest(F.lit(1), F.ceil(F.col("meets") / MOST_VISITORS)).cast("int").alias("chunks")), "hot")
    homes = F.concat(F.array(F.struct(F.col("group").alias("home"), F.lit(False).alias("visiting"))), F.transform(lower, lambda g: F.struct(g.alias("home"), F.lit(True).alias("visiting"))))
    sent = grouped.select("turn", "code", F.explode(homes).alias("h")).select("turn", "code", "h.*").join(broadcast_if_small(hot), ["turn", "home"], "left")
    tiles, chunks = F.coalesce("tiles", F.lit(1)), F.coalesce("chunks", F.lit(1))
    own, chunk = F.pmod(F.xxhash64("code"), tiles).cast("int"), F.pmod(F.xxhash64(F.lit(1), "code"), chunks).cast("int")
    place = lambda tile, part, visiting: F.struct(tile.alias("tile"), part.alias("chunk"), F.lit(visiting).alias("visiting"))
    visit = lambda i: F.array(place(i, chunk, True))
    # A code at home meets its own tile's codes in chunk 0, its tile's visitors in every chunk, and visits the later tiles.
    stay = lambda i: F.when(i == own, F.transform(F.sequence(F.lit(0), chunks - 1), lambda c: place(i, c, False))).when(i > own, visit(i)).otherwise(F.slice(visit(i), 1, 0))
    places = F.flatten(F.transform(F.sequence(F.lit(0), tiles - 1), lambda i: F.when(F.col("visiting"), visit(i)).otherwise(stay(i))))
    return sent.select("turn", "home", "code", F.explode(places).alias("p")).select("turn", "home", "p.tile", "p.chunk", "code", "p.visiting")


def links(nodes: DataFrame) -> DataFrame:
    """Stars (u, v) that join all codes within reach of each other; nodes(code) holds distinct codes."""
    task = ["turn", "home", "tile", "chunk"]
    n = int(nodes.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return dealt(nodes).repartition(n, *task).sortWithinPartitions(*task).mapInPandas(_task_stars, "u long, v long")


def _starred(edges: DataFrame) -> DataFrame:
    """One large-star and one small-star step; edges(u, v) with u above v, stored."""
    both = edges.select("u", "v").union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = stored(both.groupBy("u").agg(F.least("u", F.min("v")).alias("m"), F.count("*").alias("n")), "least")
    # Large star: neighbours above a node go to the least of its neighbourhood.
    large = join_hot(both.filter("v > u"), least, "u", "n").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u != v").distinct()
    # Small star: a node and its lower neighbours go to the least of them; these are one a star that the node is in.
    lower = large.groupBy("u").agg(F.min("v").alias("m"))
    small = large.join(lower, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).union(lower.select("u", F.col("m").alias("v")))
    return stored(small.filter("u != v").distinct(), "edges")


def components(edges: DataFrame, most_rounds: int = 200) -> DataFrame:
    """(code, root): the least code of each linked code's component, by alternating large-star and small-star steps.

    The number of rounds grows with the logarithm of the longest chain; should they run out, that is an error.
    """
    edges = stored(edges.filter("u != v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "edges")
    state = None
    for _ in range(most_rounds):
        with scratch(edges.sparkSession, keep=1):
            edges = _starred(edges)
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == state:
            return edges.select(F.col("u").alias("code"), F.col("v").alias("root"))
        state = now
    raise RuntimeError(f"components are not settled after {most_rounds} rounds")


def coded(docs: DataFrame, keep: list[str]) -> DataFrame:
    """The kept columns with ``_rid`` (a number of the row), ``_id`` and ``_code`` (the fingerprint), stored."""
    return stored(docs.select(*keep, F.monotonically_increasing_id().alias("_rid"), F.col("doc_id").alias("_id"), fingerprints("text").alias("_code")), "codes")


def answers(codes: DataFrame) -> DataFrame:
    """For each fingerprint (_code) the smallest doc_id reachable (_component) and its documents (_n); codes(_id, _code)."""
    nodes = stored(codes.groupBy(F.col("_code").alias("code")).agg(F.min("_id").alias("low"), F.count("*").alias("of")), "nodes")
    return rooted(nodes, components(links(nodes.select("code"))))


def rooted(nodes: DataFrame, roots: DataFrame) -> DataFrame:
    """(_code, _root, _component, _n), stored, from nodes(code, low, of) and their components."""
    found = stored(nodes.join(roots, "code", "left").select("code", F.coalesce("root", "code").alias("root"), "low", "of"), "rooted")
    least = stored(found.groupBy("root").agg(F.min("low").alias("component"), F.count("*").alias("n")), "least")
    return stored(join_hot(found, least, "root", "n").select(F.col("code").alias("_code"), F.col("root").alias("_root"), F.col("component").alias("_component"), F.col("of").alias("_n")), "answers")


def hex_code(code: Column) -> Column:
    return F.lpad(F.lower(F.hex(code)), 16, "0")


def near_duplicates(docs: DataFrame) -> DataFrame:
    """One row a document: doc_id, fingerprint, component_id."""
    codes = coded(docs, [])
    return join_hot(codes, answers(codes), "_code", "_n").select(F.col("_id").alias("doc_id"), hex_code(F.col("_code")).alias("fingerprint"), F.col("_component").alias("component_id"))


def deduplicated(docs: DataFrame) -> DataFrame:
    """The document with the smallest doc_id of each component, with its own columns, once."""
    return first_of_each(docs, coded, lambda rows, box: answers(rows))


def first_of_each(docs: DataFrame, coded, answers) -> DataFrame:
    """The first document of each component, where ``coded`` gives rows a node and ``answers`` nodes a component.

    Rows that repeat that doc_id give way to the first of them by content; a component without any doc_id keeps
    one row, the first by content. The choice is made on narrow rows; a text stays where it is unless the rows that go are many.
    """
    (box,) = free_names(docs, "_row")
    sign = F.xxhash64(*[F.to_json(F.struct(c)) if "map<" in t else F.col(c) for c, t in docs.dtypes])
    rows = coded(docs.select(F.struct(*docs.columns).alias(box), sign.alias("_sign"), "doc_id", "text"), [box, "_sign"])
    narrow = rows.select("_rid", "_id", "_code", "_sign")
    firsts = join_hot(narrow, answers(rows, box), "_code", "_n").filter(F.col("_id").eqNullSafe(F.col("_component")))
    group = F.coalesce(F.col("_id").cast("string"), F.concat(F.lit("root "), F.col("_root").cast("string")))
    chosen = firsts.groupBy(group.alias("_group")).agg(F.min(F.struct("_sign", "_code", "_rid")).alias("_first")).select("_first._rid")
    gone = stored(narrow.select("_rid").join(chosen, "_rid", "left_anti"), "gone")
    return rows.join(broadcast_if_small(gone, 500_000), "_rid", "left_anti").select(f"{box}.*")
