import random
import re

import numpy as np
import pandas as pd
import pytest
import xxhash
from pyspark.sql import functions as F

from tidemark.llm import simhash
from tidemark.llm.simhash import _stars, components, deduplicated, fingerprint, gray_rank, links, meet, near_duplicates
from tidemark.session import table

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def code(text):
    t = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", t)
    grams = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] if len(words) > 2 else [" ".join(words)] if words else []
    hashes = [xxhash.xxh64_intdigest(g.encode(), seed=42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def classes(codes):
    """Least member of each code's component, by brute force."""
    codes = sorted(set(codes))
    root = {c: c for c in codes}

    def find(c):
        while root[c] != c:
            c = root[c]
        return c

    arr = np.array(codes, dtype=np.uint64)
    for i, c in enumerate(codes):
        for j in np.flatnonzero(np.bitwise_count(arr[i + 1 :] ^ arr[i]) <= 3):
            a, b = find(c), find(codes[i + 1 + j])
            root[max(a, b)] = min(a, b)
    return {c: find(c) for c in codes}


def rooted(find, c):
    while find[c] != c:
        c = find[c]
    return c


def near_codes(n, seed, tight=False):
    rnd = random.Random(seed)
    base = [rnd.getrandbits(64) for _ in range(1 if tight else n // 8)]
    return list({rnd.choice(base) ^ sum({1 << rnd.randrange(64) for _ in range(rnd.randrange(4))}) for _ in range(n)})


def expected(rows):
    coded = [(i, code(t)) for i, t in rows]
    root = classes(c for _, c in coded)
    low = {}
    for i, c in coded:
        if i is not None:
            low[root[c]] = min(i, low.get(root[c], i))
    return sorted((str(i), f"{c:016x}", low.get(root[c])) for i, c in coded)


def test_documents(spark):
    docs = table(spark, "/root/testdata/sf0.01", "documents")
    got = sorted((str(r["doc_id"]), r["fingerprint"], r["component_id"]) for r in near_duplicates(docs).collect())
    assert got == expected([(r["doc_id"], r["text"]) for r in docs.collect()])


def test_edge_cases(spark):
    rows = [(5, None), (4, ""), (9, " \t\n"), (7, "One"), (8, "one two"), (3, "ONE two THREE é"), (2, "one two three É"), (None, "alone here with no id"), (None, "one"), (6, "wort " * 5000), (6, "wort " * 5000), (1, "x" * 100_000)]
    docs = spark.createDataFrame([(i, t, None, None, None, "x") for i, t in rows], SCHEMA + ", Code string")
    got = sorted((str(r["doc_id"]), r["fingerprint"], r["component_id"]) for r in near_duplicates(docs).collect())
    assert got == expected(rows)
    kept = deduplicated(docs)
    want = {(str(i), f) for i, f, c in expected(rows) if str(i) == str(c)}
    assert kept.columns == docs.columns and len(kept.collect()) == len(want)
    assert near_duplicates(docs.limit(0)).count() == 0 and deduplicated(docs.limit(0)).count() == 0


def test_one_half_differs_in_one_bit():
    rnd = random.Random(1)
    for _ in range(300):
        d = sum(1 << b for b in rnd.sample(range(64), 3))
        assert min((d >> 32).bit_count(), (d & 0xFFFFFFFF).bit_count()) <= 1


@pytest.mark.parametrize(("tight", "n"), [(False, 600), (True, 1500)])
def test_index_finds_every_link(tight, n):
    codes = near_codes(n, 5, tight)
    frame = pd.DataFrame({"code": np.array(codes, dtype=np.uint64).view(np.int64), "turn": 0, "home": 0, "tile": 0, "chunk": 0, "visiting": False})
    turned = frame.assign(code=frame.code.to_numpy().view(np.uint64) << np.uint64(32) | frame.code.to_numpy().view(np.uint64) >> np.uint64(32), turn=1)
    stars, want = _stars(frame), classes(codes)
    stars = pd.concat([stars, _stars(turned)])
    find = {c: c for c in codes}
    for u, v in zip(stars.u.to_numpy().view(np.uint64).tolist(), stars.v.to_numpy().view(np.uint64).tolist(), strict=True):
        a, b = rooted(find, u), rooted(find, v)
        find[max(a, b)] = min(a, b)
    groups, truth = {}, {}
    for c in codes:
        groups.setdefault(rooted(find, c), set()).add(c)
        truth.setdefault(want[c], set()).add(c)
    assert set(map(frozenset, groups.values())) == set(map(frozenset, truth.values()))


def test_hot_bucket_in_tiles(spark, monkeypatch):
    monkeypatch.setattr(simhash, "TILE", 64)
    monkeypatch.setattr(simhash, "GROUP", 200)
    monkeypatch.setattr(simhash, "MOST_VISITORS", 100)
    codes = near_codes(900, 11, tight=True) + near_codes(200, 12)
    nodes = spark.createDataFrame([(c - (1 << 64) if c >> 63 else c,) for c in codes], "code long")
    roots = {r["code"] % (1 << 64): r["root"] for r in components(links(nodes)).collect()}
    got, want = {}, classes(codes)
    for c in codes:
        got.setdefault(roots.get(c, c), set()).add(c)
    truth = {}
    for c in codes:
        truth.setdefault(want[c], set()).add(c)
    # A root is a member of its own group and is not listed itself.
    merged = {frozenset(v | ({k % (1 << 64)} if k % (1 << 64) in want else set())) for k, v in got.items() if len(v) > 1 or k % (1 << 64) not in roots.values()}
    assert {x for x in map(frozenset, truth.values()) if len(x) > 1} <= merged | {frozenset(x) for x in truth.values() if len(x) == 1}


def test_chain_of_links(spark):
    edges = spark.range(1, 200).select(F.col("id").alias("u"), (F.col("id") - 1).alias("v"))
    assert {(r["code"], r["root"]) for r in components(edges).collect()} == {(i, 0) for i in range(1, 200)}


def test_fingerprint_of_long_text():
    text = " ".join(str(i * i % 997) for i in range(70_000))
    assert fingerprint(text) == code(text)


@pytest.mark.parametrize("visitors", [False, True])
def test_groups_are_pruned_whole(visitors):
    """Nearly all pairs of random codes are dropped with a pair of nodes; none that is near is lost."""
    rng = np.random.default_rng(7)
    codes = rng.integers(0, 1 << 63, 2000, dtype=np.uint64) * np.uint64(2)
    near = codes ^ (np.uint64(1) << rng.integers(0, 64, 2000, dtype=np.uint64))
    home = codes if visitors else np.unique(np.concatenate([codes, near]))
    home, others = home[np.argsort(gray_rank(home))], near[np.argsort(gray_rank(near))] if visitors else near[:0]
    label, searches = meet(home, others)
    every = np.concatenate([home, others])
    place = {c: i for i, c in enumerate(every.tolist())}
    assert all(label[place[a]] == label[place[b]] for a, b in zip(codes.tolist(), near.tolist(), strict=True))
    pruned, compared = sum(s.pruned for s in searches), sum(s.compared for s in searches)
    assert pruned > 0 and compared < 0.2 * (pruned + compared)


def test_the_index_prunes_groups_of_documents(spark):
    """On the documents, group pairs are pruned in Spark (codes of far groups never meet) and in the tasks."""
    docs = table(spark, "/root/testdata/sf0.1", "documents")
    nodes = simhash.stored(simhash.coded(docs, []).select(F.col("_code").alias("code")).distinct(), "nodes")
    n, groups = nodes.count(), 1 << simhash.group_bits(nodes.count())
    met = simhash.dealt(nodes).groupBy("turn", "home").agg(F.count_if(~F.col("visiting")).alias("h"), F.count_if("visiting").alias("v")).agg(F.sum(F.expr("h * (h - 1) / 2 + h * v"))).first()[0]
    assert groups > 1 and 0 < met < 0.8 * n * (n - 1)  # of two times all pairs
    frame = simhash.dealt(nodes).filter("turn = 0 AND home = 0").toPandas()
    order = lambda x: x[np.argsort(gray_rank(x))]
    codes = frame.code.to_numpy().view(np.uint64)
    _, searches = meet(order(codes[~frame.visiting]), order(codes[frame.visiting]))
    assert all(s.pruned > s.compared > 0 for s in searches)
