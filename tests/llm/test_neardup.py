import random

import pytest

from tidemark.llm import neardup
from tidemark.llm.neardup import bands, deduplicated, shingles
from tidemark.session import table

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def firsts(rows):
    """The ids that stay, by brute force over all pairs."""
    root = {i: i for i, _ in rows}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    sets = {i: set(shingles(t).tolist()) for i, t in rows}
    ids = sorted(sets)
    for k, a in enumerate(ids):
        for b in ids[k + 1 :]:
            x, y = sets[a], sets[b]
            if x == y or (5 * len(x) >= 4 * len(y) and 5 * len(y) >= 4 * len(x) and 5 * len(x & y) >= 4 * len(x | y)):
                p, q = find(a), find(b)
                root[max(p, q)] = min(p, q)
    return sorted(i for i in ids if find(i) == i)


def test_documents(spark):
    docs = table(spark, "/root/testdata/sf0.01", "documents")
    want = firsts([(r["doc_id"], r["text"]) for r in docs.collect()])
    assert sorted(r["doc_id"] for r in deduplicated(docs).collect()) == want


def test_pairs_that_op7_keeps_apart(spark):
    docs = table(spark, "/root/testdata/sf0.1", "documents").filter("doc_id IN (596, 917, 783, 3006, 2465, 5733)")
    assert sorted(r["doc_id"] for r in deduplicated(docs).collect()) == [596, 783, 2465]


def test_chains_in_a_hot_bucket_and_defined_cases(spark):
    rnd = random.Random(3)
    base, rows = [f"w{i}" for i in range(200)], []
    for i in range(150):
        words = list(base)
        for _ in range(rnd.randrange(5)):
            words[rnd.randrange(200)] = f"v{rnd.random()}"
        rows.append((i, " ".join(words)))
    rows += [(200, None), (201, " \n"), (202, "one two"), (203, "One  TWO"), (204, "one two three")]
    docs = spark.createDataFrame([(i, t, None, None, None, "x") for i, t in rows], SCHEMA + ", _keys string")
    kept = deduplicated(docs)
    assert kept.columns == docs.columns and sorted(r["doc_id"] for r in kept.collect()) == firsts(rows)
    assert deduplicated(docs.limit(0)).count() == 0 and bands(shingles("")) == []


def near_copies(n, words=120, seed=2, far=0):
    """Copies of one text with a word changed in each; of the last ``far``, chains of texts that change more and more."""
    rnd = random.Random(seed)
    base, rows = [f"w{i}" for i in range(words)], []
    for i in range(n - far):
        own = list(base)
        own[rnd.randrange(words)] = f"v{i}"
        rows.append((i, " ".join(own)))
    own = list(base)
    for i in range(n - far, n):
        own[rnd.randrange(words)] = f"x{i}"
        rows.append((i, " ".join(own)))
    return rows


@pytest.mark.parametrize("most, pivots", [(40, 3)])
def test_large_groups_in_chunks(spark, monkeypatch, most, pivots):
    """Groups above one tile: near copies, chains that leave them step by step, several clusters; as brute force."""
    monkeypatch.setattr(neardup, "MOST", most)
    monkeypatch.setattr(neardup, "PIVOTS", pivots)
    rows = near_copies(160, far=60) + [(1_000 + i, t.replace("w", "u")) for i, t in near_copies(30, seed=5)]
    docs = spark.createDataFrame([(i, t, None, None, None) for i, t in rows], SCHEMA)
    assert sorted(r["doc_id"] for r in deduplicated(docs).collect()) == firsts(rows)


def test_a_hot_group_sends_linear_rows(spark, monkeypatch):
    sent, real = [], neardup.compared

    def counted(placed, sets, least):
        sent.append(placed.count())
        return real(placed, sets, least)

    monkeypatch.setattr(neardup, "compared", counted)
    monkeypatch.setattr(neardup, "MOST", 400)
    totals = []
    for n in (1_500, 3_000):
        sent.clear()
        docs = spark.createDataFrame([(i, t, None, None, None) for i, t in near_copies(n)], SCHEMA).repartition(4)
        assert [r["doc_id"] for r in deduplicated(docs).select("doc_id").collect()] == [0]
        totals.append(sum(sent))
    assert totals[1] <= 2.2 * totals[0] and totals[1] < 2 * 3_000
