import hashlib
import math
import re
from collections import Counter, defaultdict

import pytest

from tidemark.llm.mixing import mixed, mixture
from tidemark.session import table

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def key(*parts):
    return int(hashlib.md5("|".join("~" if p is None else str(p) for p in parts).encode()).hexdigest()[:15], 16)


def brute(rows, entropy, repetition, budget, block_docs, whole=False, seed="mix"):
    docs = [(d, s or "", len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))) for d, t, s in rows]
    total, count = Counter(), Counter()
    for _, s, n in docs:
        total[s] += n
        count[s] += 1
    every = sum(total.values())
    p = {s: n / every for s, n in total.items() if n}
    z = lambda a: sum(v**a for v in p.values())
    h = lambda a: math.log(z(a)) - a * sum(v**a * math.log(v) for v in p.values()) / z(a)

    def bisect(flat):
        if not flat(0.0):
            return 0.0
        low, high = 0.0, 1.0
        for _ in range(50):
            mid = (low + high) / 2
            low, high = (mid, high) if flat(mid) else (low, mid)
        return high

    def often(a):
        most = max(v ** (a - 1) for v in p.values())
        return most / max(p.values()) ** (a - 1) if whole else most / z(a) * (1 if budget is None else budget / every)

    a = max(bisect(lambda a: h(a) > entropy * math.log(len(p))), bisect(lambda a: often(a) > repetition)) if p else 0
    if whole:
        budget = math.ceil(every * max(p.values()) * z(a) / max(p.values()) ** a)
    out = Counter()
    for s in total:
        own = [(d, n, key(seed, s, d)) for d, x, n in docs if x == s]
        goal = math.floor(p[s] ** a / z(a) * (every if budget is None else budget) + 1e-6) if total[s] else 0
        full = goal // total[s] if total[s] else 1
        for d, _, _ in own:
            out[d] += full
        left = goal - full * total[s]
        if not total[s]:
            continue
        blocks = defaultdict(list)
        for d, n, x in own:
            blocks[x % math.ceil(count[s] / block_docs)].append((x, d, n))
        for b in sorted(blocks, key=lambda b: (key(seed, s, full, b), b)):
            size = sum(n for _, _, n in blocks[b])
            if left <= 0:
                break
            for x in sorted({x for x, _, _ in blocks[b]}):
                same = [(d, n) for y, d, n in blocks[b] if y == x]
                if sum(n for _, n in same) > left:
                    break
                left -= sum(n for _, n in same)
                size -= sum(n for _, n in same)
                for d, _ in same:
                    out[d] += 1
            if size:
                break
    return Counter({d: n for d, n in out.items() if n})


def rows_of(spark):
    docs = table(spark, "/root/testdata/sf0.01", "documents").filter("doc_id < 900")
    # Uneven sources: a third of the rows in one.
    return docs.selectExpr("doc_id", "text", "lang", "CASE WHEN doc_id % 3 = 0 THEN 'hot' WHEN doc_id % 50 = 1 THEN NULL ELSE source END AS source", "n_chars")


@pytest.mark.parametrize(("entropy", "repetition", "budget"), [(0.95, 4.0, None), (0.999, 1.5, None), (0.9, 8.0, 1_000_000), (0.95, 4.0, 0)])
def test_matches_brute_force(spark, entropy, repetition, budget):
    docs = rows_of(spark)
    got = Counter(r["doc_id"] for r in mixture(docs, entropy, repetition, budget, block_docs=16).collect())
    assert got == brute([(r["doc_id"], r["text"], r["source"]) for r in docs.collect()], entropy, repetition, budget, 16)


def test_whole_mixture_keeps_every_document(spark):
    docs = rows_of(spark)
    out = mixed(docs, 0.97, 2.0, block_docs=16)
    got = Counter(r["doc_id"] for r in out.collect())
    assert out.columns == docs.columns and set(got) == {r["doc_id"] for r in docs.collect()} and max(got.values()) in (2, 3)
    assert got == brute([(r["doc_id"], r["text"], r["source"]) for r in docs.collect()], 0.97, 2.0, None, 16, True)


def test_edge_cases(spark):
    rows = [(1, None, "en", "a", 0), (2, "", "en", "a", 0), (None, "x y", "en", "a", 0), (3, "word " * 50_000, "en", "b", 0), (4, "q", None, None, 0), (4, "q", None, None, 0), (5, "", "en", "empty", 0)]
    docs = spark.createDataFrame([(*r, 1) for r in rows], SCHEMA + ", _tokens int")
    got = Counter(r["doc_id"] for r in mixture(docs).collect())
    assert got == brute([(r[0], r[1], r[3]) for r in rows], 0.95, 4.0, None, 1024)
    assert mixed(docs).columns == docs.columns
    assert mixture(docs.limit(0)).count() == 0 and mixed(docs.limit(0)).count() == 0
    assert mixture(docs.filter("source = 'empty'")).count() == 1
