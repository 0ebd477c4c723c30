"""Entities in blocks, BLEU and cluster seeds against plain versions."""

import math
import random
import re
import time
from collections import Counter

from pyspark.sql import functions as F

from tidemark.operators import layout as L
from tidemark.operators import results as R
from tidemark.operators import stateful as S


def test_occurrences(spark):
    rng = random.Random(6)
    word = lambda: "".join(rng.choices("abc", k=rng.randint(1, 4)))
    entities = [(p, word()) for p in range(6) for _ in range(8)] + [(0, None), (None, "a"), (1, ""), (9, "zz")]
    blocks = [(p, b, " ".join(word() for _ in range(rng.randint(0, 5)))) for p in range(6) for b in range(12)] + [(0, 50, None), (7, 1, "a b")]
    got = L.occurrences(spark.createDataFrame(entities, "page int, entity string"), spark.createDataFrame(blocks, "page int, block int, text string"), "page")
    want = {(p, b, e, t == e) for p, e in entities if p is not None and e for q, b, t in blocks if p == q and t is not None and e in t}
    rows = [tuple(r) for r in got.select("page", "block", "entity", "exact").collect()]
    assert len(rows) == len(set(rows)) and set(rows) == want


def test_occurrences_of_many_pages(spark):
    """Pages cost their blocks and finds, not a frame each: 60,000 pages took over a minute."""
    pages = spark.range(60_000).select(F.col("id").alias("page"), F.concat(F.lit("e"), F.col("id") % 7).alias("entity"))
    blocks = spark.range(60_000).select(F.col("id").alias("page"), F.lit(0).alias("block"), F.concat(F.lit("has e"), F.col("id") % 5, F.lit(" and e"), F.col("id") % 7).alias("text"))
    began = time.monotonic()
    assert L.occurrences(pages, blocks, "page").agg(F.count("*"), F.count_distinct("page"), F.count_if("exact")).first()[:] == (60_000, 60_000, 0)
    assert time.monotonic() - began < 25


def test_bleu(spark):
    rng = random.Random(2)
    text = lambda: " ".join(rng.choices(["The", "cat", "sat,", "on", "mat!", "a_b"], k=rng.randint(0, 12)))
    rows = [(i, text(), text()) for i in range(80)] + [(100, None, "a"), (101, "a", None), (102, "", ""), (103, "the cat sat on", "The cat sat on")]

    def plain(c, r):
        c, r = (re.findall(r"[\w]+|[^\s\w]", (x or "").lower()) for x in (c, r))
        logs, orders, first = 0.0, 0, 0
        for n in range(1, 5):
            a, b = (Counter(tuple(w[i : i + n]) for i in range(len(w) - n + 1)) for w in (c, r))
            if a:
                hit = sum((a & b).values())
                first = hit if n == 1 else first
                logs += math.log((hit or 0.1) / sum(a.values()))
                orders += 1
        if not first:
            return 0.0
        return (1.0 if len(c) > len(r) else math.exp(1 - len(r) / len(c))) * math.exp(logs / 4 + (4 - orders) / 4 * math.log(0.1))

    got = {r["i"]: r["bleu"] for r in R.bleu(spark.createDataFrame(rows, "i int, c string, r string"), "i", "c", "r").collect()}
    assert all(abs(got[i] - plain(c, r)) < 1e-6 for i, c, r in rows) and len(got) == len(rows)


def test_likely_seeds_leave_no_seed_out():
    rng = random.Random(3)
    word = lambda: "".join(rng.choices("abcdeé日 ", k=rng.randint(0, 14)))
    for least in (0.6, 0.85):
        seeds, kept, left_out = S.LikelySeeds(least), [], 0
        for i in range(150):
            text = word()
            likely = list(seeds.for_text(text))
            assert [s for s in kept if S.ratio(s[1], text) >= least] == [s for s in likely if S.ratio(s[1], text) >= least]
            left_out += len(kept) - len(likely)
            seeds.add(i, text)
            kept.append((i, text))
        assert left_out > 2_000


def test_box_relations(spark):
    """Relations against a plain version, with nulls and flat boxes; the join does not work out a relation to drop it."""
    rng = random.Random(8)
    rows = [(p, i, *(None if rng.random() < 0.05 else float(rng.randint(0, 6)) for _ in range(2))) for p in range(8) for i in range(12)]
    rows = [(p, i, x, y, None if x is None else x + rng.randint(0, 4), None if y is None else y + rng.randint(0, 4)) for p, i, x, y in rows]

    def plain(p, q):
        if None in p or None in q:
            return None
        area = lambda b: (b[2] - b[0]) * (b[3] - b[1])
        w, h = min(p[2], q[2]) - max(p[0], q[0]), min(p[3], q[3]) - max(p[1], q[1])
        if w > 0 and h > 0:
            return "contains" if w * h / area(q) > 0.9 else "contained_by" if w * h / area(p) > 0.9 else "overlaps", w * h / min(area(p), area(q))
        for name, holds in (("above", p[3] < q[1]), ("below", q[3] < p[1]), ("left_of", p[2] < q[0]), ("right_of", q[2] < p[0])):
            if holds:
                return name, 0.8
        return None

    whole = [r for r in rows if None not in r]
    found = S.box_relations(spark.createDataFrame(rows, "page int, item int, x1 double, y1 double, x2 double, y2 double"), "page", "item")
    want = {(p, i, j, *r) for p, i, *b in whole for o, j, *c in whole if p == o and i != j and (r := plain(b, c))}
    assert {tuple(r) for r in found.collect() if not {r["a"], r["b"]} & {i for p, i, *b in rows if p == r["page"] and None in b}} == want
    assert found._jdf.queryExecution().optimizedPlan().toString().count("overlaps") == 1
