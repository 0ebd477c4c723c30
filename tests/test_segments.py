"""Combined segment results against a plain version, and aggregates of one's own against numpy."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.operators import segments as S
from tidemark.operators.aggregates import Moments, TDigest, aggregated

ENGINES = [("tab", 0, ["table"], 2), ("gen", 1, list(S.TAKES["general"]), None), ("spare", 2, ["table", "formula"], 1)]


def tables(spark, seed=5):
    rng = random.Random(seed)
    segments = [(p, s, rng.choice(["table", "text", "formula", "image"]) if p else "image", rng.randint(0, 50), rng.randint(0, 50), 60, 60) for p in range(12) for s in range(8)]
    results = [(p, s, e, b, rng.randint(0, 9), rng.randint(0, 9), 10, 10, f"{e}{b}", rng.randint(0, 8) / 8) for p, s, *_ in segments for e, *_ in ENGINES for b in range(2)]
    a = spark.createDataFrame(segments, "page int, segment int, kind string, x1 int, y1 int, x2 int, y2 int")
    r = spark.createDataFrame(results, "page int, segment int, engine string, block int, bx1 int, by1 int, bx2 int, by2 int, text string, confidence double")
    return segments, results, S.assigned(a, spark.createDataFrame(ENGINES, "engine string, place int, takes array<string>, most int")), r


def plain(segments):
    out, whole = {}, set()
    for page in {s[0] for s in segments}:
        load = {}
        for s in sorted((s for s in segments if s[0] == page), key=lambda s: (s[4], s[3], s[1])):
            for e, _, takes, most in ENGINES:
                if s[2] in takes and (most is None or load.get((e, s[2]), 0) < most):
                    load[e, s[2]] = load.get((e, s[2]), 0) + 1
                    out[page, s[1]] = e
                    break
        if not load:
            whole.add(page)
            out |= {(page, s[1]): "tab" for s in segments if s[0] == page}
    return out, whole


@pytest.mark.parametrize("height", [None, 15.0])
def test_combined(spark, height):
    segments, results, placed, r = tables(spark)
    engine, whole = plain(segments)
    assert {(x["page"], x["segment"]): x["engine"] for x in placed.filter("engine IS NOT NULL").collect()} == engine and 0 in whole
    place = {e: p for e, p, *_ in ENGINES}
    got = S.reading_order(S.on_page(placed, r), height).collect()
    want = {}
    for p, s, e, b, x, y, *_, text, _ in results:
        if engine.get((p, s)) == e:
            corner = (0, 0) if p in whole else next((t[3], t[4]) for t in segments if t[:2] == (p, s))
            want.setdefault(p, []).append((x + corner[0], y + corner[1], place[e], s, b, text))
    for page, blocks in want.items():
        blocks.sort(key=lambda t: (t[1], t[2:5]) if height is None else (t[1] // height, t[0], t[1], t[2:5]))
        assert [(g["x1"], g["y1"], g["place"], g["segment"], g["block"], g["text"]) for g in sorted(got, key=lambda g: g["position"]) if g["page"] == page] == blocks
        assert sorted(g["position"] for g in got if g["page"] == page) == list(range(1, len(blocks) + 1))
    sums = {g["page"]: g for g in S.pages(placed, r).collect()}
    for page in range(12):
        own = [np.mean([c[9] for c in results if c[:3] == (page, s, e)]) for (p, s), e in engine.items() if p == page]
        assert sums[page]["segments"] == len(own) and sums[page]["confidence"] == pytest.approx(np.mean(own) if own else 0, abs=1e-6)
        assert sums[page]["engines"] == ",".join(e for e, *_ in ENGINES if e in {v for (p, _), v in engine.items() if p == page})


def blocks_in_order(df):
    return sorted(tuple(r) for r in df.select("page", "position", "place", "segment", "block", "x1", "y1", "text", "confidence").collect())


@pytest.mark.parametrize("height", [None, 15.0])
def test_blocks_are_worked_out_once(spark, height):
    """The reading order counted bands in a second run of all that its blocks came from."""
    _, _, placed, r = tables(spark)
    blocks, met = S.on_page(placed, r), spark.sparkContext.accumulator(0)

    def counted(batches):
        for batch in batches:
            met.add(len(batch))
            yield batch

    got = S.reading_order(blocks.mapInPandas(counted, blocks.schema), height)
    assert blocks_in_order(got) == blocks_in_order(S.reading_order(blocks, height))
    assert met.value == blocks.count() > 0


@pytest.mark.parametrize("height", [None, 15.0])
@pytest.mark.parametrize("most", [0, 12])
def test_long_pages_are_counted_in_bands(spark, height, most):
    _, _, placed, r = tables(spark)
    blocks = S.on_page(placed, r)
    per = [x["count"] for x in blocks.groupBy("page").count().collect()]
    assert max(per) > most and (most == 0 or min(per) <= most)
    assert blocks_in_order(S.reading_order(blocks, height, most)) == blocks_in_order(S.reading_order(blocks, height))


def test_segments_that_hold_what_engines_read(spark):
    _, _, placed, r = tables(spark)
    own = F.collect_list(F.struct("engine", "block", "bx1", "by1", "bx2", "by2", "text", "confidence")).alias("reads")
    held = placed.join(r.groupBy("page", "segment").agg(own), ["page", "segment"], "left")
    rows = lambda df: sorted(map(tuple, df.collect()))
    assert rows(S.on_page(held)) == rows(S.on_page(placed, r))
    assert rows(S.pages(held)) == rows(S.pages(placed, r))


def test_nothing_to_combine(spark):
    _, _, placed, r = tables(spark)
    assert S.pages(placed, r.limit(0)).filter("segments = 0 AND confidence = 0 AND engines = ''").count() == 12
    assert S.reading_order(S.on_page(placed.limit(0), r)).count() == 0


def keyed(spark, n=60_000):
    return spark.range(0, n, 1, 13).select(F.when(F.col("id") % 3 > 0, "hot").when(F.col("id") % 11 == 0, F.lit(None)).otherwise(F.concat(F.lit("k"), F.col("id") % 5)).alias("key"), F.when(F.col("id") % 97 > 0, F.exp(F.randn(3) * 2)).alias("x"))


def test_digest_and_moments(spark):
    df = keyed(spark).cache()
    values = {}
    for r in df.filter("x IS NOT NULL").collect():
        values.setdefault(r["key"], []).append(r["x"])
    shares = (0.001, 0.25, 0.5, 0.9, 0.999)
    digest = TDigest(shares)
    got = {r["key"]: r for r in aggregated(df, "key", "x", digest, parts=3).collect()}
    exact = {r["key"]: r for r in aggregated(df, "key", "x", Moments()).collect()}
    assert set(got) == set(exact) == set(values)
    for key, own in values.items():
        own = np.sort(own)
        assert (got[key]["n"], got[key]["low"], got[key]["high"]) == (len(own), own[0], own[-1])
        for p in shares:
            rank = np.searchsorted(own, got[key][f"q{round(p * 1000):03d}"]) / len(own)
            assert abs(rank - p) <= np.pi * np.sqrt(p * (1 - p)) / digest.size + 2 / len(own)
        off = own - own.mean()
        assert exact[key]["variance"] == pytest.approx(own.var(), rel=1e-9)
        assert exact[key]["skewness"] == pytest.approx((off**3).mean() / own.std() ** 3, rel=1e-9)
        assert exact[key]["kurtosis"] == pytest.approx((off**4).mean() / own.var() ** 2 - 3, rel=1e-9)
    df.unpersist()


def test_aggregates_of_little(spark, monkeypatch):
    df = spark.createDataFrame([("a", 2.0), ("a", None), ("b", None), ("c", float("nan")), ("d", 1.0), ("d", 1.0)], "key string, x double")
    assert sorted(map(tuple, aggregated(df, "key", "x", Moments()).collect())) == [("a", 1, 2.0, 0.0, None, None), ("d", 2, 1.0, 0.0, None, None)]
    assert sorted(map(tuple, aggregated(df, "key", "x", TDigest((0.5,))).collect())) == [("a", 1, 2.0, 2.0, 2.0), ("d", 2, 1.0, 1.0, 1.0)]
    assert aggregated(df.limit(0), "key", "x", Moments()).count() == 0
