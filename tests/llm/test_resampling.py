import hashlib
import math
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tidemark.llm import resampling
from tidemark.llm.resampling import Words, drawn_documents, features, gains, joined, packed, resampled, stored, unpacked
from tidemark.session import table

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def grams(text):
    words = WORD.findall(re.sub("[A-Z]", lambda m: m.group().lower(), text or ""))
    return len(words), [zlib.crc32(" ".join(words[i : i + k]).encode()) % 10_000 for k in (1, 2, 3) for i in range(len(words) - k + 1)]


def brute(docs, target, share=5):
    """Every row's (doc_id, n_features, weight, score, rank), by the plain definition."""
    made = [(doc, *grams(text)) for doc, text in docs]
    s, t = Counter(b for _, _, own in made for b in own), Counter(b for text in target for b in grams(text)[1])
    size_s, size_t = sum(s.values()), sum(t.values())
    gain = [math.floor(1000 * math.log((t[b] + 1) * (size_s + 10_000) / ((s[b] + 1) * (size_t + 10_000)))) for b in range(10_000)]
    rows = []
    for doc, n_words, own in made:
        h = int(hashlib.sha256(f"42:{'' if doc is None else doc}".encode()).hexdigest()[:8], 16)
        weight = sum(gain[b] for b in own)
        rows.append((doc, len(own), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), n_words >= 20))
    able = sorted((r for r in rows if r[4]), key=lambda r: (-r[3], r[0] is None, r[0]))
    drawn = share * len(able) // 100
    ranked = [(*r[:4], i + 1 if i < drawn else None) for i, r in enumerate(able)]
    return Counter(ranked + [(*r[:4], None) for r in rows if not r[4]])


def test_crc_of_joined_messages():
    rng = np.random.default_rng(3)
    parts = [(rng.bytes(int(a)), rng.bytes(int(b))) for a, b in zip(rng.integers(0, 50, 300), rng.integers(0, 3_000, 300), strict=True)]
    crc = lambda side: np.array([zlib.crc32(p[side]) for p in parts], dtype=np.uint32)
    got = joined(crc(0), crc(1), np.array([len(p[1]) for p in parts]))
    assert got.tolist() == [zlib.crc32(a + b) for a, b in parts]


@settings(max_examples=200, deadline=None)
@given(st.lists(st.text(alphabet=st.sampled_from("abAZ019 .,\n\t`{~é日 ​\x7f\x80ÄΣİ"), max_size=60), max_size=5))
def test_random_texts(texts):
    n_words, own = features(texts, Words(), 3, 10_000)
    for text, n, buckets in zip(texts, n_words.tolist(), own, strict=True):
        want = grams(text)
        assert (n, buckets.tolist()) == (want[0], sorted(want[1]))
        assert unpacked(packed(buckets)).tolist() == buckets.tolist()


def test_a_long_text_and_long_words():
    text = " ".join(["x" * 5_000, *("ab" * (i % 40 + 1) for i in range(30_000)), "é" * 3_000])
    assert features([text], Words(), 3, 10_000)[1][0].tolist() == sorted(grams(text)[1])


def test_forgetting_words_changes_nothing(monkeypatch):
    monkeypatch.setattr(resampling, "MOST_WORDS", 2)
    known = Words()
    for text in ("a b c d e", "e d x y z", "a b c"):
        assert features([text], known, 3, 10_000)[1][0].tolist() == sorted(grams(text)[1])


@pytest.mark.parametrize("too_high", [False, True])
def test_documents(spark, monkeypatch, too_high):
    """All of a table against brute force; also where the sketch's bound lets too few rows pass."""
    if too_high:
        real = resampling.F.approx_percentile
        monkeypatch.setattr(resampling.F, "approx_percentile", lambda col, p, n: real(col, resampling.F.lit(1.0), n))
    docs, target = (table(spark, "/root/testdata/sf0.01", t) for t in ("documents", "benchmark"))
    got = resampled(docs, target)
    assert got.dtypes == [(c, "bigint") for c in ("doc_id", "n_features", "weight", "score", "rank")]
    want = brute([(r["doc_id"], r["text"]) for r in docs.select("doc_id", "text").collect()], [r["text"] for r in target.collect()])
    assert Counter(map(tuple, got.collect())) == want
    assert sum(r[4] is not None for r in want) > 30


def test_ties_repeats_and_nulls(spark):
    long = " ".join(f"w{i % 7}" for i in range(25))
    rows = [(1, long), (1, long), (1, long), (None, long), (None, None), (2, ""), (3, None), *((i, f"{long} t{i % 5}") for i in range(4, 90))]
    docs = spark.createDataFrame([(*r, 9) for r in rows], "doc_id long, text string, RANK int")
    target = spark.createDataFrame([("w1 w2 w3 t1",), (None,)], "text string")
    got = resampled(docs, target, share=(40, 100))
    assert Counter(map(tuple, got.collect())) == brute(rows, ["w1 w2 w3 t1", None], 40)
    chosen = {r["doc_id"] for r in got.filter("rank is not null").collect()}
    assert Counter(r["doc_id"] for r in drawn_documents(docs, got).collect()) == Counter(d for d, _ in rows if d in chosen and d is not None)


def test_empty_tables(spark):
    docs = spark.createDataFrame([(1, "a b")], "doc_id long, text string")
    assert resampled(docs.limit(0), docs).count() == 0
    assert Counter(map(tuple, resampled(docs, docs.limit(0)).collect())) == brute([(1, "a b")], [])
    rows = stored(resampling.featurised(docs), "features")
    assert gains(rows, rows).count() == 10_000


def test_the_target_is_preferred(spark):
    """Documents in the target's words are drawn before others."""
    near, far = "alpha beta gamma delta " * 6, "one two three four " * 6
    docs = spark.createDataFrame([(i, near if i % 10 == 0 else far) for i in range(200)], "doc_id long, text string")
    got = resampled(docs, spark.createDataFrame([("alpha beta gamma delta " * 30,)], "text string")).filter("rank is not null").collect()
    assert len(got) == 10 and all(r["doc_id"] % 10 == 0 for r in got)
