import re
from collections import Counter

from pyspark.sql import functions as F

from tidemark.llm.common import stored
from tidemark.llm.quality import MEASURES, fences, measured, quality_counts, quality_filter, sketches
from tidemark.session import table

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def counts(text):
    t = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", t)
    windows = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    seen, covered = Counter(windows), set()
    for i, w in enumerate(windows):
        if seen[w] > 1:
            covered |= {i, i + 1, i + 2}
    lines = [x for x in t.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    n = len(words)
    failed = n < 50 or 100 * len(covered) > 50 * n
    return n, sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", t)), len(lines) - len(set(lines)), len(covered), failed


def test_counts_match_brute_force(spark):
    docs = table(spark, "/root/testdata/sf0.001", "documents")
    got = {r["doc_id"]: tuple(r)[1:7] for r in quality_counts(docs).collect()}
    assert got == {r["doc_id"]: counts(r["text"]) for r in docs.collect()}


def test_edge_cases(spark):
    clean = " ".join(f"wört{i}" for i in range(60))
    rows = [
        (1, None, None, None, None),
        (2, "", "en", "s", 0),
        (3, "a b a b a b a b", "en", "s", 15),
        (4, clean, "en", "s", 1),
        (4, clean, "en", "s", 1),
        (5, "x\n\n \nx\nx ", None, "s", 1),
        (6, " ".join(f"lang{i % 7000}" for i in range(30000)), "en", "s", 1),
        (7, "\x1f  \U0001f600", "en", "s", 1),
        (None, clean + "\t$", "en", None, 1),
    ]
    out = quality_counts(spark.createDataFrame(rows, SCHEMA)).collect()
    assert sorted((str(r["doc_id"]), *tuple(r)[1:7]) for r in out) == sorted((str(r[0]), *counts(r[1])) for r in rows)
    assert all(not (r["base_failed"] and r["kept"]) for r in out)
    assert quality_counts(spark.createDataFrame([], SCHEMA)).count() == 0


def test_filter_keeps_columns_and_repeats(spark):
    clean = " ".join(f"word{i}" for i in range(60))
    docs = spark.createDataFrame([(1, clean, "en", "s", 1, 7, 8), (1, clean, "en", "s", 1, 7, 8), (2, "no", "en", "s", 1, 7, 8)], SCHEMA + ", _m int, Kept int")
    out = quality_filter(docs)
    assert out.columns == docs.columns and [r["doc_id"] for r in out.collect()] == [1, 1]


def test_thresholds_catch_junk_and_keep_clean(spark):
    words = [f"w{i * 7919 % 10007:04d}" for i in range(20000)]
    clean = [(i, " ".join(words[i * 60 : i * 60 + 60]), "en", "a", 1) for i in range(200)]
    junk = [(1000 + i, " ".join(w + "###" for w in words[i * 60 : i * 60 + 60]), "en", "a", 1) for i in range(20)]
    got = {r["doc_id"]: r["kept"] for r in quality_counts(spark.createDataFrame(clean + junk, SCHEMA)).collect()}
    assert all(got[i] for i in range(200)) and not any(got[1000 + i] for i in range(20))


def test_the_quantiles_decide(spark):
    docs, labels = (table(spark, "/root/testdata/sf0.1", t) for t in ("documents", "labels"))
    features = stored(measured(docs.select("doc_id", F.col("text").alias("_text"), F.col("lang").alias("_lang"), F.col("source").alias("_source")), "_text").drop("_text"), "quality")
    limits = fences(sketches(features), 100, 3.0)
    # Every group has fences of its own, in every measure, and no two languages the same ones.
    for name in MEASURES:
        highs = [round(r[0], 6) for r in limits.select(F.col("_fences")[name]["high"]).collect()]
        assert len(highs) == 80 and len(set(highs)) >= 60
    got = quality_counts(docs).join(labels.select("doc_id", "quality"), "doc_id", "left").filter("NOT base_failed").groupBy("quality", "kept").count().collect()
    n = {(r["quality"], r["kept"]): r["count"] for r in got}
    assert n.get((0, True), 0) <= 0.02 * n[0, False] and n[1, False] <= 0.01 * n[1, True]


def test_fences_follow_the_group(spark):
    """The same share of symbols is usual in one source and beyond the fence of another."""
    words = [f"w{i * 7919 % 10007:04d}" for i in range(40000)]
    text = lambda i, signs: " ".join(words[i * 60 : i * 60 + 60 - signs] + ["#"] * signs)
    code = [(i, text(i, 6 + i % 7), "en", "code", 1) for i in range(300)]
    prose = [(1000 + i, text(300 + i, 0), "en", "prose", 1) for i in range(299)] + [(1999, text(200, 12), "en", "prose", 1)]
    got = {r["doc_id"]: r["kept"] for r in quality_counts(spark.createDataFrame(code + prose, SCHEMA), min_rows=10).collect()}
    assert all(got[i] for i in range(300)) and not got[1999] and all(got[1000 + i] for i in range(299))


def test_a_handful_of_documents_stays(spark):
    words = [f"w{i * 7919 % 10007:04d}" for i in range(1000)]
    docs = [(i, " ".join(words[i * 60 : i * 60 + 60 + i]), "en", "s", 1) for i in range(4)]
    assert all(r["kept"] for r in quality_counts(spark.createDataFrame(docs, SCHEMA)).collect())
