import re
import time
from difflib import SequenceMatcher

import pytest
from pyspark.sql import functions as F

from tidemark import registry
from tidemark.functions import chunking as C
from tidemark.functions import extract as X
from tidemark.operators import stateful as S
from tidemark.session import table

SF = "/root/testdata/sf0.001"


def windows(text, size, overlap):
    out, start = [], 0
    while text:
        end = min(start + size, len(text))
        if end < len(text):
            found = [p for p in (text.find(c, end) for c in ".\n ") if p >= 0]
            end = min(found) + 1 if found else end
        out.append((start, end))
        if end >= len(text):
            break
        start = end - overlap
    return out


def test_fixed_windows(spark):
    docs = table(spark, SF, "documents").unionByName(spark.createDataFrame([(-1, "", None, None, 0), (-2, "x" * 3000, None, None, 0)], table(spark, SF, "documents").schema))
    for r in docs.select("text", C.fixed_windows(F.col("text"), 300, 50).alias("w")).collect():
        assert [tuple(x) for x in r["w"]] == windows(r["text"], 300, 50)


def test_sections(spark):
    for r in table(spark, SF, "documents").select("text", C.section_starts(F.col("text"), 400).alias("s")).collect():
        want, size = [], 0
        for i, line in enumerate(r["text"].split("\n")):
            if i == 0 or re.search("|".join(C.HEADINGS), line) or size > 400:
                want.append(i)
                size = 0
            size += len(line) + 1
        assert r["s"] == want


def test_fixed_windows_of_a_long_text(spark):
    """A window costs what it holds, not the text before it: two million characters took minutes. Without a stop, and null and empty texts."""
    texts = ["word and. more\n" * 140_000, "x" * 500_000, "é日 " + "x" * 5_000 + ".", "", None]
    began = time.monotonic()
    got = [r["w"] for r in spark.createDataFrame(list(enumerate(texts)), "i int, text string").repartition(1).orderBy("i").select(C.fixed_windows(F.col("text")).alias("w")).collect()]
    assert time.monotonic() - began < 30
    assert [w and [tuple(x) for x in w] for w in got] == [windows(texts[0], 1000, 200), windows(texts[1], 1000, 200), windows(texts[2], 1000, 200), [], None]


def test_syntactic_pairs(spark):
    """A text without a pattern's words is not searched by it: of one long word each letter was a start."""
    rows = [(0, "a" * 60_000), (1, "A works for B works at C. D is located in E and F owns G_1 owns H"), (2, None), (3, " works for  owns "), (4, "Äb is part of oil, X founded Y created Z")]
    began = time.monotonic()
    got = {r["i"]: r["p"] and [tuple(x) for x in r["p"]] for r in spark.createDataFrame(rows, "i int, text string").select("i", X.syntactic_pairs(F.col("text")).alias("p")).collect()}
    assert time.monotonic() - began < 8
    assert got == {0: [], 1: [("works_for", "A", "B"), ("located_in", "D", "E"), ("owns", "F", "G_1")], 2: None, 3: [], 4: [("part_of", "b", "oil"), ("created", "X", "Y")]}


def test_packed_sentences_lose_nothing(spark):
    for r in table(spark, SF, "documents").select("text", C.packed_sentences(F.col("text"), 300).alias("p")).collect():
        assert " ".join(r["p"]).split() == r["text"].split()


def test_anchored_groups(spark):
    df = spark.createDataFrame([("p", i, c) for i, c in enumerate([0.0, 0.04, 0.08, 0.09, 0.5, 0.53, 0.56])], "page string, id long, y double")
    got = {r["id"]: r["anchor"] for r in S.anchored_groups(df, "page", "id", "y", 0.05).collect()}
    assert got == {0: 0.0, 1: 0.0, 2: 0.08, 3: 0.08, 4: 0.5, 5: 0.5, 6: 0.56}


def test_anchored_groups_of_many_short_pages(spark):
    """Pages cost their rows, not a frame each: 120,000 runs took minutes that way."""
    pages = spark.range(40_000).select(F.col("id").alias("page"), F.explode(F.sequence(F.lit(0), F.lit(2))).alias("item")).withColumn("y", (F.col("item") * F.when(F.col("page") % 2 == 0, 1.0).otherwise(0.01)))
    began = time.monotonic()
    got = S.anchored_groups(pages, "page", "item", "y", 0.015)
    wrong = F.count_if(F.col("anchor") != F.when(F.col("page") % 2 == 0, F.col("item").cast("double")).when(F.col("item") == 2, 0.02).otherwise(0.0))
    assert tuple(got.agg(F.count("*"), wrong).first()) == (120_000, 0)
    assert time.monotonic() - began < 30


def test_greedy_clusters(spark):
    rows = [("a", 1, "John Doe"), ("a", 2, "John  Doe"), ("a", 3, "Jane Smith"), ("b", 4, "John Doe"), ("a", 5, None)]
    got = {r["id"]: r["seed"] for r in S.greedy_clusters(spark.createDataFrame(rows, "kind string, id long, label string"), "kind", "id", "label", 0.85).collect()}
    assert got == {1: 1, 2: 1, 3: 3, 4: 4, 5: 5}
    names = spark.createDataFrame([("kitten sat", "sitting cat"), (None, "x")], "a string, b string")
    assert [r[0] for r in names.select(S.string_ratio("a", "b")).collect()] == [pytest.approx(SequenceMatcher(None, "kitten sat", "sitting cat").ratio()), 0.0]


def test_word_error_rate(spark):
    df = spark.createDataFrame([("the cat sat", "the cat sat on"), ("a b", "c d"), ("", "")], "r string, h string")
    assert [r[0] for r in df.select(S.word_error_rate(F.col("r"), F.col("h"))).collect()] == [pytest.approx(1 / 3), 1.0, 0.0]


def test_stream_equals_batch(spark):
    stream, batch = (sorted(map(tuple, registry.queries()[n](spark, "/root/testdata/sf0.01").select("event_type", "event_id").collect())) for n in ("e11_streamed_cooldown", "e11_cooled_down_alerts"))
    assert stream == batch and len(batch) > 10


def test_stream_of_part_files(spark, tmp_path):
    table(spark, "/root/testdata/sf0.01", "events").repartition(3).write.parquet(f"{tmp_path}/events.parquet")
    for name in ("k01_streamed_windows", "k06_streamed_thresholds"):
        parts, one = (sorted(map(tuple, registry.queries()[name](spark, d).collect())) for d in (str(tmp_path), "/root/testdata/sf0.01"))
        assert parts == one and len(one) > 10
