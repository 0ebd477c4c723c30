"""Quality rules with adaptive thresholds from mergeable quantile sketches (operator 6, native).

Text measures are taken in the row itself, without a shuffle: words, 3-word windows and lines are arrays of
the row. The thresholds come from quantile sketches with logarithmic buckets (relative error ``ALPHA``): a
sketch is a set of (bucket, count) rows, so merging is a grouped sum that Spark combines on the map side, in
any order, with the same result. Each (lang, source) has its sketch of the documents that pass the base rules.
Its quartiles are drawn towards those of the merged sketch of its language, and these towards those of all
documents, with a weight of ``min_rows`` documents: a small group borrows, a large one stands on its own.

No cutoff is fixed: a fence is a quartile and ``width`` times the distance of the quartiles beyond it, in
buckets, that is on a logarithmic scale. Measures that are zero in most documents (symbols, repeated lines and
words) are smoothed rates, (count + 1/2) / (units + 1), so their quartiles tell how much chance a text of the
group's usual length leaves. A document is rejected where a measure lies beyond its group's fences. One bucket of
the sketch's own error is added to the distance, and the fences are wider, by 1 + min_rows / documents, where the
whole table is too small for quartiles to mean much.

Defined cases: a null text counts as empty (no word, so base_failed); null lang or source form groups of
their own (as the empty string does); repeated rows are counted and judged one by one; equal measures share a
bucket, so a group of equal documents is kept whole; an empty table gives an empty result; documents that fail the
base rules add nothing to a sketch; texts of any length are measured whole, in the memory of their own row;
extra columns travel in one struct, whatever their names.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import BLANKS, WORD, broadcast_if_small, free_names, stored

SYMBOLS = "#*$%&|<>"
#: Relative error of a sketch's quantiles.
ALPHA = 0.005
#: Width of a bucket: the logarithm of the ratio of its ends.
BUCKET = math.log((1 + ALPHA) / (1 - ALPHA))
#: Only word length can be too small as well as too great.
MEASURES = ("word_len", "symbol_share", "dup_line_share", "repeat_share")
TWO_SIDED = "word_len"
MIN_WORDS, MAX_REPEAT_PERCENT = 50, 50


def measured(df: DataFrame, text: str = "text") -> DataFrame:
    """The table with n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words and n_lines in a struct column ``_m``."""
    words, hashes, ranked = "_m_words", "_m_hashes", "_m_ranked"
    t = F.coalesce(F.col(text), F.lit(""))
    df = df.withColumn(words, F.regexp_extract_all(t, F.lit(WORD), F.lit(0)))
    n = F.size(words)
    df = df.withColumn(
        hashes,
        F.when(n >= 3, F.transform(F.sequence(F.lit(0), F.greatest(n - 3, F.lit(0))), lambda i: F.xxhash64(F.get(words, i), F.get(words, i + 1), F.get(words, i + 2)))).otherwise(F.array().cast("array<bigint>")),
    )
    # Only a text with an equal pair of windows is sorted.
    df = df.withColumn(
        ranked,
        F.when(F.size(F.array_distinct(hashes)) < F.size(hashes), F.sort_array(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))),
    )
    twice = F.filter(ranked, lambda x, i: (x["h"] == F.get(ranked, i - 1)["h"]) | (x["h"] == F.get(ranked, i + 1)["h"]))
    starts = F.sort_array(F.transform(twice, lambda x: x["i"]))
    none = F.struct(F.lit(0).alias("n"), F.lit(0).alias("end"))
    covered = F.aggregate(starts, none, lambda s, p: F.struct((s["n"] + p + 3 - F.greatest(s["end"], p)).alias("n"), (p + 3).alias("end")))["n"]
    lines = F.filter(F.split(t, "\n"), lambda x: F.length(F.translate(x, BLANKS, "")) > 0)
    df = df.withColumn(
        "_m",
        F.struct(
            n.cast("long").alias("n_words"),
            F.length(F.translate(t, BLANKS, "")).cast("long").alias("word_chars"),
            (F.length(t) - F.length(F.translate(t, SYMBOLS, ""))).cast("long").alias("n_symbols"),
            lines.alias("lines"),
            F.coalesce(covered, F.lit(0)).cast("long").alias("n_repeat_words"),
        ),
    ).drop(words, hashes, ranked)
    kept = F.size("_m.lines").cast("long")
    return df.withColumn(
        "_m",
        F.struct("_m.n_words", "_m.word_chars", "_m.n_symbols", (kept - F.size(F.array_distinct("_m.lines"))).alias("n_dup_lines"), "_m.n_repeat_words", kept.alias("n_lines")),
    )


def _buckets(m: str) -> dict[str, Column]:
    """The bucket of each measure."""
    of = lambda count, units: (F.col(f"{m}.{count}") + 0.5) / (F.col(f"{m}.{units}") + 1)
    measures = {
        "word_len": F.col(f"{m}.word_chars") / F.nullif(F.col(f"{m}.n_words").cast("double"), F.lit(0.0)),
        "symbol_share": of("n_symbols", "n_words"),
        "dup_line_share": of("n_dup_lines", "n_lines"),
        "repeat_share": of("n_repeat_words", "n_words"),
    }
    return {k: F.ceil(F.round(F.log(x) / F.lit(BUCKET), 6)).cast("int") for k, x in measures.items()}


def base_failed(m: str = "_m") -> Column:
    return (F.col(f"{m}.n_words") < MIN_WORDS) | (100 * F.col(f"{m}.n_repeat_words") > MAX_REPEAT_PERCENT * F.col(f"{m}.n_words"))


def sketches(features: DataFrame) -> DataFrame:
    """Sketch rows (lang, source, measure, bucket, n) of the documents that pass the base rules."""
    pairs = F.array(*[F.struct(F.lit(k).alias("measure"), b.alias("bucket")) for k, b in _buckets("_m").items()])
    rows = features.filter(~base_failed()).select("_lang", "_source", F.explode(pairs).alias("_p")).select("_lang", "_source", "_p.*")
    return rows.groupBy("_lang", "_source", "measure", "bucket").agg(F.count("*").alias("n"))


def merged_quantiles(sketch: DataFrame, keys: list[str], probabilities: tuple[float, ...] = (0.25, 0.75)) -> DataFrame:
    """Merge sketches by the keys and the measure; q_0, q_1, ... are the quantiles' buckets and n the documents."""
    by = [*keys, "measure"]
    merged = sketch.groupBy(*by, "bucket").agg(F.sum("n").alias("n"))
    # One sketch has at most a few thousand buckets, however many rows it stands for.
    held = merged.groupBy(*by).agg(F.sort_array(F.collect_list(F.struct("bucket", "n"))).alias("b"), F.sum("n").alias("n"))

    def quantile(p: float) -> Column:
        rank = F.floor(F.lit(p) * (F.col("n") - 1)).cast("long")
        zero = F.struct(F.lit(0).cast("long").alias("seen"), F.lit(None).cast("int").alias("at"))
        return F.aggregate("b", zero, lambda s, x: F.struct((s["seen"] + x["n"]).alias("seen"), F.when(s["at"].isNull() & (s["seen"] + x["n"] > rank), x["bucket"]).otherwise(s["at"]).alias("at")))["at"]

    return held.select(*by, "n", *[quantile(p).cast("double").alias(f"q_{i}") for i, p in enumerate(probabilities)])


def fences(sketch: DataFrame, min_rows: int, width: float) -> DataFrame:
    """Per (lang, source): a low and a high fence of each measure, in buckets, from its quartiles and those it borrows from."""
    levels = [merged_quantiles(sketch, ["_lang", "_source"]), merged_quantiles(sketch, ["_lang"]), merged_quantiles(sketch, [])]
    own, lang, every = [x.select(*[c for c in x.columns if c[0] == "_" or c == "measure"], F.struct("n", "q_0", "q_1").alias(name)) for x, name in zip(levels, ("own", "by_lang", "by_all"), strict=True)]
    table = own.join(lang, ["_lang", "measure"]).join(every, ["measure"])

    def drawn(of: str, to: Column, q: str) -> Column:
        return (F.col(f"{of}.n") * F.col(f"{of}.{q}") + min_rows * to) / (F.col(f"{of}.n") + min_rows)

    low, high = (drawn("own", drawn("by_lang", F.col(f"by_all.{q}"), q), q) for q in ("q_0", "q_1"))
    table = table.select("_lang", "_source", "measure", low.alias("q_0"), high.alias("q_1"), (F.lit(width) * (1 + min_rows / F.col("by_all.n"))).alias("wide"))
    reach = F.col("wide") * (F.col("q_1") - F.col("q_0") + 1)
    limits = F.struct(F.when(F.col("measure") == TWO_SIDED, F.col("q_0") - reach).alias("low"), (F.col("q_1") + reach).alias("high"))
    return table.groupBy("_lang", "_source").agg(F.map_from_entries(F.collect_list(F.struct(F.col("measure"), limits))).alias("_fences"))


def judged(docs: DataFrame, keep: list[str], min_rows: int = 100, width: float = 3.0) -> DataFrame:
    """The kept columns of each document, the counts in ``_m``, and ``_base_failed`` and ``_kept``.

    Each document passes the base rules and then the fences of its own (lang, source).
    """
    ready = docs.select(*keep, F.col("text").alias("_text"), F.coalesce("lang", F.lit("")).alias("_lang"), F.coalesce("source", F.lit("")).alias("_source"))
    features = stored(measured(ready, "_text").drop("_text"), "quality")
    limits = broadcast_if_small(stored(fences(sketches(features), min_rows, width), "fences"))
    inside = F.lit(True)
    for name, bucket in _buckets("_m").items():
        limit = F.col("_fences")[name]
        inside &= F.coalesce(bucket <= limit["high"], F.lit(True)) & F.coalesce(bucket >= limit["low"], F.lit(True))
    return features.join(limits, ["_lang", "_source"], "left").withColumn("_base_failed", base_failed()).withColumn("_kept", ~base_failed() & inside).drop("_fences", "_lang", "_source")


def quality_counts(docs: DataFrame, min_rows: int = 100, width: float = 3.0) -> DataFrame:
    """One row a document: doc_id, the counts, base_failed, kept."""
    return judged(docs, ["doc_id"], min_rows, width).select(
        "doc_id", "_m.n_words", "_m.word_chars", "_m.n_symbols", "_m.n_dup_lines", "_m.n_repeat_words", F.col("_base_failed").alias("base_failed"), F.col("_kept").alias("kept")
    )


def quality_filter(docs: DataFrame, min_rows: int = 100, width: float = 3.0) -> DataFrame:
    """The documents that pass, with their own columns. Names that start with an underscore stay usable: columns travel in one struct."""
    (box,) = free_names(docs, "_row")
    packed = docs.select(F.struct(*docs.columns).alias(box), "text", "lang", "source")
    return judged(packed, [box]).filter("_kept").select(f"{box}.*")
