"""Merging, judging and selecting results: documents, runs, phases, texts against references, retrieval over given vectors."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from collections import Counter
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import functions as F

# The sixteen classes of documents, and what each feature adds to them.
CLASSES = ["invoice", "receipt", "contract", "letter", "resume", "report", "form", "article", "presentation", "spreadsheet", "academic_paper", "legal_document", "manual", "certificate", "id_document", "medical_record"]
FEATURES = {
    "tables": {"report": 0.4, "invoice": 0.3, "spreadsheet": 0.3},
    "forms": {"form": 0.7},
    "signatures": {"contract": 0.5, "letter": 0.3, "legal_document": 0.4},
    "many_blocks": {"report": 0.3, "article": 0.5, "academic_paper": 0.3},
    "header_footer": {"letter": 0.4, "report": 0.3},
    "sections_and_references": {"academic_paper": 0.6},
    "currency": {"invoice": 0.5, "receipt": 0.6},
    "serif": {"legal_document": 0.3, "contract": 0.2},
    "sans_serif": {"manual": 0.3, "report": 0.2},
}


def merged_documents(parts: DataFrame, key: str, position: str, text: str, sections: str) -> DataFrame:
    """The texts of a document's parts that have one, with a blank line between, and all their sections, both in order."""
    ordered = F.sort_array(F.collect_list(F.struct(F.col(position).alias("p"), F.col(text).alias("t"), F.col(sections).alias("s"))))
    grouped = parts.groupBy(key).agg(ordered.alias("o"))
    texts = F.filter(F.transform("o", lambda x: x["t"]), lambda t: F.coalesce(t, F.lit("")) != "")
    return grouped.select(key, F.array_join(texts, "\n\n").alias("text"), F.flatten(F.transform("o", lambda x: F.coalesce(x["s"], F.array().cast("array<string>")))).alias("sections"))


def merged_lists(structures: DataFrame, key: str, name: str, values: str) -> DataFrame:
    """The distinct values of each named list over all structures of a key."""
    return structures.select(key, name, F.explode(values).alias("v")).groupBy(key, name).agg(F.sort_array(F.collect_set("v")).alias(values))


def merged_pair(a: Column, a_confidence: Column, b: Column, b_confidence: Column, similarity: Column) -> Column:
    """Where two readings are alike (> .8) the surer one, else both, with the mean confidence; one that is missing gives way."""
    result = lambda content, confidence, method: F.struct(content.alias("content"), confidence.cast("double").alias("confidence"), F.lit(method).alias("method"))
    first, second = result(a, a_confidence, "first"), result(b, b_confidence, "second")
    both = result(F.concat(a, F.lit("\n\n=== Alternative Extraction ===\n\n"), b), (a_confidence + b_confidence) / 2, "hybrid")
    return F.when(b.isNull(), first).when(a.isNull(), second).when(similarity > 0.8, F.when(a_confidence >= b_confidence, first).otherwise(second)).otherwise(both)


def metric_means(results: DataFrame, by: str, metrics: str) -> DataFrame:
    """for each metric of a map the sum over ALL rows of the run, and the sample deviation of those that have it (0 for one)."""
    rows = results.groupBy(by).agg(F.count("*").alias("rows"))
    each = results.select(by, F.explode(metrics).alias("metric", "x")).filter("x IS NOT NULL")
    stats = each.groupBy(by, "metric").agg(F.sum("x").alias("total"), F.coalesce(F.stddev_samp("x"), F.lit(0.0)).alias("std"))
    return stats.join(rows, by).select(by, "metric", F.round(F.col("total") / F.col("rows"), 6).alias("avg"), F.round("std", 4).alias("std"))


def context_summary(events: DataFrame, key: str, at: Column, step: str, seconds: str) -> DataFrame:
    """per context the flow of steps in order, its number, total seconds, and counts of errors."""
    flow = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct(at.alias("at"), F.col(step).alias("s")))), lambda x: x["s"]), ">")
    return events.groupBy(key).agg(flow.alias("flow"), F.count("*").alias("steps"), F.round(F.sum(seconds), 4).alias("seconds"), F.count_if(F.col(step) == "error").alias("errors"))


def phase_summary(events: DataFrame, key: str, phase: str, seconds: str, status: Column) -> DataFrame:
    """phases with runs and duration, and the pipeline's status: failed if one failed, completed if all are, else running."""
    per = events.withColumn("_s", status).groupBy(key, phase).agg(F.count("*").alias("runs"), F.round(F.sum(seconds), 4).alias("duration"), F.count_if(F.col("_s") == "failed").alias("failed"), F.count_if(F.col("_s") == "completed").alias("completed"))
    every = Window.partitionBy(key)
    whole = F.when(F.sum("failed").over(every) > 0, "failed").when(F.sum("completed").over(every) == F.sum("runs").over(every), "completed").otherwise("running")
    return per.select(key, phase, "runs", "duration", whole.alias("status"))


def bleu(pairs: DataFrame, key: str, candidate: str, reference: str, longest: int = 4, epsilon: float = 0.1) -> DataFrame:
    """Sentence BLEU with clipped n-grams up to four; an n without a hit counts epsilon. A row counts its own n-grams; nothing is shuffled."""
    words = lambda c: F.regexp_extract_all(F.lower(c), F.lit(r"[\p{L}\p{N}_]+|[^\s\p{L}\p{N}_]"), F.lit(0))

    @F.pandas_udf("array<long>")
    def hits(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        grams = lambda w, n: Counter(zip(*[w[i:] for i in range(n)], strict=False))
        for left, right in batches:
            out = []
            for a, b in zip(left, right, strict=True):
                a, b = (() if x is None else tuple(x) for x in (a, b))
                out.append([(grams(a, n) & grams(b, n)).total() for n in range(1, longest + 1)])
            yield pd.Series(out)

    sides = pairs.select(key, words(F.col(candidate)).alias("c"), words(F.col(reference)).alias("r"))
    met = sides.select(key, F.size("c").alias("nc"), F.size("r").alias("nr"), hits("c", "r").alias("h"))
    logs, orders = F.lit(0.0), F.lit(0)
    for n in range(1, longest + 1):
        found, of = F.get("h", F.lit(n - 1)), F.col("nc") - (n - 1)
        logs = logs + F.when(of > 0, F.ln(F.when(found > 0, found.cast("double")).otherwise(F.lit(epsilon)) / of)).otherwise(0.0)
        orders = orders + (of > 0).cast("int")
    brevity = F.when(F.col("nc") > F.col("nr"), 1.0).otherwise(F.exp(1.0 - F.col("nr") / F.nullif(F.col("nc"), F.lit(0))))
    score = F.when(F.coalesce(F.get("h", F.lit(0)), F.lit(0)) == 0, 0.0).otherwise(brevity * F.exp(logs / longest + (longest - orders) / longest * F.ln(F.lit(epsilon))))
    return met.select(key, F.round(score, 6).alias("bleu"))


def document_classes(features: dict[str, Column]) -> Column:
    """For each class the sum of what the features that hold add, over the greatest sum, to the power .7; all 0 without a feature."""
    sums = {c: sum((F.when(features[f], w[c]).otherwise(0.0) for f, w in FEATURES.items() if c in w and f in features), F.lit(0.0)) for c in CLASSES}
    most = F.nullif(F.greatest(*sums.values()), F.lit(0.0))
    return F.array(*[F.struct(F.lit(c).alias("class"), F.round(F.least(F.lit(1.0), F.coalesce(F.pow(x / most, F.lit(0.7)), F.lit(0.0))), 6).alias("score")) for c, x in sums.items()])


def to_be_chunked(megabytes: Column, pages: Column, complexity: Column) -> Column:
    """Over 20 MB, over 50 pages, or complex (> .7) and over 10 MB or 30 pages."""
    return (megabytes > 20) | (pages > 50) | ((complexity > 0.7) & ((megabytes > 10) | (pages > 30)))


def chunking_strategy(size: Column, images: Column, text: Column) -> Column:
    """Method, chunk size and overlap from a file's size and content: bytes."""
    base = F.when(size < 1024 * 1024, 100 * 1024).when(size > 50 * 1024 * 1024, 5 * 1024 * 1024).otherwise(1024 * 1024)
    hybrid = text & (size > 10 * 1024 * 1024)
    chunk = F.when(images, F.greatest(base, F.lit(2 * 1024 * 1024))).when(hybrid, F.least(base, F.lit(3 * 1024 * 1024))).otherwise(base)
    return F.struct(F.when(images, "content").when(hybrid, "hybrid").otherwise("size").alias("method"), chunk.alias("chunk"), F.floor(chunk * 0.1).cast("int").alias("overlap"))


def processing_category(kind: Column, extension: Column, scanned: Column, image_ratio: Column) -> Column:
    """H100: text, image, pdf, office or hybrid by type, extension and share of images."""
    pdf = F.when(scanned | (image_ratio > 0.6), "image").when(image_ratio > 0.3, "hybrid").otherwise("pdf")
    return (
        F.when((kind == "image") | extension.isin("png", "jpg", "jpeg", "tiff", "bmp", "gif"), "image")
        .when(kind == "pdf", pdf)
        .when(kind.isin("document", "spreadsheet", "presentation") | extension.isin("docx", "doc", "xlsx", "xls", "pptx", "ppt"), "office")
        .when((kind == "text") | extension.isin("txt", "md", "csv", "json", "xml", "html"), "text")
        .otherwise("hybrid")
    )


def required_capabilities(kind: Column, scanned: Column, images: Column, image_ratio: Column, tables: Column, forms: Column, layout: Column) -> Column:
    """Capabilities with the least confidence that a document asks for, as a map."""
    office = kind.isin("document", "spreadsheet", "presentation")
    pairs = {
        "scanned_documents": F.when(scanned, 0.7),
        "images": F.when(kind == "image", 0.9).when(images, F.when(image_ratio > 0.5, 0.8).otherwise(0.5)),
        "tables": F.when(tables, 0.7),
        "forms": F.when(forms, 0.8),
        "complex_layouts": F.when(layout, 0.7),
        "pdfs": F.when(kind == "pdf", 0.8),
        "office_documents": F.when(office, 0.8),
        "mixed_content": F.when(images & tables & layout, 0.8),
        "text_extraction": F.when(kind == "image", 0.6).when(kind == "pdf", 0.7).otherwise(0.5),
    }
    made = F.map_from_arrays(F.array(*map(F.lit, pairs)), F.array(*pairs.values()))
    return F.map_filter(made, lambda k, v: v.isNotNull())


def filtered_hits(hits: DataFrame, score: str, key: str, n: int, **wanted: str) -> DataFrame:
    """C14: the n best hits whose fields equal the filters; a field that is missing passes."""
    for name, value in wanted.items():
        hits = hits.filter(F.col(name).isNull() | (F.col(name) == value))
    return hits.orderBy(F.desc(score), key).limit(n)


def combined_queries(texts: DataFrame, images: DataFrame, weight: float = 0.7) -> DataFrame:
    """Query vectors of .7 text and .3 image, normalised; both are (vec_id, embedding)."""
    both = texts.join(images.select("vec_id", F.col("embedding").alias("image")), "vec_id")
    mixed = F.zip_with("embedding", "image", lambda a, b: weight * a.cast("double") + (1 - weight) * b.cast("double"))
    both = both.withColumn("mixed", mixed)
    norm = F.nullif(F.sqrt(F.aggregate("mixed", F.lit(0.0), lambda s, x: s + x * x)), F.lit(0.0))
    return both.select("vec_id", F.transform("mixed", lambda x: x / norm).alias("embedding"))


def enhanced_queries(neighbours: DataFrame, names: DataFrame, query: str) -> DataFrame:
    """Each query with the names of its nearest entities appended, nearest first; neighbours(query_id, vec_id, rank), names(vec_id, name)."""
    named = neighbours.join(names, "vec_id")
    terms = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("rank", "name"))), lambda x: x["name"]), " ")
    return named.groupBy("query_id").agg(F.concat(F.lit(query), F.col("query_id").cast("string"), F.lit(" "), terms).alias("query"))


def to_be_stored(results: DataFrame, score: str, query: Column, least: float = 0.7) -> DataFrame:
    """Results above a score with the query that found them, as rows of an index."""
    return results.filter(F.col(score) > least).withColumn("search_query", query).withColumn("source", F.lit("web_search"))


def zipped(companies: DataFrame, details: DataFrame, key: str, order: str) -> DataFrame:
    """The n-th company record of a key with its n-th detail record."""
    number = lambda df: df.withColumn("_n", F.row_number().over(Window.partitionBy(key).orderBy(order)))
    return number(companies).join(number(details).drop(order), [key, "_n"], "left").drop("_n")
