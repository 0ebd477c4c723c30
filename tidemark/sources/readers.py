"""Sources as DataFrames: delimited, JSON, text, Markdown, HTML, XML, mail, ontology and directory scans.

Every reader goes through Spark's own readers, so any store that Spark reaches will do, and files are
read by the executors.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Kinds of files by extension (A53, L09), and kinds of content.
HANDLERS = {"csv": "csv", "json": "json", "txt": "text", "md": "markdown", "html": "html", "htm": "html", "xml": "xml", "eml": "mail"}
CONTENT = {"image": "image", "audio": "audio", "video": "video"}


def csv(spark: SparkSession, path: str) -> DataFrame:
    """The first row names the columns; all others are rows of strings. A quote inside a quoted field is doubled."""
    return spark.read.csv(path, header=True, inferSchema=False, escape='"')


def json_documents(spark: SparkSession, path: str) -> DataFrame:
    """One document a file."""
    return spark.read.json(path, multiLine=True)


def ndjson(spark: SparkSession, path: str, schema: str, limit: int | None = None) -> DataFrame:
    """One record a line; lines that are no JSON are skipped."""
    out = spark.read.schema(f"{schema}, _bad string").option("columnNameOfCorruptRecord", "_bad").json(path)
    parsed = out.filter("_bad IS NULL").drop("_bad")
    return parsed if limit is None else parsed.limit(limit)


def texts(spark: SparkSession, path: str) -> DataFrame:
    """(path, text), a row a file."""
    return spark.read.text(path, wholetext=True).select(F.input_file_name().alias("path"), F.col("value").alias("text"))


def paragraphs(df: DataFrame) -> DataFrame:
    """Paragraphs between blank lines, numbered."""
    return df.select("path", F.posexplode(F.split("text", r"\n\s*\n")).alias("pos", "p")).filter(F.trim("p") != "").select("path", "pos", F.trim("p").alias("text"))


def markdown(df: DataFrame) -> DataFrame:
    """Headings with their level, and paragraphs."""
    lines = df.select("path", F.posexplode(F.split("text", "\n")).alias("pos", "line")).filter(F.trim("line") != "")
    marks = F.length(F.regexp_extract("line", r"^(#{1,6})\s", 1))
    return lines.select("path", "pos", F.when(marks > 0, "heading").otherwise("paragraph").alias("kind"), marks.alias("level"), F.regexp_replace("line", r"^#{1,6}\s+", "").alias("text"))


def html_parts(html: Column) -> Column:
    """Title, metadata, headings, links, images and plain text of a page."""
    all_of = lambda p, i=1: F.regexp_extract_all(html, F.lit(p), F.lit(i))
    return F.struct(
        F.regexp_extract(html, "(?s)<title[^>]*>(.*?)</title>", 1).alias("title"),
        F.map_from_arrays(F.array_distinct(all_of(r'<meta[^>]*(?:name|property)="([^"]*)"[^>]*content="[^"]*"')), F.slice(all_of(r'<meta[^>]*(?:name|property)="[^"]*"[^>]*content="([^"]*)"'), F.lit(1), F.size(F.array_distinct(all_of(r'<meta[^>]*(?:name|property)="([^"]*)"[^>]*content="[^"]*"'))))).alias("meta"),
        all_of(r"(?s)<h[1-6][^>]*>(.*?)</h[1-6]>").alias("headings"),
        all_of(r'<a[^>]*href="([^"]*)"').alias("links"),
        all_of(r'<img[^>]*src="([^"]*)"').alias("images"),
        F.trim(F.regexp_replace(F.regexp_replace(html, "<[^>]*>", " "), r"\s+", " ")).alias("text"),
    )


def html_rows(html: Column) -> Column:
    """The rows of a page's tables, as arrays of cells."""
    rows = F.regexp_extract_all(html, F.lit(r"(?s)<tr[^>]*>(.*?)</tr>"), F.lit(1))
    return F.transform(rows, lambda r: F.regexp_extract_all(r, F.lit(r"(?s)<t[dh][^>]*>(.*?)</t[dh]>"), F.lit(1)))


def xml(spark: SparkSession, path: str, row_tag: str) -> DataFrame:
    """A row for each element of a name."""
    return spark.read.format("xml").option("rowTag", row_tag).load(path)


def mails(df: DataFrame) -> DataFrame:
    """(path, text) of mail files to sender, recipients, subject, body and the names of attachments."""

    def parse(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from email import message_from_string, policy

        for batch in batches:
            rows = []
            for path, text in zip(batch.path, batch.text, strict=True):
                m = message_from_string(text or "", policy=policy.default)
                body = m.get_body(("plain", "html"))
                rows.append((path, str(m["from"] or ""), str(m["to"] or ""), str(m["subject"] or ""), body.get_content() if body else "", [a.get_filename() or "" for a in m.iter_attachments()]))
            yield pd.DataFrame(rows, columns=["path", "sender", "recipients", "subject", "body", "attachments"])

    return df.select("path", "text").mapInPandas(parse, "path string, sender string, recipients string, subject string, body string, attachments array<string>")


def files(spark: SparkSession, path: str, pattern: str = "*", recursive: bool = True) -> DataFrame:
    """Files of a folder with size, time, extension and the reader that takes them; contents are not read."""
    found = spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", str(recursive).lower()).load(path).select("path", "length", "modificationTime")
    extension = F.lower(F.regexp_extract("path", r"\.([A-Za-z0-9]+)$", 1))
    table = F.create_map(*[F.lit(x) for kv in HANDLERS.items() for x in kv])
    return found.withColumn("extension", extension).withColumn("handler", F.coalesce(F.try_element_at(table, F.col("extension")), F.lit("unsupported")))


def content_kind(mime: Column) -> Column:
    """Image, audio, video, document or other by content type."""
    main = F.split_part(mime, F.lit("/"), F.lit(1))
    return F.when(main.isin(*CONTENT), main).when((main == "text") | F.contains(mime, F.lit("pdf")) | F.contains(mime, F.lit("document")), "document").otherwise("other")


def sql_like(df: DataFrame, fields: list[str], term: str, key: str, limit: int) -> DataFrame:
    """Rows of which a field contains the term, newest key first."""
    hit = F.lit(False)
    for f in fields:
        hit = hit | F.contains(F.lower(F.col(f).cast("string")), F.lit(term.lower()))
    return df.filter(hit).orderBy(F.desc(key)).limit(limit)


def ontology(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(kinds with required properties, edge kinds with domain and range) of a JSON ontology."""
    doc = spark.read.schema("entity_types map<string, struct<required: array<string>, optional: array<string>>>, relationship_types map<string, struct<domain: array<string>, range: array<string>>>").json(path, multiLine=True)
    kinds = doc.select(F.explode("entity_types").alias("kind", "p")).select("kind", "p.required", "p.optional")
    edges = doc.select(F.explode("relationship_types").alias("kind", "p")).select("kind", F.explode("p.domain").alias("domain"), "p.range").select("kind", "domain", F.explode("range").alias("range"))
    return kinds, edges
