"""Text functions as column expressions: snippets, terms, scores, extraction, classification, similarity."""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

# Stop words, kinds of documents with their keywords, number words, repairs of scanned text.
STOP_WORDS = ["a", "an", "the", "and", "or", "but", "is", "are", "was", "were", "be", "been", "being", "to", "of", "for", "in", "on", "by", "at", "that", "this", "with", "which", "what", "who", "where", "when", "how"]
OVERLAP_STOP_WORDS = ["the", "a", "an", "is", "are", "and", "in", "on", "at", "to", "of", "for", "with", "by"]
CATEGORY_STOP_WORDS = ["the", "a", "an", "is", "are", "this", "that", "image", "shows", "depicts", "contains", "i", "see"]
KINDS = {
    "invoice": ["rechnung", "invoice", "bill", "payment", "zahlung", "betrag", "amount", "umsatzsteuer", "vat"],
    "receipt": ["quittung", "receipt", "kassenbon", "beleg", "kaufbeleg"],
    "contract": ["vertrag", "contract", "agreement", "vereinbarung", "konditionen", "terms"],
    "letter": ["sehr geehrte", "dear", "mit freundlichen grüßen", "sincerely", "best regards"],
    "form": ["formular", "form", "antrag", "application", "bitte ausfüllen", "please fill"],
    "id_document": ["personalausweis", "id card", "reisepass", "passport", "führerschein", "driver's license"],
}
NUMBERS = {
    "zero": 0, "one": 1, "two": 2, "three": 3, "four": 4, "five": 5, "six": 6, "seven": 7, "eight": 8, "nine": 9, "ten": 10, "eleven": 11, "twelve": 12, "thirteen": 13, "fourteen": 14, "fifteen": 15,
    "sixteen": 16, "seventeen": 17, "eighteen": 18, "nineteen": 19, "twenty": 20, "thirty": 30, "forty": 40, "fifty": 50, "sixty": 60, "seventy": 70, "eighty": 80, "ninety": 90,
}
REPAIRS = {"l1": "h", "Il": "H", "rn": "m", "cl": "d", " - ": "-", " , ": ", ", " . ": ". ", "..": ".", ",,": ",", "::": ":", "  ": " "}
INVOICE = [r"(?i)Rechnungs(?:[-\s])?(?:nummer|nr)\.?:?\s*([A-Za-z0-9][-A-Za-z0-9/]{3,20})", r"(?i)Invoice\s*(?:number|no)\.?:?\s*([A-Za-z0-9][-A-Za-z0-9/]{3,20})", r"(?i)(?:Rechnung|Invoice|Bill)\s*#\s*([A-Za-z0-9][-A-Za-z0-9/]{3,20})"]
VAT = [r"(?i)USt-IdNr\.?:?\s*([A-Z]{2}\d{9,12})", r"(?i)Umsatzsteuer-ID:?\s*([A-Z]{2}\d{9,12})", r"(?i)VAT\s*(?:number|ID):?\s*([A-Z]{2}\d{9,12})"]
ENTITIES = {
    "date": r"\b\d{1,2}[-/\.]\d{1,2}[-/\.]\d{2,4}\b|\b(?:Jan|Feb|Mar|Apr|May|Jun|Jul|Aug|Sep|Oct|Nov|Dec)[a-z]* \d{1,2},? \d{4}\b",
    "email": r"\b[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Z|a-z]{2,}\b",
    "phone": r"\b(?:\+\d{1,3}[- ]?)?\(?\d{3}\)?[- ]?\d{3}[- ]?\d{4}\b",
    "money": r"\$\s?\d+(?:\.\d{2})?\b|\b\d+\s?(?:USD|EUR|GBP|JPY)\b",
    "percentage": r"\b\d+(?:\.\d+)?%\b",
    "time": r"\b\d{1,2}:\d{2}(?::\d{2})?(?:\s?[AP]M)?\b",
}
ABBREVIATIONS = {
    "Dr.": "Doctor",
    "Mr.": "Mister",
    "Mrs.": "Misses",
    "Ms.": "Miss",
    "Prof.": "Professor",
    "etc.": "etcetera",
    "e.g.": "for example",
    "i.e.": "that is",
    "vs.": "versus",
    "approx.": "approximately",
}
#: A word of Python's kind, in a form that other engines know too.
WORD = r"[\p{L}\p{N}_]+"


def snippet(text: Column, query: str, context: int = 100) -> Column:
    """The first hit with so many characters on either side and dots where text is cut; else the first 200 characters."""
    at = F.instr(F.lower(text), query.lower())
    start = F.greatest(F.lit(0), at - 1 - context)
    end = F.least(F.length(text), at - 1 + len(query) + context)
    cut = F.concat(F.when(start > 0, "...").otherwise(""), F.substring(text, start + 1, end - start), F.when(end < F.length(text), "...").otherwise(""))
    return F.when(at > 0, cut).when(F.length(text) > 200, F.concat(F.substring(text, 1, 200), F.lit("..."))).otherwise(text)


def occurrences(text: Column, query: str) -> Column:
    """Hits of a literal that do not overlap."""
    return ((F.length(text) - F.length(F.replace(text, F.lit(query), F.lit("")))) / len(query)).cast("long")


def file_score(name: Column, text: Column, query: str) -> Column:
    """3 for a hit in the name, up to 1 for hits in the text, and 1 less the relative place of the first."""
    low = F.lower(text)
    first = (F.instr(low, query) - 1) / F.greatest(F.lit(1), F.length(text))
    return F.when(F.contains(F.lower(name), F.lit(query)), 3.0).otherwise(0.0) + F.least(F.lit(1.0), occurrences(low, query) / 10) + (1.0 - first)


def key_terms(text: Column) -> Column:
    """Words in lower case of more than two characters that are no stop words."""
    return F.filter(F.regexp_extract_all(F.lower(text), F.lit(WORD), F.lit(0)), lambda w: ~w.isin(*STOP_WORDS) & (F.length(w) > 2))


def capitalised_runs(text: Column) -> Column:
    """Runs of capitalised words."""
    return F.regexp_extract_all(text, F.lit(r"\b[A-Z][a-zA-Z]*(?:\s+[A-Z][a-zA-Z]*)*\b"), F.lit(0))


def sentences(text: Column) -> Column:
    """Text cut after a full stop, exclamation or question mark that white space follows."""
    return F.split(F.regexp_replace(text, r"([.!?])\s+", "$1\u0001"), "\u0001")


def terms(text: Column) -> Column:
    """Distinct words in lower case."""
    return F.array_distinct(F.filter(F.split(F.lower(text), r"\s+"), lambda w: w != ""))


def lexical_quality(response: Column, reference: Column) -> Column:
    """Precision, recall and F1 over distinct words."""
    a, b = terms(response), terms(reference)
    both = F.size(F.array_intersect(a, b))
    p, r = both / F.greatest(F.lit(1), F.size(a)), both / F.greatest(F.lit(1), F.size(b))
    return F.struct(F.round(p, 6).alias("precision"), F.round(r, 6).alias("recall"), F.round(2 * p * r / F.greatest(F.lit(0.001), p + r), 6).alias("f1"))


def token_jaccard(a: Column, b: Column) -> Column:
    """Jaccard of distinct words without stop words; 0 for no words."""
    stop = F.array(*map(F.lit, OVERLAP_STOP_WORDS))
    x, y = F.array_except(terms(a), stop), F.array_except(terms(b), stop)
    return F.coalesce(F.size(F.array_intersect(x, y)) / F.nullif(F.size(F.array_union(x, y)), F.lit(0)), F.lit(0.0))


def chunk_score(text: Column, query: str, bonus: Column) -> Column:
    """Query words of more than three characters that the text contains, 1.2-fold for semantic chunks."""
    hits = F.lit(0)
    for w in sorted({w for w in query.lower().split() if len(w) > 3}):
        hits = hits + F.contains(F.lower(text), F.lit(w)).cast("int")
    return hits * F.when(bonus, 1.2).otherwise(1.0)


def character_error_rate(hypothesis: Column, reference: Column) -> Column:
    """Edit distance over the reference's length, white space removed."""
    a, b = F.regexp_replace(hypothesis, r"\s", ""), F.regexp_replace(reference, r"\s", "")
    return F.levenshtein(a, b) / F.nullif(F.length(b), F.lit(0))


def first_match(text: Column, patterns: list[str]) -> Column:
    """Group 1 of the first pattern that matches, in the order of the patterns; null without a match."""
    return F.coalesce(*[F.nullif(F.regexp_extract(text, p, 1), F.lit("")) for p in patterns])


def document_kind(text: Column) -> Column:
    """The kind with the most keywords in the text, the first of equals, and a confidence."""
    low = F.lower(text)
    best, kind = F.lit(0), F.lit("unknown")
    hits = {k: sum((F.contains(low, F.lit(w)).cast("int") for w in words), F.lit(0)) for k, words in KINDS.items()}
    best = F.greatest(*hits.values())
    for k in reversed(KINDS):
        kind = F.when(hits[k] == best, F.lit(k)).otherwise(kind)
    return F.struct(F.when(best == 0, "unknown").otherwise(kind).alias("kind"), F.round(F.least(F.lit(1.0), best / (sum(map(len, KINDS.values())) * 0.2)), 6).alias("confidence"))


def text_confidence(text: Column, longest: int = 100_000) -> Column:
    """.4 for content, .3 for a length between 10 and the longest, .3 for a full stop; in tenths, added as integers."""
    tenths = F.when(F.trim(text) != "", 4).otherwise(0) + F.when(F.length(text).between(10, longest), 3).otherwise(0) + F.when(F.contains(text, F.lit(".")), 3).otherwise(0)
    return F.when(F.coalesce(F.length(text), F.lit(0)) == 0, 0.0).otherwise(tenths / 10)


def first_number(text: Column) -> Column:
    """The first integer, else the first number word in the order of the list."""
    out = F.lit(None).cast("long")
    for word, value in reversed(NUMBERS.items()):
        out = F.when(F.contains(F.lower(text), F.lit(word)), F.lit(value)).otherwise(out)
    return F.coalesce(F.try_to_number(F.nullif(F.regexp_extract(text, r"(\d{1,15})", 1), F.lit("")), F.lit("999999999999999")).cast("long"), out)


def category(text: Column) -> Column:
    """What follows a phrase such as 'category is', else the first word that is no stop word."""
    low = F.lower(text)
    named = F.coalesce(*[F.nullif(F.trim(F.regexp_extract(low, p + r"\s*:?\s*([\w\s]+)", 1)), F.lit("")) for p in (r"category\s+is", r"categorized\s+as", r"classified\s+as", r"belongs\s+to")])
    words = F.filter(F.split(F.translate(low, ".,", "  "), r"\s+"), lambda w: (w != "") & ~w.isin(*CATEGORY_STOP_WORDS))
    return F.coalesce(named, F.get(words, F.lit(0)))


def repaired(text: Column) -> Column:
    """The repairs in order, then lines of more than two characters."""
    for wrong, right in REPAIRS.items():
        text = F.replace(text, F.lit(wrong), F.lit(right))
    return F.array_join(F.filter(F.split(text, "\n"), lambda x: F.length(F.trim(x)) > 2), "\n")


def expanded(text: Column, more: dict[str, str] | None = None) -> Column:
    """Abbreviations replaced in the order of the list."""
    for short, full in (ABBREVIATIONS | (more or {})).items():
        text = F.replace(text, F.lit(short), F.lit(full))
    return text


def cut_window(text: Column, most: int, side: str = "end") -> Column:
    """H101: at most so many characters: without the end, without the start, or without the middle."""
    half = most // 2
    cut = {"end": F.substring(text, 1, most), "start": F.substring(text, -most, most), "middle": F.concat(F.substring(text, 1, half), F.substring(text, -half, half))}[side]
    return F.when(F.length(text) > most, cut).otherwise(text)


def combined_query(query: Column, hypothesis: Column, confidence: Column, strategy: str = "weighted", gate: float = 0.6) -> Column:
    """The query with a hypothesis where its confidence passes the gate."""
    words = F.slice(F.filter(F.split(hypothesis, r"\s+"), lambda w: F.length(w) > 5), 1, 5)
    made = {"weighted": F.concat_ws(" ", query, hypothesis), "append": F.concat(query, F.lit(". Context: "), hypothesis), "extract_keywords": F.concat_ws(" ", query, F.array_join(words, " "))}[strategy]
    return F.when(confidence < gate, query).otherwise(made)


def _placed(text: Column, kind: str, pattern: str) -> Column:
    """The matches of one pattern as (kind, text, position): a match starts where all gaps and matches before it end."""
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    none = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<kind:string,text:string,position:int>>").alias("out"))

    def step(s: Column, x: Column) -> Column:
        start = s["at"] + F.length(x["gap"])
        return F.struct((start + F.length(x["m"])).alias("at"), F.concat(s["out"], F.array(F.struct(F.lit(kind).alias("kind"), x["m"].alias("text"), start.alias("position")))).alias("out"))

    def placed(f: Column) -> Column:
        pairs = F.zip_with(f, F.slice(F.split(text, pattern, -1), F.lit(1), F.size(f)), lambda m, gap: F.struct(m.alias("m"), gap.alias("gap")))
        return F.when(F.size(f) > 0, F.aggregate(pairs, none, step)["out"]).otherwise(none["out"])

    # The matches are an element of an array, so that they are found once and not in each place that they are used.
    return F.get(F.transform(F.array(found), placed), F.lit(0))


def entities(text: Column) -> Column:
    """All matches of the patterns, as an array of (kind, text, position)."""
    return F.concat(*[_placed(text, k, p) for k, p in ENTITIES.items()])


def compatibility_form(text: Column) -> Column:
    """NFKC; texts of Basic Latin stay in the JVM."""

    @F.pandas_udf("string")
    def nfkc(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            yield batch.map(lambda x: None if x is None else unicodedata.normalize("NFKC", x))

    return nfkc(text)


def normalised(text: Column) -> Column:
    """Lower case, NFKC, white space runs to one blank, trimmed."""
    return F.trim(F.regexp_replace(compatibility_form(F.lower(text)), r"[\s\x{1c}-\x{1f}\x{85}\p{Z}]+", " "))


def speaker_phrases(text: Column) -> Column:
    """Sentences as (speaker, phrase): what stands before a colon at the start, if only letters and blanks, is the speaker."""
    pattern = r"(?s)^([A-Za-z\s]+):\s*(.*)"
    named = lambda x: F.struct(F.when(x.rlike(pattern), F.trim(F.regexp_extract(x, pattern, 1))).otherwise("unknown").alias("speaker"), F.trim(F.when(x.rlike(pattern), F.regexp_extract(x, pattern, 2)).otherwise(x)).alias("phrase"))
    return F.transform(F.filter(sentences(text), lambda x: F.trim(x) != ""), named)


def cache_key(text: Column, voice: Column, options: str) -> Column:
    """MD5 of normalised text, voice and options."""
    return F.md5(F.concat_ws("|", normalised(text), voice, F.lit(options)))


def content_hash(*columns: Column) -> Column:
    """SHA-256 of the columns in a fixed order."""
    return F.sha2(F.concat_ws("|", *[F.coalesce(c.cast("string"), F.lit("")) for c in columns]), 256)
