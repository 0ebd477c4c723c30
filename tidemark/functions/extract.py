"""Extraction and merging as column expressions: dates, amounts, addresses, structure, spoken numbers, maps, rules."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# Number words, month names, address and syntax patterns.
ONES = ["zero", "one", "two", "three", "four", "five", "six", "seven", "eight", "nine", "ten", "eleven", "twelve", "thirteen", "fourteen", "fifteen", "sixteen", "seventeen", "eighteen", "nineteen"]
TENS = ["twenty", "thirty", "forty", "fifty", "sixty", "seventy", "eighty", "ninety"]
MONTHS = ["January", "February", "March", "April", "May", "June", "July", "August", "September", "October", "November", "December"]
#: A whole number of one or two digits, by word borders of Basic Latin.
SHORT_NUMBER = r"\b\d{1,2}\b"
GERMAN_ADDRESS = r"[A-ZÄÖÜ][a-zäöüß]+(?:straße|strasse|str\.|weg|platz|allee) \d+[a-z]?, \d{5} [A-ZÄÖÜ][a-zäöüß]+"
US_ADDRESS = r"\d+ [A-Z][a-z]+(?: [A-Z][a-z]+)* (?:Street|St|Avenue|Ave|Road|Rd|Boulevard|Blvd),? [A-Z][a-z]+,? [A-Z]{2} \d{5}"
SYNTAX = {"works_for": r"(\w+) works (?:for|at) (\w+)", "located_in": r"(\w+) is located in (\w+)", "part_of": r"(\w+) is part of (\w+)", "created": r"(\w+) (?:created|founded) (\w+)", "owns": r"(\w+) owns (\w+)"}
#: Words of which a text holds one if it matches the pattern.
SAID = {"works_for": (" works for ", " works at "), "located_in": (" is located in ",), "part_of": (" is part of ",), "created": (" created ", " founded "), "owns": (" owns ",)}


def spoken_numbers(text: Column) -> Column:
    """Whole numbers from 0 to 99 as English words."""
    words = ONES + [TENS[n // 10 - 2] + (f"-{ONES[n % 10]}" if n % 10 else "") for n in range(20, 100)]
    table = F.array(*map(F.lit, words))
    said = F.transform(F.regexp_extract_all(text, F.lit(SHORT_NUMBER), F.lit(0)), lambda n: F.get(table, n.cast("int")))
    return F.array_join(F.zip_with(F.split(text, SHORT_NUMBER, -1), said, lambda gap, n: F.concat(gap, F.coalesce(n, F.lit("")))), "")


def spoken_dates(text: Column) -> Column:
    """M/D/YYYY as 'Month D, YYYY'; months beyond twelve stay."""
    date = r"\b\d{1,2}/\d{1,2}/\d{4}\b"
    parts = F.regexp_extract_all(text, F.lit(rf"{date}|(?:(?!{date})[\s\S])+"), F.lit(0))

    def said(p: Column) -> Column:
        fields = F.split(p, "/")
        name = F.get(F.array(*map(F.lit, MONTHS)), F.get(fields, F.lit(0)).try_cast("int") - 1)
        return F.when(p.rlike(f"^{date}$") & name.isNotNull(), F.concat(name, F.lit(" "), F.get(fields, F.lit(1)).try_cast("int").cast("string"), F.lit(", "), F.get(fields, F.lit(2)))).otherwise(p)

    return F.array_join(F.transform(parts, said), "")


def tags_balance(text: Column) -> Column:
    """Whether tags close in the order in which they open."""
    tags = F.regexp_extract_all(text, F.lit(r"<(/?[A-Za-z][\w:-]*)[^>]*?(?<!/)>"), F.lit(1))
    none = F.struct(F.array().cast("array<string>").alias("open"), F.lit(True).alias("good"))

    def step(s: Column, t: Column) -> Column:
        closes = t.startswith("/")
        fits = closes & (F.try_element_at(s["open"], F.lit(-1)) == F.substring(t, 2, 1000))
        return F.when(~closes, F.struct(F.concat(s["open"], F.array(t)).alias("open"), s["good"].alias("good"))).when(F.coalesce(fits, F.lit(False)), F.struct(F.slice(s["open"], F.lit(1), F.size(s["open"]) - 1).alias("open"), s["good"].alias("good"))).otherwise(F.struct(s["open"].alias("open"), F.lit(False).alias("good")))

    folded = F.aggregate(tags, none, step)
    return folded["good"] & (F.size(folded["open"]) == 0)


def dates(text: Column) -> Column:
    """D.M.YYYY, D-M-YYYY and YYYY-M-D as ISO dates, where day, month and year can be."""
    found = F.regexp_extract_all(text, F.lit(r"\d{4}-\d{1,2}-\d{1,2}|\d{1,2}[.-]\d{1,2}[.-]\d{4}"), F.lit(0))

    def iso(d: Column) -> Column:
        f = F.transform(F.split(d, "[.-]"), lambda x: x.cast("int"))
        y, m, day = F.when(d.rlike(r"^\d{4}"), F.get(f, F.lit(0))).otherwise(F.get(f, F.lit(2))), F.get(f, F.lit(1)), F.when(d.rlike(r"^\d{4}"), F.get(f, F.lit(2))).otherwise(F.get(f, F.lit(0)))
        return F.when(day.between(1, 31) & m.between(1, 12) & (y >= 1900), F.format_string("%04d-%02d-%02d", y, m, day))

    return F.filter(F.transform(found, iso), lambda x: x.isNotNull())


def amounts(text: Column) -> Column:
    """Amounts with a currency; the last separator is the decimal one."""
    found = F.regexp_extract_all(text, F.lit(r"\$\s*\d{1,3}(?:,\d{3})*\.\d{2}|\d{1,3}(?:[.,]\d{3})*[.,]\d{2}\s*(?:€|Euro\b|[A-Z]{3}\b)"), F.lit(0))

    def parsed(a: Column) -> Column:
        digits = F.regexp_replace(a, r"[^0-9]", "")
        value = F.try_to_number(digits, F.lit("9" * 18)).cast("double") / 100
        currency = F.when(F.contains(a, F.lit("$")), "USD").when(a.rlike("€|Euro"), "EUR").otherwise(F.regexp_extract(a, "([A-Z]{3})", 1))
        return F.struct(value.alias("value"), currency.alias("currency"))

    return F.transform(found, parsed)


def addresses(text: Column) -> Column:
    """German and US postal addresses."""
    return F.concat(F.regexp_extract_all(text, F.lit(GERMAN_ADDRESS), F.lit(0)), F.regexp_extract_all(text, F.lit(US_ADDRESS), F.lit(0)))


def structure(text: Column) -> Column:
    """A first line of under 100 characters as title; lines that end in a colon or are upper case as headers; long blocks as paragraphs."""
    lines = F.split(text, "\n")
    first = F.trim(F.get(lines, F.lit(0)))
    headers = F.filter(lines, lambda x: (F.trim(x) != "") & (F.trim(x).endswith(":") | ((F.upper(x) == x) & (F.lower(x) != x))))
    return F.struct(F.when((F.length(first) < 100) & (first != ""), first).alias("title"), headers.alias("headers"), F.size(F.filter(lines, lambda x: F.length(x) > 100)).alias("paragraphs"))


def syntactic_pairs(text: Column) -> Column:
    """(kind, source, target) of the patterns 'X works for Y' and the like.

    A text is searched by a pattern only where it holds the pattern's words, and once: both names are taken from what was found.
    """

    def both(k: str, p: str) -> Column:
        said = reduce(lambda a, b: a | b, [F.contains(text, F.lit(w)) for w in SAID[k]])
        pairs = F.transform(F.regexp_extract_all(text, F.lit(p), F.lit(0)), lambda m: F.struct(F.lit(k).alias("kind"), F.regexp_extract(m, p, 1).alias("source"), F.regexp_extract(m, p, 2).alias("target")))
        return F.when(said, pairs).when(text.isNotNull(), F.array().cast("array<struct<kind:string,source:string,target:string>>"))

    return F.concat(*[both(k, p) for k, p in SYNTAX.items()])


def filled(base: Column, other: Column) -> Column:
    """A map with the keys of another added where they are missing; the base wins."""
    extra = F.map_filter(other, lambda k, v: ~F.map_contains_key(base, k))
    return F.coalesce(F.map_concat(base, extra), base, other)


def updated(base: Column, other: Column) -> Column:
    """A map with the values of another, which wins."""
    return filled(other, base)


def property_similarity(a: Column, b: Column) -> Column:
    """H41 for maps of numbers: mean over common keys of 1 - |x - y| / max(|x|, |y|); 0 without common keys."""
    keys = F.filter(F.map_keys(a), lambda k: F.map_contains_key(b, k))
    each = F.transform(keys, lambda k: 1 - F.abs(a[k] - b[k]) / F.coalesce(F.nullif(F.greatest(F.abs(a[k]), F.abs(b[k])), F.lit(0.0)), F.lit(1.0)))
    return F.coalesce(F.aggregate(each, F.lit(0.0), lambda s, x: s + x) / F.nullif(F.size(each), F.lit(0)), F.lit(0.0))


def configured(kind: Column, config: Column) -> Column:
    """Whether a provider's JSON configuration holds what its kind needs."""
    has = lambda k: F.coalesce(F.get_json_object(config, f"$.{k}") != "", F.lit(False))
    return F.when(kind == "api", has("url") & has("key")).when(kind == "database", has("dsn")).when(kind == "files", has("path")).otherwise(F.lit(True))


def preprocessing(blur: Column, contrast: Column, noise: Column) -> Column:
    """What to do with an image, by threshold, and how urgent the whole is."""
    issues = F.array_compact(F.array(F.when(blur < 0.5, "sharpen"), F.when(contrast < 0.4, "raise_contrast"), F.when(noise > 0.3, "denoise")))
    return F.struct(issues.alias("issues"), F.when(F.size(issues) == 0, "none").when(F.size(issues) == 1, "light").otherwise("full").alias("strategy"))
