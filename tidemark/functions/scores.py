"""Scores of search results and records as weighted sums of bounded parts.

Each scorer takes columns and gives a column, so it stays inside generated code. A part that cannot be
computed takes the default that its docstring names.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Weights by kind, as lookup tables with their defaults.
SCANNERS = {"Identity": 1.0, "Data": 0.9, "Math": 0.9, "Unit": 0.8, "Property": 0.8}
CHARTS = {"table": 0.7, "line": 0.8, "bar": 0.8, "pie": 0.7, "scatter": 0.9, "map": 0.9}
QUERY_KINDS = {"native": 1.0, "query": 0.8}
FREQUENCIES = {"daily": 1.0, "weekly": 0.9, "monthly": 0.8, "quarterly": 0.7, "yearly": 0.6}
SENIORITY = {"c_level": 1.0, "vp": 0.9, "director": 0.8, "manager": 0.7, "senior": 0.6}
SIZES = {"large": 1.0, "medium": 0.8, "small": 0.6, "micro": 0.4}


def share(x: Column, full: float) -> Column:
    """x / full, at most 1; 0 where x is null."""
    return F.least(F.coalesce(x.cast("double"), F.lit(0.0)) / full, F.lit(1.0))


def clamp(x: Column) -> Column:
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), x))


def lookup(key: Column, table: dict[str, float], default: float) -> Column:
    out = F.lit(default)
    for k, v in reversed(table.items()):
        out = F.when(key == k, F.lit(v)).otherwise(out)
    return out


def first_contained(text: Column, table: dict[str, float], default: float) -> Column:
    """The value of the first key that the text contains."""
    out = F.lit(default)
    for k, v in reversed(table.items()):
        out = F.when(F.contains(F.lower(text), F.lit(k)), F.lit(v)).otherwise(out)
    return out


def present(*columns: Column) -> Column:
    """Share of the columns that are neither null nor empty."""
    found = [F.when(c.isNotNull() & (c.cast("string") != ""), 1.0).otherwise(0.0) for c in columns]
    total = found[0]
    for x in found[1:]:
        total = total + x
    return total / len(found)


def freshness(day: Column, as_of: Column, days: float) -> Column:
    """1 - age / days between 0 and 1; .5 without a date."""
    return F.when(day.isNull(), 0.5).otherwise(clamp(1 - F.datediff(as_of, day) / days))


def weighted(*parts: tuple[float, Column]) -> Column:
    total = parts[0][0] * parts[0][1]
    for weight, part in parts[1:]:
        total = total + weight * part
    return total


def academic(citations: Column, year: Column, source_weight: Column, base_year: int = 2024) -> Column:
    """.4 citations of 1,000, .3 recency over ten years, .3 source."""
    return weighted((0.4, share(citations, 1000)), (0.3, 1 - clamp((base_year - year) / 10)), (0.3, source_weight))


def repository(stars: Column, forks: Column, updated: Column, description: Column, as_of: Column) -> Column:
    """.4 stars of 10,000, .3 forks of 1,000, .2 activity within a year, .1 description of 200 characters."""
    return weighted((0.4, share(stars, 10_000)), (0.3, share(forks, 1000)), (0.2, freshness(updated, as_of, 365)), (0.1, share(F.length(description), 200)))


def discussion(kind: Column, score: Column, created: Column, tier: Column, karma: Column, as_of: Column) -> Column:
    """.2 kind, .3 score of 1,000, .1 age within a week, .2 tier, .2 author of 10,000."""
    return weighted((0.2, kind), (0.3, share(score, 1000)), (0.1, freshness(created, as_of, 7)), (0.2, tier), (0.2, share(karma, 10_000)))


def video(views: Column, likes: Column, dislikes: Column, comments: Column, subscribers: Column, published: Column, as_of: Column) -> Column:
    """.3 views, .2 like ratio, .15 comments per thousand views, .2 subscribers, .15 freshness."""
    ratio = F.coalesce(likes / F.nullif(likes + dislikes, F.lit(0)), F.lit(0.0))
    talk = F.coalesce(F.least(comments / F.nullif(views, F.lit(0)) * 1000, F.lit(1.0)), F.lit(0.0))
    return weighted((0.3, share(views, 1_000_000)), (0.2, ratio), (0.15, talk), (0.2, share(subscribers, 1_000_000)), (0.15, freshness(published, as_of, 365)))


def pod(base: Column, position: Column, scanner: Column, subpods: Column) -> Column:
    """.4 kind, .3 position among ten, .2 scanner, .1 parts of three."""
    return weighted((0.4, base), (0.3, F.greatest(F.lit(0.0), 1 - position / 10)), (0.2, lookup(scanner, SCANNERS, 0.7)), (0.1, share(subpods, 3)))


def dashboard(base: Column, cards: Column, updated: Column, parameters: Column, as_of: Column) -> Column:
    """.4 kind, .3 cards of ten, .2 freshness within 90 days, .1 parameters of five."""
    return weighted((0.4, base), (0.3, share(cards, 10)), (0.2, freshness(updated, as_of, 90)), (0.1, share(parameters, 5)))


def card(base: Column, chart: Column, query_kind: Column, description: Column) -> Column:
    """.4 kind, .3 chart, .2 query kind, .1 description of 200 characters."""
    return weighted((0.4, base), (0.3, lookup(chart, CHARTS, 0.6)), (0.2, lookup(query_kind, QUERY_KINDS, 0.6)), (0.1, share(F.length(description), 200)))


def dataset(theme: Column, modified: Column, complete: Column, languages: Column, known: int, as_of: Column) -> Column:
    """.4 theme, .3 freshness within a year, .2 completeness, .1 languages of those known."""
    return weighted((0.4, theme), (0.3, freshness(modified, as_of, 365)), (0.2, complete), (0.1, share(languages, known)))


def statistic(base: Column, years: Column, regions: Column, frequency: Column) -> Column:
    """.4 kind, .2 years of 20, .2 regions of 30, .2 frequency."""
    return weighted((0.4, base), (0.2, share(years, 20)), (0.2, share(regions, 30)), (0.2, lookup(F.lower(frequency), FREQUENCIES, 0.5)))


def contact(complete: Column, title: Column, channels: Column, updated: Column, as_of: Column, weights: tuple[float, float, float, float] = (0.4, 0.3, 0.2, 0.1)) -> Column:
    """Completeness, seniority by title, channels, freshness within 90 days."""
    return weighted(*zip(weights, (complete, first_contained(title, SENIORITY, 0.5), channels, freshness(updated, as_of, 90)), strict=True))


def organisation(complete: Column, employees: Column, technologies: Column, updated: Column, as_of: Column, weights: tuple[float, float, float, float] = (0.4, 0.3, 0.2, 0.1)) -> Column:
    """Completeness, size of 1,000 (.5 unknown), technologies of 20, freshness within 90 days."""
    size = F.when(F.coalesce(employees, F.lit(0)) == 0, 0.5).otherwise(share(employees, 1000))
    return weighted(*zip(weights, (complete, size, share(technologies, 20), freshness(updated, as_of, 90)), strict=True))


def local_firm(complete: Column, size: Column, online: Column, certificates: Column) -> Column:
    """.4 completeness, .3 size class, .2 online presence, .1 certificates of five."""
    return weighted((0.4, complete), (0.3, lookup(F.lower(size), SIZES, 0.5)), (0.2, online), (0.1, share(certificates, 5)))


def registered_firm(active: Column, complete: Column, updated: Column, as_of: Column) -> Column:
    """.4 status (1 or .5), .4 completeness, .2 freshness within a year."""
    return weighted((0.4, F.when(active, 1.0).otherwise(0.5)), (0.4, complete), (0.2, freshness(updated, as_of, 365)))


def documentation(source: Column, context: Column, version: Column, examples: Column) -> Column:
    """.3 source, .3 context, .2 major version over ten (1 for none or latest, .5 unreadable), .2 examples of five."""
    major = F.try_to_number(F.regexp_extract(version, r"^(\d+)", 1), F.lit("999999"))
    known = version.isNotNull() & (version != "") & (F.lower(version) != "latest")
    return weighted((0.3, source), (0.3, context), (0.2, F.when(known, F.coalesce(major.cast("double") / 10, F.lit(0.5))).otherwise(1.0)), (0.2, share(examples, 5)))


def api_item(relevance: Column, fresh: Column, fields: Column) -> Column:
    """.4 relevance (.5 unknown), .3 freshness, .3 fields over ten."""
    return weighted((0.4, F.coalesce(relevance, F.lit(0.5))), (0.3, fresh), (0.3, fields / 10))


def capability(have: list[Column], need: list[float], weights: list[float]) -> Column:
    """Weighted mean of min(1, have / need)."""
    parts = [(w / sum(weights), F.least(F.lit(1.0), F.coalesce(h, F.lit(0.0)) / n)) for h, n, w in zip(have, need, weights, strict=True)]
    return weighted(*parts)


def quality_level(confidence: Column, complete: Column, consistency: Column) -> Column:
    """.4, .3, .3, in five bands."""
    s = weighted((0.4, confidence), (0.3, complete), (0.3, consistency))
    return F.when(s >= 0.9, "excellent").when(s >= 0.75, "good").when(s >= 0.6, "acceptable").when(s >= 0.4, "poor").otherwise("unacceptable")


def image_quality(blur: Column, contrast: Column, noise: Column, resolution: Column) -> Column:
    """.35 blur, .30 contrast, .20 (1 - noise), .15 resolution, between 0 and 1."""
    return clamp(weighted((0.35, blur), (0.30, contrast), (0.20, 1 - noise), (0.15, resolution)))


def web_hit(highlights: Column, is_new: Column, length: Column) -> Column:
    """H103: .4 highlights, .3 new, .3 length over 1,000, none of them bounded."""
    return weighted((0.4, highlights), (0.3, F.when(is_new, 1.0).otherwise(0.0)), (0.3, length / 1000.0))


def knowledge_match(confidence: Column, priority: Column) -> Column:
    """.7 confidence, .3 priority of the source."""
    return weighted((0.7, confidence), (0.3, priority))


def property_bonus(matches: Column, of: int = 6) -> Column:
    """Up to .2 for matching properties."""
    return F.least(F.lit(0.2), 0.2 * matches / of)


def human_size(n: Column) -> Column:
    """Bytes as B, KB, MB or GB with one decimal."""
    text = lambda d, unit: F.concat((F.floor(n * 10 / d) / 10).cast("string"), F.lit(f" {unit}"))
    return F.when(n < 1024, text(1, "B")).when(n < 1024**2, text(1024, "KB")).when(n < 1024**3, text(1024**2, "MB")).otherwise(text(1024**3, "GB"))


def grid_size(width: Column, height: Column) -> Column:
    """Tiles a side by area: 1 up to a megapixel, 2 to four, 3 to nine, else 4."""
    area = width * height
    return F.when(area <= 1_000_000, 1).when(area <= 4_000_000, 2).when(area <= 9_000_000, 3).otherwise(4)


def token_strategy(length: Column, context: int) -> Column:
    """Direct below .8 of the context, truncate below 1.5, sliding window below 3, else summarise."""
    return F.when(length < 0.8 * context, "direct").when(length < 1.5 * context, "truncate").when(length < 3 * context, "sliding_window").otherwise("summarize")
