"""Toxicity scores from a weighted lexicon matched by Aho-Corasick (operator 9).

A text is folded first: compatibility forms, lower case, look-alike letters of other scripts, and digits or
signs that stand for letters inside a word. Words are then set apart by single blanks, so that a pattern can ask
for a word's start (`` idiot``) and its end (`` idiot ``). All patterns and exception phrases are found in one
pass of an Aho-Corasick automaton; a hit inside an exception phrase does not count. The hits' weights, as a sum
and normalised by length, give the score through a logistic curve.

The lexicon holds fixed words of four languages and what labels teach: Spark counts, over at most ``most_rows``
labelled documents (those of least keyed hash), in how many toxic and other documents each word occurs, and from
that the word starts that set the two apart: all that enough toxic documents share and that are precise enough. The same
bounded sample fits the curve's few coefficients. Rows with crc32(doc_id) mod 5 = 0 are held out and never learned from.

Defined cases: a null or empty text is scored as having no hits; without labels (or with one class only) the
fixed lexicon and curve are used; labels that are null do not count; of several labels of a doc_id the greatest counts,
and of several texts the least; hits that overlap count each; repeated rows are scored one by one; texts of any length
are scored whole; extra columns stay, whatever their names, but the name of the score column must be new; an
empty table gives an empty result.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Words that start the lexicon, phrases in which they are harmless, and look-alikes.
WORDS = ["clown", "disgusting", "idiot", "loser", "moron", "pathetic", "scum", "stupid", "trash", "worthless"]
WORDS += ["abschaum", "arschloch", "drecksack", "dummkopf", "idioten", "trottel", "vollidiot", "wichser"]
WORDS += ["abruti", "connard", "connasse", "crétin", "enculé", "imbécile", "salaud", "salope"]
WORDS += ["cabrón", "escoria", "estúpida", "estúpido", "gilipollas", "idiota", "imbécil", "pendejo"]
EXCEPTIONS = ["clown fish", "clown car", "trash can", "trash bin", "trash bag", "loser bracket", "scum line", "pathetic fallacy"]
LOOK_ALIKES = str.maketrans("аеорсухіјѕԁһԛԝνοαερτικυ", "aeopcyxijsdhqwvoaeptiku")
STANDS_FOR = str.maketrans("0134578@$", "oieastbas")
_LOOK_ALIKE = re.compile("[аеорсухіјѕԁһԛԝνοαερτικυ]")
_INSIDE = re.compile(r"[0134578@$]+(?=[^\W\d_])|(?<=[^\W\d_])[0134578@$]{1,2}(?![\w@$])")
_BETWEEN = re.compile(r"[\W\d_]+")
FIXED_WEIGHT = 4.0


def folded(text: str | None) -> str:
    """Words in lower case with look-alikes folded, each between blanks."""
    s = text or ""
    if not s.isascii():
        s = unicodedata.normalize("NFKC", s)
    s = s.lower()
    if not s.isascii() and _LOOK_ALIKE.search(s):
        # Only words that mix scripts are folded; a word wholly of another script keeps its letters.
        s = re.sub(r"\w+", lambda m: m[0].translate(LOOK_ALIKES) if re.search("[a-z]", m[0]) else m[0], s)
    s = _INSIDE.sub(lambda m: m[0].translate(STANDS_FOR), s)
    return f" {_BETWEEN.sub(' ', s).strip()} "


@dataclass
class Lexicon:
    """Patterns with weights, and the curve's coefficients over (1, sum of weights, sum per 100 words, whether any hit)."""

    weights: dict[str, float] = field(default_factory=lambda: {f" {w} ": FIXED_WEIGHT for w in WORDS})
    curve: tuple[float, ...] = (-3.0, 0.4, 0.4, 2.5)

    def automaton(self):
        import ahocorasick

        found = ahocorasick.Automaton()
        for pattern, weight in self.weights.items():
            found.add_word(pattern, (len(pattern), weight))
        for phrase in EXCEPTIONS:
            found.add_word(f" {phrase} ", (len(phrase) + 2, None))
        found.make_automaton()
        return found


def measures(automaton, text: str | None) -> tuple[float, float, float]:
    """Sum of the weights of hits, the sum per 100 words, and whether there is a hit."""
    s = folded(text)
    hits, spared = [], []
    for end, (n, weight) in automaton.iter(s):
        (hits if weight is not None else spared).append((end - n + 1, end, weight))
    if spared:
        hits = [h for h in hits if not any(a <= h[0] and h[1] <= b for a, b, _ in spared)]
    if not hits:
        return 0.0, 0.0, 0.0
    total = sum(h[2] for h in hits)
    return total, 100 * total / s.count(" "), 1.0


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(False))


def labelled(docs: DataFrame, labels: DataFrame, most_rows: int) -> DataFrame:
    """(text, toxic) of at most so many labelled documents, least keyed hash first, none of them held out."""
    known = labels.filter(F.col("toxic").isin(0, 1) & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id"))).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    some = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(most_rows)
    # The sample has at most ``most_rows`` narrow rows, so the texts stay where they are.
    found = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).join(F.broadcast(some), "doc_id")
    return found.groupBy("doc_id").agg(F.min("text").alias("text"), F.max("toxic").alias("toxic")).select("text", "toxic")


def _word_counts(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        seen = [(w, t) for text, t in zip(batch.text, batch.toxic, strict=True) for w in set(folded(text).split())]
        if seen:
            frame = pd.DataFrame(seen, columns=["word", "toxic"])
            out = frame.groupby("word").toxic.agg(["sum", "count"]).reset_index()
            yield pd.DataFrame({"word": out.word, "bad": out["sum"].astype("int64"), "n": out["count"].astype("int64")})


def word_starts(rows: DataFrame, shortest: int = 4, longest: int = 12) -> DataFrame:
    """(start, bad, n): for each word start (a whole word ends with a blank) its documents, toxic and all."""
    counts = rows.mapInPandas(_word_counts, "word string, bad long, n long").groupBy("word").agg(F.sum("bad").alias("bad"), F.sum("n").alias("n"))
    starts = F.transform(F.sequence(F.lit(shortest), F.greatest(F.lit(shortest), F.least(F.length("word"), F.lit(longest)))), lambda i: F.substring(F.col("word"), F.lit(1), i))
    either = F.concat(F.array(F.concat("word", F.lit(" "))), F.when(F.length("word") >= shortest, starts).otherwise(F.array().cast("array<string>")))
    return counts.select(F.explode(either).alias("start"), "bad", "n").groupBy("start").agg(F.sum("bad").alias("bad"), F.sum("n").alias("n"))


def chosen(rows: list[tuple[str, int, int]], bad: int, good: int) -> dict[str, float]:
    """Patterns from counted starts: the shortest closed starts that are precise; longer ones under them go.

    A start is closed if no longer start has nearly all of its toxic documents.
    """
    counted = {s: (b, n) for s, b, n in rows}
    longer: dict[str, int] = {}
    for s, (b, _) in counted.items():
        for cut in range(1, len(s)):
            if s[:cut] in counted:
                longer[s[:cut]] = max(longer.get(s[:cut], 0), b)
    kept: dict[str, float] = {}
    for s in sorted(counted, key=lambda s: (len(s), s)):
        b, n = counted[s]
        if longer.get(s, 0) >= 0.95 * b or any(f" {s[:cut]}" in kept for cut in range(1, len(s))):
            continue
        kept[f" {s}"] = float(np.log((b + 0.5) / (bad + 1)) - np.log((n - b + 0.5) / (good + 1)))
    return kept


def fitted(x: np.ndarray, y: np.ndarray, ridge: float = 1.0) -> tuple[float, ...]:
    """Logistic regression by Newton steps."""
    x = np.column_stack([np.ones(len(x)), x])
    w = np.zeros(x.shape[1])
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x.T * (p * (1 - p) + 1e-9)) @ x + ridge * np.eye(len(w)), x.T @ (y - p) - ridge * w)
        w += step
        if np.abs(step).max() < 1e-8:
            break
    return tuple(map(float, w))


def learned(docs: DataFrame, labels: DataFrame, most_rows: int = 20_000, least_share: float = 0.005) -> Lexicon:
    """A lexicon from labelled documents; the driver receives tables that the sample bounds (patterns that enough of its documents share, and its measures)."""
    from tidemark.llm.common import stored

    rows = stored(labelled(docs, labels, most_rows), "labelled")
    sizes = dict(rows.groupBy("toxic").count().collect())
    bad, good = sizes.get(1, 0), sizes.get(0, 0)
    if not bad or not good:
        return Lexicon()
    least = max(5, round(least_share * bad))
    # Precise enough: far more often in toxic documents than their share of the sample.
    precise = F.col("bad") / F.col("n") > F.lit(0.5 + 0.5 * bad / (bad + good))
    starts = word_starts(rows).filter((F.col("bad") >= least) & precise)
    lexicon = Lexicon()
    lexicon.weights |= chosen([tuple(r) for r in starts.collect()], bad, good)
    weights = lexicon.weights

    def measured(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        automaton = Lexicon(weights).automaton()
        for batch in batches:
            yield pd.DataFrame([(*measures(automaton, t), int(y)) for t, y in zip(batch.text, batch.toxic, strict=True)], columns=["a", "b", "c", "y"])

    sample = np.array(rows.mapInPandas(measured, "a double, b double, c double, y int").collect(), dtype=float)
    lexicon.curve = fitted(np.minimum(sample[:, :3], 100.0), sample[:, 3])
    return lexicon


def scores(docs: DataFrame, lexicon: Lexicon, text: str = "text", into: str = "score") -> DataFrame:
    """The table with a score between 0 and 1."""
    if into.lower() in {c.lower() for c in docs.columns}:
        raise ValueError(f"the table has a column {into} already")
    weights, curve = lexicon.weights, np.array(lexicon.curve)

    @F.pandas_udf("double")
    def score(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        automaton = Lexicon(weights).automaton()
        for batch in batches:
            x = np.array([measures(automaton, t if isinstance(t, str) else None) for t in batch], dtype=float).reshape(-1, 3)
            z = curve[0] + np.minimum(x, 100.0) @ curve[1:]
            yield pd.Series(1 / (1 + np.exp(-np.clip(z, -30, 30))))

    return docs.withColumn(into, score(F.col(text)))


def toxicity(docs: DataFrame, labels: DataFrame, most_rows: int = 20_000) -> DataFrame:
    """One row a document: doc_id, held_out, score, predicted."""
    out = scores(docs.select("doc_id", "text"), learned(docs, labels, most_rows))
    return out.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
