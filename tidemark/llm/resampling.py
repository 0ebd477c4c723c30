"""Resampling documents towards a target distribution by hashed word features (operator 11).

A text is lower-cased in A to Z and split by an untrained pre-tokeniser of the tokenizers library: a Regex Split, which
returns the words with their offsets. Windows over the offsets of the words (put together with one blank between
neighbours) are the features: runs of one to ``longest`` words. A feature's bucket is the CRC-32 of its bytes modulo ``buckets``.
A window's CRC follows from those of its words, as CRC-32 is linear: the CRC of a longer run is that of the shorter, moved over
the bytes of the next word, exclusive-or the CRC of that word. So all windows of a batch are array operations.

Texts are split once. Each document's buckets are stored in order, as differences, about a byte a feature. Histograms
are added up in the tasks, then in Spark; the gains of all buckets (``buckets`` numbers, a parameter) reach the driver and
go out to the tasks, which add up each document's weight. A keyed hash of doc_id turns weights into scores (the Gumbel trick: the highest
scores are a sample without replacement in proportion to the exponentiated weights). Of the scores, a mergeable quantile sketch
gives a bound that a little more than the share to be drawn lies above; only rows above it are put in order, by ranges of (score,
doc_id), and numbered by the counts of the ranges. Where the sketch's bound lets too few pass, all rows are put in order.

Defined cases: a null or empty text has no words, no features and weight 0; a null doc_id is hashed as the empty string, and
comes after all others of its score; repeated rows are scored and drawn one by one; equal rows take their places in any
order; words and texts of any length are taken whole, in the memory of one text; an empty table gives an empty result, an empty
target has gains from the documents alone; extra columns are not read.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.common import stored

#: A word is a run of digits, lower-case letters and characters beyond ASCII.
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: Texts, and characters of texts, that a worker splits at a time; a longer text comes by itself. Words that it knows the CRC of.
CHUNK, CHUNK_CHARACTERS, MOST_WORDS = 256, 400_000, 150_000


@lru_cache(maxsize=1)
def splitter():
    """The pre-tokeniser: text to words with offsets; everything between words is dropped."""
    from tokenizers import Regex, pre_tokenizers

    return pre_tokenizers.Split(Regex(WORD), behavior="removed", invert=True)


@lru_cache(maxsize=32)
def moved_by(power: int) -> np.ndarray:
    """What 2^power zero bytes behind a message do to its CRC's register: for each of its four bytes a table of 256 words."""
    if power:
        half = moved_by(power - 1)
        return _through(half, _through(half, np.arange(256, dtype=np.uint32)[None] << np.arange(0, 32, 8, dtype=np.uint32)[:, None]))
    one = np.array([zlib.crc32(bytes([i])) ^ zlib.crc32(b"\0") for i in range(256)], dtype=np.uint32)
    low = np.arange(256, dtype=np.uint32)
    return np.stack([one, low, low << np.uint32(8), low << np.uint32(16)])


def _through(table: np.ndarray, crc: np.ndarray) -> np.ndarray:
    return table[0][crc & 255] ^ table[1][crc >> 8 & 255] ^ table[2][crc >> 16 & 255] ^ table[3][crc >> 24]


def joined(crc: np.ndarray, more: np.ndarray, size: np.ndarray) -> np.ndarray:
    """CRCs of two messages one after the other, from those of both and the second's bytes."""
    crc = crc.copy()
    for power in range(int(size.max(initial=0)).bit_length()):
        at = np.flatnonzero(size >> power & 1)
        crc[at] = _through(moved_by(power), crc[at])
    return crc ^ more


class Words(dict):
    """Word to its row in a table of CRCs: of the word, of the word behind a blank, and its bytes; a new word is looked up once."""

    def __init__(self) -> None:
        self.table, self.fresh = np.zeros((0, 3), dtype=np.int64), []

    def __missing__(self, word: str) -> int:
        data = word.encode()
        at = self[word] = len(self.table) + len(self.fresh)
        self.fresh.append((zlib.crc32(data), zlib.crc32(b" " + data), len(data)))
        return at

    def rows(self, words: list[str]) -> np.ndarray:
        if len(self) > MOST_WORDS:
            self.clear()
            self.__init__()
        at = np.fromiter(map(self.__getitem__, words), dtype=np.int64, count=len(words))
        if self.fresh:
            self.table, self.fresh = np.concatenate([self.table, np.array(self.fresh, dtype=np.int64)]), []
        return self.table[at]


def windows(offsets: np.ndarray, doc: np.ndarray, crc: np.ndarray, behind: np.ndarray, longest: int) -> tuple[np.ndarray, np.ndarray]:
    """Document and CRC of all windows of one to ``longest`` words: ``offsets`` are the words' first bytes and ends in the joined texts."""
    docs, crcs = [doc], [crc]
    for k in range(1, longest):
        if len(doc) <= k:
            break
        inside = np.flatnonzero(doc[k:] == doc[:-k])
        # A window one word longer: the offsets of its last word tell how far the CRC so far moves.
        last = inside + k
        longer = np.zeros(len(doc), dtype=np.uint32)
        longer[inside] = joined(crc[inside], behind[last], offsets[last, 1] - offsets[last, 0] + 1)
        crc = longer
        docs.append(doc[inside])
        crcs.append(crc[inside])
    return np.concatenate(docs), np.concatenate(crcs)


def features(texts: list[str], known: Words, longest: int, buckets: int) -> tuple[np.ndarray, list[np.ndarray]]:
    """For each text its number of words, and the buckets of all its features in order."""
    split, words, n_words = splitter().pre_tokenize_str, [], np.zeros(len(texts), dtype=np.int64)
    for i, text in enumerate(texts):
        own = [w for w, _ in split(text.encode().lower().decode())]
        n_words[i] = len(own)
        words += own
    values = known.rows(words)
    size, doc = values[:, 2], np.repeat(np.arange(len(texts)), n_words)
    # Offsets in the texts of words joined by one blank; the characters' own offsets would count whatever lies between.
    ends = np.cumsum(size + 1) - 1
    of, crc = windows(np.stack([ends - size, ends], axis=1), doc, values[:, 0].astype(np.uint32), values[:, 1].astype(np.uint32), longest)
    keys = np.sort(of * buckets + crc % np.uint32(buckets))
    cuts = np.searchsorted(keys, np.arange(len(texts) + 1) * buckets)
    return n_words, [keys[a:b] - i * buckets for i, (a, b) in enumerate(zip(cuts, cuts[1:], strict=False))]


def packed(own: np.ndarray) -> bytes:
    """Buckets in order, as differences."""
    return np.diff(own, prepend=0).astype("<u4").tobytes()


def unpacked(data: bytes) -> np.ndarray:
    return np.cumsum(np.frombuffer(data, dtype="<u4").astype(np.int64))


def featurised(docs: DataFrame, text: str = "text", longest: int = 3, buckets: int = 10_000) -> DataFrame:
    """doc_id, n_words, n_features and the packed buckets of every document; no shuffle."""

    def task(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        known = Words()
        for batch in batches:
            texts = [t if isinstance(t, str) else "" for t in batch.text]
            ids = [None if pd.isna(d) else int(d) for d in batch.doc_id]
            at = 0
            while at < len(texts):
                end, size = at, 0
                while end < len(texts) and end - at < CHUNK and (end == at or size + len(texts[end]) <= CHUNK_CHARACTERS):
                    size += len(texts[end])
                    end += 1
                n_words, own = features(texts[at:end], known, longest, buckets)
                yield pd.DataFrame({"doc_id": pd.array(ids[at:end], dtype="Int64"), "n_words": n_words, "n_features": [len(x) for x in own], "buckets": [packed(x) for x in own]})
                at = end

    kept = docs.select((F.col("doc_id") if "doc_id" in docs.columns else F.lit(None)).cast("long").alias("doc_id"), F.col(text).alias("text"))
    return kept.mapInPandas(task, "doc_id long, n_words long, n_features long, buckets binary")


def histogram(rows: DataFrame, buckets: int = 10_000) -> DataFrame:
    """bucket and the number of features in it over all rows; a task sends one row for each bucket that it met."""

    def task(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        found = np.zeros(buckets, dtype=np.int64)
        for batch in batches:
            for data in batch.buckets:
                np.add.at(found, unpacked(data), 1)
        at = np.flatnonzero(found)
        yield pd.DataFrame({"bucket": at, "n": found[at]})

    return rows.select("buckets").mapInPandas(task, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n"))


def gains(source: DataFrame, target: DataFrame, buckets: int = 10_000) -> DataFrame:
    """bucket and gain of every bucket: floor(1000 ln((t+1)(S+buckets) / ((s+1)(T+buckets))))."""
    both = histogram(source, buckets).select("bucket", F.col("n").alias("s"), F.lit(0).alias("t")).unionByName(histogram(target, buckets).select("bucket", F.lit(0).alias("s"), F.col("n").alias("t")))
    every = source.sparkSession.range(buckets).select(F.col("id").alias("bucket"), F.lit(0).alias("s"), F.lit(0).alias("t"))
    one = stored(both.unionByName(every).groupBy("bucket").agg(F.sum("s").alias("s"), F.sum("t").alias("t")), "histogram")
    total = one.agg(F.sum("s").alias("source"), F.sum("t").alias("target")).first()
    ratio = (F.col("t") + 1).cast("double") * (total["source"] + buckets) / ((F.col("s") + 1).cast("double") * (total["target"] + buckets))
    return one.select("bucket", F.floor(F.lit(1000.0) * F.log(ratio)).cast("long").alias("gain"))


def weighed(rows: DataFrame, gain: DataFrame, buckets: int = 10_000) -> DataFrame:
    """The rows with the sum of the gains of their features in place of their buckets."""
    table = np.zeros(buckets, dtype=np.int64)
    for r in gain.collect():  # as many rows as buckets, a parameter
        table[r["bucket"]] = r["gain"]
    sent = rows.sparkSession.sparkContext.broadcast(table)

    @F.pandas_udf("long")
    def weight(column: pd.Series) -> pd.Series:
        return pd.Series([int(sent.value[unpacked(data)].sum()) for data in column], dtype="int64")

    return rows.select("doc_id", "n_words", "n_features", weight("buckets").alias("weight"))


def gumbel(seed: int, doc_id: Column) -> Column:
    """floor(-1000 ln(-ln((h + 0.5) / 2^32))) of the first 32 bits of a keyed SHA-256."""
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit(""))), 256), 1, 8), 16, 10).cast("double")
    return F.floor(F.lit(-1000.0) * F.log(-F.log((h + 0.5) / 4294967296.0))).cast("long")


def ranked(rows: DataFrame, drawn: int, least: int | None) -> DataFrame:
    """The stored rows with their rank from the highest score down, null beyond ``drawn``; only scores of ``least`` or more are put in order."""
    may = F.col("may_draw") if least is None else F.col("may_draw") & (F.col("score") >= least)
    order = [F.col("score").desc(), F.col("doc_id").asc_nulls_last(), F.col("n_")]
    # The running number parts equal rows, so that no range has to hold all of them.
    part = stored(rows.filter(may).withColumn("n_", F.monotonically_increasing_id()).repartitionByRange(*order).withColumn("part_", F.spark_partition_id()), "ranges")
    sizes = part.groupBy("part_").count()
    before = sizes.select("part_", (F.sum("count").over(Window.orderBy("part_")) - F.col("count")).alias("before_"))  # one row a range
    place = F.row_number().over(Window.partitionBy("part_").orderBy(*order)) + F.col("before_")
    numbered = part.join(F.broadcast(before), "part_").withColumn("rank", place.cast("long")).drop("n_", "part_", "before_")
    numbered = numbered.withColumn("rank", F.when(F.col("rank") <= drawn, F.col("rank")))
    return numbered.unionByName(rows.filter(~may).withColumn("rank", F.lit(None).cast("long")))


def resampled(docs: DataFrame, target: DataFrame, text: str = "text", longest: int = 3, buckets: int = 10_000, share: tuple[int, int] = (5, 100), least_words: int = 20, seed: int = 42) -> DataFrame:
    """doc_id, n_features, weight, score and rank of every document; drawn are ``share`` of those with ``least_words`` words or more."""
    rows = stored(featurised(docs, text, longest, buckets), "features")
    gain = gains(rows, stored(featurised(target, text, longest, buckets), "target-features"), buckets)
    scored = stored(weighed(rows, gain, buckets).withColumns({"score": F.col("weight") + gumbel(seed, F.col("doc_id")), "may_draw": F.col("n_words") >= least_words}), "scores")
    able = scored.filter("may_draw")
    part, whole = share
    # A fifth more than the share, by the sketch's rank; then it is counted.
    found = able.agg(F.count("*").alias("n"), F.approx_percentile("score", F.lit(max(0.0, 1 - 1.2 * part / whole)), 10_000).alias("least")).first()
    drawn, least = part * found["n"] // whole, found["least"]
    if least is not None and able.filter(F.col("score") >= least).count() < drawn:
        least = None
    return ranked(scored, drawn, least).select("doc_id", "n_features", "weight", "score", "rank")


def drawn_documents(docs: DataFrame, result: DataFrame) -> DataFrame:
    """The whole rows of the documents that a result draws, by doc_id."""
    return docs.join(result.filter(F.col("rank").isNotNull()).select("doc_id").distinct(), "doc_id", "left_semi")
