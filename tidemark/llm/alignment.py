"""Alignment of two tokenizers' tokens over the same bytes (operator 13).

Tokenizer A is a file of the tokenizers library, tokenizer B one of sentencepiece, which puts a blank before each text;
A gets the same blank. Where A is byte-level with its usual pattern, texts of common letters are split here and each distinct piece
is merged by the library once; all other texts go through the library whole. A batch of documents becomes two frames of tokens: document, first byte, id. Documents follow one
another on one line of bytes, so both frames are in order. ``pandas.merge_asof``, keyed by document, finds for each
token's start the other side's token that covers it. Two tokens overlap just if the start of one lies in the other, so
the union of both directions holds every overlapping pair, once. Bytes where tokens of both sides end cut a document into groups.

``aligned`` writes, for each document, its links and groups. ``pair_counts`` counts for each pair of ids the documents that
hold it linked, combined in the tasks before the shuffle; pairs of ids are at most |A| x |B|, however large the corpus. ``digests``
brings the counts back to the documents: of the pairs, those of the highest counts go by broadcast (at most ``most``
rows), the others by a shuffle join. As pairs of low counts have few rows by definition, no key of that join is hot.

Defined cases: a null or empty text has no tokens, and so has one whose joined tokens differ from blank + text on either
side (the second tokenizer normalises some characters away; U+2581 in a text would be read as a blank): zeros and the empty string.
Strings of special tokens are plain text. Repeated rows are aligned one by one, also in the counts, and a null doc_id stays null.
Texts of any length are aligned whole, in the memory of one text. Ties for the best partner all count as best. Extra columns are
not read; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import json
import os
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.bpe import byte_characters
from tidemark.llm.common import stored

#: Texts, and characters of texts, that a worker aligns at a time; a longer text comes by itself.
CHUNK, CHUNK_CHARACTERS = 256, 400_000
ALIGNED = "row long, doc_id long, n_a long, n_b long, n_groups long, n_links long, groups string, groups_sha256 string, pairs array<long>, times array<int>"
#: Fixed value: the pattern that byte-level files of the tokenizers library split by.
PIECES = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Texts of these characters alone are split alike by any version of Unicode: ASCII, Latin, Greek and Cyrillic letters and signs.
COMMON = r"[\t\n\r -~¡-ɏΑ-ΡΣ-ωЀ-џ‐-‧]*"
#: Distinct pieces that a worker remembers, and their characters.
MOST_PIECES, MOST_PIECE_CHARACTERS = 200_000, 4_000_000
NONE = np.zeros(0, dtype=np.int64)
#: A pair's number is A's id times this plus B's id.
SHIFT = 1 << 32


class TwoTokenizers:
    """Both tokenizers, with the bytes of each token's id."""

    def __init__(self, path_a: str, path_b: str) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark has its own tasks
        import regex
        import sentencepiece
        from tokenizers import Tokenizer

        self.a = Tokenizer.from_file(path_a)
        self.a.encode_special_tokens = True
        self.b = sentencepiece.SentencePieceProcessor(model_file=path_b)
        self.char = byte_characters()
        byte = {c: b for b, c in self.char.items()}
        size = self.a.get_vocab_size()
        self.bytes_a = [bytes(byte.get(c, 63) for c in self.a.id_to_token(i)) for i in range(size)]
        self.bytes_b = [self._piece(i) for i in range(self.b.get_piece_size())]
        self.size_a, self.size_b = (np.array([len(t) for t in side]) for side in (self.bytes_a, self.bytes_b))
        self.pool_b, self.first_b = np.frombuffer(b"".join(self.bytes_b), dtype=np.uint8), np.cumsum(self.size_b) - self.size_b
        #: An id's text inside a group and at the end of its side of the group.
        self.text_a = np.array([f"{i}{end}" for end in ",|" for i in range(size)], dtype=object)
        self.text_b = np.array([f"{i}{end}" for end in ",;" for i in range(len(self.bytes_b))], dtype=object)

        spec = json.loads(self.a.to_str())
        usual = {"type": "ByteLevel", "add_prefix_space": False, "use_regex": True}
        self.usual = set(self.char.values()) <= self.a.get_vocab().keys() and spec["normalizer"] is None and usual.items() <= (spec["pre_tokenizer"] or {}).items() and not any(t["normalized"] for t in spec["added_tokens"] if not t["special"])
        self.pieces, self.common = regex.compile(PIECES), re.compile(COMMON)
        self.eight = [i.to_bytes(8, "little") for i in range(size)]
        self.known: dict[str, bytes] = {}
        self.held = 0

    def _learn(self, pieces: set[str]) -> None:
        """Merge new pieces by the library. As the vocabulary has a token for each byte, a piece's tokens hold its bytes."""
        if len(self.known) + len(pieces) > MOST_PIECES or self.held > MOST_PIECE_CHARACTERS:
            self.known, self.held = {}, 0
        fresh = list(pieces - self.known.keys())
        tokenize, eight, char, blank = self.a.model.tokenize, self.eight, self.char, self.char[32]
        for p in fresh:
            plain = p.replace(" ", blank) if p.isascii() and p.isprintable() else p.encode().decode("latin-1").translate(char)
            self.known[p] = b"".join([eight[t.id] for t in tokenize(plain)])
        self.held += sum(map(len, fresh))

    def side_a(self, texts: list[str]) -> list[np.ndarray]:
        """Ids of side A, a blank before each text; none where the tokens' bytes are not those of the text."""
        out: list[np.ndarray] = [NONE] * len(texts)
        plain = [bool(t) and self.usual and self.common.fullmatch(t) is not None for t in texts]
        split = {i: self.pieces.findall(f" {texts[i]}") for i, is_plain in enumerate(plain) if is_plain}
        self._learn(set().union(*split.values()))
        for i, own in split.items():
            out[i] = np.frombuffer(b"".join(map(self.known.__getitem__, own)), dtype="<i8")
        other = [i for i, is_plain in enumerate(plain) if texts[i] and not is_plain]
        for i, e in zip(other, self.a.encode_batch_fast([f" {texts[i]}" for i in other], add_special_tokens=False), strict=True):
            if b"".join(map(self.bytes_a.__getitem__, e.ids)) == b" " + texts[i].encode():
                out[i] = np.array(e.ids, dtype=np.int64)
        return out

    def _piece(self, i: int) -> bytes:
        piece = self.b.id_to_piece(i)
        return bytes([int(piece[3:5], 16)]) if self.b.is_byte(i) else piece.replace("▁", " ").encode()

    def encode(self, texts: list[str]) -> tuple[list[np.ndarray], list[np.ndarray]]:
        """Ids of both sides for every text; none where a side's bytes are not those of the text."""
        side_a = self.side_a(texts)
        side_b = [np.array(ids, dtype=np.int64) for ids in self.b.encode(texts, num_threads=1)]
        want = [b" " + t.encode() if t else b"" for t in texts]
        # All texts of a chunk at once; where one differs, text by text.
        every = self._joined_b(side_b) == b"".join(want)
        every = every and [int(self.size_b[ids].sum()) for ids in side_b] == list(map(len, want))
        same = [len(ids_a) and (every or b"".join(map(self.bytes_b.__getitem__, ids_b.tolist())) == own) for ids_a, ids_b, own in zip(side_a, side_b, want, strict=True)]
        return [x if s else NONE for x, s in zip(side_a, same, strict=True)], [x if s else NONE for x, s in zip(side_b, same, strict=True)]

    def _joined_b(self, side: list[np.ndarray]) -> bytes:
        """The bytes of all tokens of side B."""
        flat = np.concatenate(side) if side else NONE
        size = self.size_b[flat]
        end = np.cumsum(size)
        at = np.arange(end[-1] if len(end) else 0) + np.repeat(self.first_b[flat] - (end - size), size)
        return self.pool_b[at].tobytes()


@lru_cache(maxsize=2)
def tokenizers(path_a: str, path_b: str) -> TwoTokenizers:
    return TwoTokenizers(path_a, path_b)


def _tokens(ids: list[np.ndarray], size: np.ndarray) -> pd.DataFrame:
    """A frame of all tokens: document, id, first byte and the byte behind its last, on one line of all documents' bytes."""
    flat = np.concatenate(ids)
    end = np.cumsum(size[flat])
    return pd.DataFrame({"doc": np.repeat(np.arange(len(ids)), [len(x) for x in ids]), "id": flat, "start": end - size[flat], "end": end, "place": np.arange(len(flat))})


def links(a: pd.DataFrame, b: pd.DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Places in both frames of all pairs of tokens that overlap."""
    covering = lambda own, other: pd.merge_asof(own[["doc", "start", "place"]], other[["doc", "start", "place"]].rename(columns={"place": "other"}), on="start", by="doc").other.to_numpy()
    of_a, of_b = covering(a, b), covering(b, a)
    # Tokens that start together meet in both directions: they count once.
    extra = a.start.to_numpy()[of_b] != b.start.to_numpy()
    return np.concatenate([a.place.to_numpy(), of_b[extra]]), np.concatenate([of_a, b.place.to_numpy()[extra]])


def align(both: TwoTokenizers, texts: list[str]) -> list[tuple]:
    """For every text: n_a, n_b, n_groups, n_links, groups, the numbers of its linked pairs, and how often each is linked."""
    if not texts:
        return []
    ids_a, ids_b = both.encode(texts)
    a, b = _tokens(ids_a, both.size_a), _tokens(ids_b, both.size_b)
    nothing = (0, 0, 0, 0, "", np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int32))
    if a.empty:
        return [nothing] * len(texts)
    place_a, place_b = links(a, b)
    end_a, end_b = a.end.to_numpy(), b.end.to_numpy()
    last_a, last_b = np.isin(end_a, end_b, assume_unique=True), np.isin(end_b, end_a, assume_unique=True)
    # A token's group counts the common ends before it; in the text, A's tokens of a group stand before B's.
    group_a, group_b = np.cumsum(last_a) - last_a, np.cumsum(last_b) - last_b
    text = np.empty(len(a) + len(b), dtype=object)
    text[np.arange(len(a)) + np.searchsorted(group_b, group_a)] = both.text_a[a.id.to_numpy() + last_a * len(both.size_a)]
    text[np.arange(len(b)) + np.searchsorted(group_a, group_b, side="right")] = both.text_b[b.id.to_numpy() + last_b * len(both.size_b)]
    # The distinct pairs of each document, with their numbers of links: document and both ids in one number are sorted.
    wide_a, wide_b = len(both.size_a).bit_length(), len(both.size_b).bit_length()
    key = np.sort(a.doc.to_numpy()[place_a] << (wide_a + wide_b) | a.id.to_numpy()[place_a] << wide_b | b.id.to_numpy()[place_b])
    first = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
    times = np.diff(np.r_[first, len(key)]).astype(np.int32)
    of = key[first] >> (wide_a + wide_b)
    pair = (key[first] >> wide_b & ((1 << wide_a) - 1)) * SHIFT + (key[first] & ((1 << wide_b) - 1))
    doc = key >> (wide_a + wide_b)
    n = len(texts)
    n_links, n_groups = np.bincount(doc, minlength=n), np.bincount(a.doc.to_numpy()[last_a], minlength=n)
    size_a, size_b = [len(x) for x in ids_a], [len(x) for x in ids_b]
    cuts, text_cuts = np.searchsorted(of, np.arange(n + 1)), np.r_[0, np.cumsum(np.add(size_a, size_b))]
    out = []
    for i in range(n):
        if not size_a[i]:
            out.append(nothing)
            continue
        groups = "".join(text[text_cuts[i] : text_cuts[i + 1]].tolist())[:-1]
        own = slice(cuts[i], cuts[i + 1])
        out.append((size_a[i], size_b[i], int(n_groups[i]), int(n_links[i]), groups, pair[own], times[own]))
    return out


def _chunks(batch: pd.DataFrame) -> Iterator[list[tuple[int | None, str]]]:
    held: list[tuple[int | None, str]] = []
    size = 0
    for doc, text in zip(batch.doc_id, batch.text, strict=True):
        text = text if isinstance(text, str) else ""
        if held and (len(held) >= CHUNK or size + len(text) > CHUNK_CHARACTERS):
            yield held
            held, size = [], 0
        held.append((None if pd.isna(doc) else int(doc), text))
        size += len(text)
    if held:
        yield held


def aligned(docs: DataFrame, path_a: str, path_b: str, text: str = "text", groups: bool = True) -> DataFrame:
    """One row a document: counts, groups as ``a1,a2|b1;a3|b2,b3`` (null where ``groups`` is false) with their digest, and
    its linked pairs (A's id x 2^32 + B's id) with the number of links of each. ``row`` numbers the rows; no shuffle."""

    def task(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        both = tokenizers(path_a, path_b)
        row = TaskContext.get().partitionId() << 32
        for batch in batches:
            for chunk in _chunks(batch):
                out = []
                for (doc, _), (*counts, own, pairs, times) in zip(chunk, align(both, [t for _, t in chunk]), strict=True):
                    out.append((row, doc, *counts, own if groups else None, hashlib.sha256(own.encode()).hexdigest() if own else "", pairs, times))
                    row += 1
                yield pd.DataFrame(out, columns=["row", "doc_id", "n_a", "n_b", "n_groups", "n_links", "groups", "groups_sha256", "pairs", "times"]).astype({"doc_id": "Int64"})

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(text).alias("text")).mapInPandas(task, ALIGNED)


def pair_counts(rows: DataFrame) -> DataFrame:
    """pair, documents that hold it linked, and whether that is the highest count of its A id. One A id has at most |B| pairs."""
    counts = stored(rows.select(F.explode("pairs").alias("pair")).groupBy("pair").agg(F.count("*").alias("count")), "pair-counts")
    key = F.shiftright("pair", 32).alias("a")
    best = counts.groupBy(key).agg(F.max("count").alias("most"))
    return counts.select("*", key).join(best, "a").select("pair", "count", (F.col("count") == F.col("most")).alias("best"))


def frequent_bound(counts: DataFrame, most: int) -> int:
    """The least power of two, or 0, for which at most ``most`` pairs have a higher count; one row of sums reaches the driver."""
    bounds = [0, *(1 << k for k in range(48))]
    row = counts.agg(*[F.count_if(F.col("count") > c).alias(str(c)) for c in bounds]).first()
    return next(c for c in bounds if row[str(c)] <= most or c == bounds[-1])


def digests(docs: DataFrame, path_a: str, path_b: str, most: int = 500_000) -> DataFrame:
    """One row a document: doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256."""
    rows = stored(aligned(docs, path_a, path_b, groups=False).drop("groups"), "aligned")
    counts = stored(pair_counts(rows), "pairs")
    bound = frequent_bound(counts, most)
    kept = ["row", "doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256"]
    held = rows.select(*kept, F.explode(F.arrays_zip("pairs", "times")).alias("link")).select(*kept, "link.pairs", "link.times").withColumnRenamed("pairs", "pair")
    frequent = counts.filter(F.col("count") > bound)
    found = held.join(F.broadcast(frequent), "pair")
    if bound:
        # Partial sums by document first would not help here: a row is one link of one rare pair.
        rare = held.join(F.broadcast(frequent.select("pair")), "pair", "left_anti").join(counts.filter(F.col("count") <= bound), "pair")
        found = found.unionByName(rare)
    sums = found.select(*kept, F.when(F.col("best"), F.col("times").cast("long")).otherwise(F.lit(0)).alias("n_best"), (F.col("times") * F.col("count")).alias("count_sum"))
    none = rows.filter(F.size("pairs") == 0).select(*kept, F.lit(0).cast("long").alias("n_best"), F.lit(0).cast("long").alias("count_sum"))
    out = sums.groupBy(*kept).agg(F.sum("n_best").alias("n_best"), F.sum("count_sum").alias("count_sum")).unionByName(none)
    return out.select("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")
