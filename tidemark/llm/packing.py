"""Packing token ids into fixed rows by best-fit decreasing (operator 1).

Every input partition is packed by itself, so nothing is shuffled and no key can be hot. A task takes windows
of about ``window`` tokens: memory is bounded, whatever the partition's size. In a window, documents longer
than a row are cut into full rows and a rest, without losing a token; rests are placed longest first, each in
the fullest row that still takes it. A segment tree over remaining capacities finds that row.

Each packed row holds ids (little-endian, padded to the capacity), cumulative segment lengths, positions that
restart at 0 with each segment, and for every segment the document, the offset in it, and the length.

Rows depend on how documents lie in the input's partitions, as windows do not cross them; the tokens packed do not.

Defined cases: a null or empty text (or id list) has no tokens and no segment; repeated rows are packed one by
one; of equal lengths the earlier comes first, and of rows with equal room the one used last; a text of any length is
cut into as many rows as it takes; a null doc_id stays null in its segments; extra columns are not read; an empty table
gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

ROW = "pack_id long, n_tokens int, segments array<struct<doc_id: long, start: int, length: int>>, cu_seqlens array<int>, ids binary, position_ids binary"


class CapacityTree:
    """Open rows by remaining capacity; finds one with the least capacity that is enough."""

    def __init__(self, capacity: int) -> None:
        self.leaves = 1 << capacity.bit_length()
        self.count = [0] * (2 * self.leaves)
        self.rows: list[list[int]] = [[] for _ in range(capacity + 1)]

    def add(self, left: int, row: int) -> None:
        self.rows[left].append(row)
        at = self.leaves + left
        while at:
            self.count[at] += 1
            at >>= 1

    def take(self, need: int) -> tuple[int, int] | None:
        """Remove and return (capacity left, row), or None where no open row is large enough."""
        at = self.leaves + need
        if not self.count[at]:
            while at > 1 and (at & 1 or not self.count[at + 1]):
                at >>= 1
            if at <= 1:
                return None
            at += 1
            while at < self.leaves:
                at = 2 * at if self.count[2 * at] else 2 * at + 1
        left = at - self.leaves
        row = self.rows[left].pop()
        while at:
            self.count[at] -= 1
            at >>= 1
        return left, row


def best_fit_decreasing(lengths: np.ndarray, capacity: int) -> list[list[int]]:
    """Rows as lists of places in ``lengths``; each length is between 1 and the capacity."""
    rows: list[list[int]] = []
    tree = CapacityTree(capacity)
    for i in np.argsort(-lengths, kind="stable").tolist():
        need = int(lengths[i])
        found = tree.take(need)
        if found is None:
            rows.append([i])
            left, row = capacity - need, len(rows) - 1
        else:
            left, row = found[0] - need, found[1]
            rows[row].append(i)
        if left:
            tree.add(left, row)
    return rows


@lru_cache(maxsize=2)
def vocabulary(path: str):
    """A tiktoken encoding from a file of base64 tokens and ranks."""
    import base64

    import public_tokenizers
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, f)}
    return tiktoken.Encoding(path, pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def encode(path: str, text: str) -> np.ndarray:
    return vocabulary(path).encode_to_numpy(text, disallowed_special=())


def _packed_rows(docs: list[tuple[int | None, np.ndarray]], capacity: int, pad: int, first: int) -> pd.DataFrame:
    pieces = [(d, at, ids[at : at + capacity]) for d, ids in docs for at in range(0, len(ids), capacity)]
    kind = "<u2" if pad < 1 << 16 else "<u4"
    place = "<u2" if capacity <= 1 << 16 else "<u4"
    out = []
    for n, row in enumerate(best_fit_decreasing(np.array([len(p[2]) for p in pieces], dtype=np.int64), capacity)):
        own = [pieces[i] for i in row]
        ends = np.cumsum([len(p[2]) for p in own])
        ids, positions = np.full(capacity, pad, dtype=kind), np.zeros(capacity, dtype=place)
        for (_, _, part), end in zip(own, ends, strict=True):
            ids[end - len(part) : end] = part
            positions[end - len(part) : end] = np.arange(len(part))
        segments = [{"doc_id": d, "start": at, "length": len(part)} for d, at, part in own]
        out.append((first + n, int(ends[-1]), segments, [0, *ends.tolist()], ids.tobytes(), positions.tobytes()))
    return pd.DataFrame(out, columns=["pack_id", "n_tokens", "segments", "cu_seqlens", "ids", "position_ids"])


def packed(docs: DataFrame, path: str | None, capacity: int = 2048, window: int = 2_000_000, text: str = "text", ids: str = "ids", pad: int | None = None) -> DataFrame:
    """Packed rows of the documents' tokens: of their texts under a vocabulary file, or of an id column where path is None."""
    column = ids if path is None else text
    fill = pad if pad is not None else (1 << 31) - 1 if path is None else vocabulary(path).n_vocab

    def task(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: list[tuple[int | None, np.ndarray]] = []
        tokens, first = 0, TaskContext.get().partitionId() << 32
        for batch in batches:
            for doc, value in zip(batch.doc_id, batch.value, strict=True):
                if value is None or isinstance(value, float):
                    continue
                got = np.asarray(value, dtype=np.int64) if path is None else encode(path, value)
                held.append((None if pd.isna(doc) else int(doc), got))
                tokens += len(got)
                if tokens >= window:
                    out = _packed_rows(held, capacity, fill, first)
                    first += len(out)
                    held, tokens = [], 0
                    yield out
        if tokens:
            yield _packed_rows(held, capacity, fill, first)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(column).alias("value")).mapInPandas(task, ROW)


def write_matrices(rows: DataFrame, path: str) -> None:
    """Write packed rows as Parquet: each file's ``ids`` column, read in order, is a matrix of ids in C order."""
    rows.write.option("compression", "zstd").parquet(path)


def matrix(column: pd.Series, dtype: str = "<u2") -> np.ndarray:
    """A binary column of a written file as a matrix."""
    return np.stack([np.frombuffer(x, dtype=dtype) for x in column])
