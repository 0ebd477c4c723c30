"""Byte-level BPE by prefix dynamic programming (operator 12).

The vocabulary is a file of byte tokens and ranks; each match of a pattern is encoded by itself. For a match, a
table stores for every byte prefix the one token that the prefix's encoding ends with. A token t that ends at byte e is that one if
the prefix before it ends with a token p and p, t stay two tokens side by side: exact merging of their joined bytes gives [p, t].
Just one token passes, as an encoding is the only sequence whose neighbours are all compatible. Walking back through
the table gives the ids.

The table holds all that further bytes can depend on. So appending computes the new prefixes alone, and after an edit the
table is computed anew from the edit on, only until as many last tokens as the longest token has bytes equal the old ones.
``Encoding`` does this for a whole text, whose matches before and behind an edit stay as they are; ``edited`` does it
for a table of texts with lists of edits.

Defined cases: a null text counts as empty (no tokens, empty decoded text); strings of special tokens are plain text;
a match that is a token whole is that token; repeated rows are encoded one by one; texts and matches of any length are encoded
whole, in the memory of one text; ties between merges of one rank go to the leftmost; extra columns stay, whatever their
names, but the name of the result column must be new; an empty table gives an empty result. Null edits count as none, a null
bound as 0, a null text put as empty; bounds of an edit beyond the text, or in the wrong order, are drawn to the text's.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Distinct matches of a generation that a worker remembers, and their bytes; pairs of tokens with a verdict.
MOST_MATCHES, MOST_BYTES, MOST_PAIRS = 160_000, 3_000_000, 400_000
#: In a table: no token yet, and the place before the first byte.
NONE, START = -1, 1 << 31
#: A pair of tokens that is no token has this rank.
NO_RANK = 1 << 40
#: Parts matches in a text with a character a byte.
APART = "\u0100"
#: Texts that a worker holds as lists of matches at a time.
CHUNK = 200


class PrefixBpe:
    """Encoder and decoder for one vocabulary file and pattern."""

    def __init__(self, path: str, pattern: str) -> None:
        import ahocorasick
        import regex

        with open(path, "rb") as f:
            self.rank = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, f)}
        self.token = {i: t for t, i in self.rank.items()}
        self.size = {i: len(t) for i, t in self.token.items()}
        self.longest = max(self.size.values())
        self.four = {i: i.to_bytes(4, "little") for i in self.token}
        #: Finds the tokens that end at each byte of a text with a character a byte.
        self.tokens = ahocorasick.Automaton()
        for t, i in self.rank.items():
            self.tokens.add_word(t.decode("latin-1"), i)
        self.tokens.make_automaton()
        self.pattern = regex.compile(pattern)
        self.pairs: dict[int, bool] = {}
        self.known: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}
        self.held = 0

    def merged(self, data: bytes) -> list[int]:
        """Exact merging of a few bytes: the pair of least rank, leftmost first, until none is left."""
        parts, get, none = [data[i : i + 1] for i in range(len(data))], self.rank.get, NO_RANK
        ranks = [get(a + b, none) for a, b in zip(parts, parts[1:], strict=False)]
        while ranks and (least := min(ranks)) != none:
            at = ranks.index(least)
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
            del ranks[at]
            if at:
                ranks[at - 1] = get(parts[at - 1] + parts[at], none)
            if at < len(ranks):
                ranks[at] = get(parts[at] + parts[at + 1], none)
        return [self.rank[p] for p in parts]

    def compatible(self, before: int, token: int) -> bool:
        """Whether merging leaves two tokens as they are side by side; behind START, one token."""
        if len(self.pairs) >= MOST_PAIRS:
            self.pairs.clear()
        own = [token] if before == START else [before, token]
        verdict = self.pairs[before << 32 | token] = self.merged(b"".join(map(self.token.__getitem__, own))) == own
        return verdict

    def fill(self, text: str, last: list[int], begin: int, end: int) -> None:
        """Table entries ``begin`` + 1 to ``end`` from those up to ``begin``; ``text`` has a character a byte, START stands before a first byte."""
        pairs, judge, size = self.pairs.get, self.compatible, self.size
        for at, token in self.tokens.iter(text, max(0, begin + 1 - self.longest), end):
            at += 1
            if last[at] != NONE or at <= begin:
                continue
            start = at - size[token]
            if start < 0 or (before := last[start]) == NONE:
                continue
            verdict = pairs(before << 32 | token)
            if verdict or (verdict is None and judge(before, token)):
                last[at] = token

    def extend(self, data: bytes, last: list[int]) -> list[int]:
        """Complete a table, which may hold the first prefixes already; entry 0 stands for the empty prefix."""
        last = last or [START]
        begin = len(last) - 1
        last += [NONE] * (len(data) - begin)
        self.fill(data.decode("latin-1"), last, begin, len(data))
        return last

    def rebuilt(self, data: bytes, old: list[int], start: int, end: int, size: int) -> tuple[list[int], int]:
        """The table of ``data``, which has ``size`` bytes in place of the bytes ``start`` to ``end`` of the old table's; and how many entries were computed."""
        text, last, shift = data.decode("latin-1"), old[: start + 1], size - (end - start)
        while (done := len(last) - 1) < len(data):
            upto = min(len(data), max(done, start + size) + 2 * self.longest)
            last += [NONE] * (upto - done)
            self.fill(text, last, done, upto)
            # Where so many last tokens, and the bytes that they looked at, are the old ones, so is all that follows.
            if upto < len(data) and last[upto - self.longest + 1 :] == old[upto - shift - self.longest + 1 : upto - shift + 1]:
                return last + old[upto - shift + 1 :], upto - start
        return last, len(data) - start

    def walked(self, data: bytes, last: list[int], start: int = 0) -> list[int]:
        """The ids of a match, from its end back to its start in the table."""
        if (whole := self.rank.get(data)) is not None:
            return [whole]
        out, at = [], start + len(data)
        while at > start:
            out.append(last[at])
            at -= self.size[last[at]]
        return out[::-1]

    def learn(self, matches: list[str]) -> None:
        """Encode distinct new matches: one table holds them all, as a character that is no byte parts them."""
        data, whole, four = [], self.rank, self.four
        for m in matches:
            own = m.encode()
            if (token := whole.get(own)) is None:
                data.append(own)
            else:
                self.known[m] = four[token]
        matches = [m for m in matches if m not in self.known]
        text = APART.join([d.decode("latin-1") for d in data])
        last = [NONE] * (len(text) + 1)
        at, starts = 0, []
        for d in data:
            last[at] = START
            starts.append(at)
            at += len(d) + 1
        self.fill(text, last, -1, len(text))
        for m, d, start in zip(matches, data, starts, strict=True):
            self.known[m] = b"".join(map(four.__getitem__, self.walked(d, last, start)))

    def encode_batch(self, texts: list[str | None]) -> list[bytes]:
        """For each text its ids as little-endian unsigned 32-bit integers."""
        split = [self.pattern.findall(text or "") for text in texts]
        need = set().union(*split)
        fresh = [m for m in need if m not in self.known]
        if len(self.known) + len(fresh) > MOST_MATCHES or self.held > MOST_BYTES:
            # The matches of two generations are remembered: those in use move on to the next.
            self.older, self.known, self.held = self.known, {}, 0
            fresh = list(need)
        new = []
        for m in fresh:
            if (ids := self.older.get(m)) is None:
                new.append(m)
            else:
                self.known[m] = ids
            self.held += len(m)
        self.learn(new)
        known = self.known.__getitem__
        return [b"".join(map(known, own)) for own in split]

    def ids(self, text: str | None) -> list[int]:
        return np.frombuffer(self.encode_batch([text])[0], dtype="<u4").tolist()

    def decode(self, ids: bytes) -> bytes:
        """The bytes of ids given as little-endian unsigned 32-bit integers."""
        return b"".join(map(self.token.__getitem__, np.frombuffer(ids, dtype="<u4").tolist()))


class Encoding:
    """A text with its tables, which takes appends and edits; ``computed`` counts table entries made so far."""

    def __init__(self, bpe: PrefixBpe, text: str = "") -> None:
        self.bpe, self.text, self.computed = bpe, "", 0
        self.matches: list[tuple[str, list[int]]] = []
        self.edit(0, 0, text)

    def ids(self) -> list[int]:
        return [i for match, last in self.matches for i in self.bpe.walked(match.encode(), last)]

    def append(self, more: str) -> None:
        self.edit(len(self.text), len(self.text), more)

    def edit(self, start: int, end: int, put: str) -> None:
        """Put a text in place of the characters ``start`` to ``end``.

        A match looks two characters past its end at most (white space before a word), so those that end earlier stay.
        The pattern looks at nothing before a match, so once a new match starts where an old one did behind the edit, all after it stay.
        """
        start = min(max(start, 0), len(self.text))
        end = min(max(end, start), len(self.text))
        old, bounds, at = self.matches, [], 0
        for match, _ in old:
            bounds.append(at)
            at += len(match)
        bounds.append(at)
        text = self.text[:start] + put + self.text[end:]
        shift = len(put) - (end - start)
        kept = 0
        while kept < len(old) and bounds[kept + 1] + 2 <= start:
            kept += 1
        where = {at: i for i, at in enumerate(bounds) if at >= end}
        fresh, at = [], bounds[kept]
        rest = len(old)
        for found in self.bpe.pattern.finditer(text, at):
            if found.start() >= start + len(put) and (i := where.get(found.start() - shift)) is not None:
                rest = i
                break
            fresh.append((found.start(), found.group()))
        self.matches = old[:kept] + [(m, self._table(m, at, old[kept], bounds[kept], start, end, len(put.encode())) if n == 0 and kept < len(old) else self._new(m)) for n, (at, m) in enumerate(fresh)] + old[rest:]
        self.text = text

    def _new(self, match: str) -> list[int]:
        self.computed += len(match.encode())
        return self.bpe.extend(match.encode(), [])

    def _table(self, match: str, at: int, before: tuple[str, list[int]], was_at: int, start: int, end: int, size: int) -> list[int]:
        """The table of the match at the edit, from that of the match which was there."""
        old, last = before
        data = match.encode()
        if at == was_at and start >= at and end <= at + len(old):
            head, gone = len(old[: start - at].encode()), len(old[start - at : end - at].encode())
            if data[:head] == old.encode()[:head] and data[head + size :] == old.encode()[head + gone :]:
                out, n = self.bpe.rebuilt(data, last, head, head + gone, size)
                self.computed += n
                return out
        common = 0
        for a, b in zip(data, old.encode(), strict=False):
            if a != b:
                break
            common += 1
        self.computed += len(data) - common
        return self.bpe.extend(data, last[: common + 1])


@lru_cache(maxsize=2)
def encoder(path: str, pattern: str) -> PrefixBpe:
    return PrefixBpe(path, pattern)


KINDS = {"n_tokens": "long", "ids": "array<int>", "decoded": "binary", "ids_sha256": "string", "decoded_sha256": "string"}


def encode_columns(path: str, pattern: str, outputs: tuple[str, ...]):
    """A Pandas UDF from a text to a struct of the outputs asked for: n_tokens, ids, decoded bytes, and the digests of both."""

    @F.pandas_udf(", ".join(f"{name} {KINDS[name]}" for name in outputs))
    def encode(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        bpe = encoder(path, pattern)
        for batch in batches:
            for at in range(0, len(batch), CHUNK):
                rows = []
                for ids in bpe.encode_batch([x if isinstance(x, str) else None for x in batch.iloc[at : at + CHUNK]]):
                    made = {"n_tokens": len(ids) // 4}
                    if "ids" in outputs:
                        made["ids"] = np.frombuffer(ids, dtype="<u4").astype(np.int32)
                    if "ids_sha256" in outputs:
                        made["ids_sha256"] = hashlib.sha256(ids).hexdigest()
                    if "decoded" in outputs or "decoded_sha256" in outputs:
                        made["decoded"] = bpe.decode(ids)
                        made["decoded_sha256"] = hashlib.sha256(made["decoded"]).hexdigest()
                    rows.append([made[name] for name in outputs])
                # Results leave by the chunk, so a worker never holds those of a whole batch.
                yield pd.DataFrame(rows, columns=list(outputs))

    return encode


def encoded(docs: DataFrame, path: str, pattern: str, text: str = "text", into: str = "bpe", outputs: tuple[str, ...] = ("n_tokens", "ids", "decoded")) -> DataFrame:
    """The table with a struct column of the tokens; no shuffle."""
    if into.lower() in {c.lower() for c in docs.columns}:
        raise ValueError(f"the table has a column {into} already")
    return docs.withColumn(into, encode_columns(path, pattern, outputs)(F.col(text)))


def edited(docs: DataFrame, path: str, pattern: str, text: str = "text", edits: str = "edits", into: str = "bpe") -> DataFrame:
    """The table with a struct column of each text after its edits: text, ids, and the table entries that the edits cost.

    ``edits`` is an array of structs (start int, stop int, put string) in characters, applied one after another; no shuffle.
    """
    if into.lower() in {c.lower() for c in docs.columns}:
        raise ValueError(f"the table has a column {into} already")

    @F.pandas_udf("text string, ids array<int>, computed long")
    def run(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        bpe = encoder(path, pattern)
        for texts, lists in batches:
            rows = []
            for own, changes in zip(texts, lists, strict=True):
                made = Encoding(bpe, own or "")
                made.computed = 0
                for e in changes:
                    made.edit(int(e["start"]), int(e["stop"]), e["put"])
                rows.append((made.text, np.array(made.ids(), dtype=np.int32), made.computed))
            yield pd.DataFrame(rows, columns=["text", "ids", "computed"])

    whole = F.transform(
        F.filter(F.coalesce(F.col(edits), F.array()), lambda e: e.isNotNull()),
        lambda e: F.struct(F.coalesce(e["start"], F.lit(0)).alias("start"), F.coalesce(e["stop"], F.lit(0)).alias("stop"), F.coalesce(e["put"], F.lit("")).alias("put")),
    )
    return docs.withColumn(into, run(F.col(text), whole))


def token_digests(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """One row a document: doc_id, n_tokens, ids_sha256, decoded_sha256."""
    return encoded(docs.select("doc_id", "text"), path, pattern, into="_bpe", outputs=("n_tokens", "ids_sha256", "decoded_sha256")).select("doc_id", "_bpe.*")
