"""BPE encoding and decoding by speculation and verification (operator 8).

The vocabulary file is one of the tokenizers library's (BPE over byte-level characters with a word-end suffix).
For the distinct words of a batch, greedy longest match proposes tokens; then every adjacent pair of proposed
tokens is tested, over all words at once, for compatibility: a proposal equals the exact result if the
encoding of each token's own text is that token and no merge that the pair's texts would undergo crosses
the border between them. Pairs are cached, so the test is a lookup for most. Only words that fail are merged
exactly. Texts become token ids by joining the words' ids.

Compatibility of a pair (a, b): the exact merging of the text a + b gives the two tokens a and b. Where every
adjacent pair of a sequence is compatible, the sequence is what exact merging gives: merges act within one
token or across one border at a time, the first merge across any border would be one that merging only the
two tokens beside it takes too, as pieces further off do not bear on its rank or its place before it.

Defined cases: a null text counts as empty (no tokens, empty decoded text); strings of special tokens in a
text become those tokens, as the library has it; repeated rows are encoded one by one; texts and words of any length are
encoded whole, in the memory of one text; ties between merges of one rank go to the leftmost; extra columns stay, whatever their
names, but the name of the result column must be new; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import heapq
import json
import re
import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Fixed values of the vocabulary's own file format: its white space, and its pattern of words.
SPACE = r"[\t-\r \x85\xa0  -     　]"
PIECES = rf"'s|'t|'re|'ve|'m|'ll|'d|\p{{L}}+|\p{{N}}|(?:(?!{SPACE})[^\p{{L}}\p{{N}}])+"
#: Distinct words of a generation that a worker remembers, and their characters.
MOST_WORDS, MOST_CHARACTERS = 80_000, 1_500_000

#: The same pattern for texts without any other character than these, and what shows that there is one.
_LATIN = re.compile(r"[a-zß-öø-ÿ]+|'s|'t|'re|'ve|'m|'ll|'d|[0-9]|[^\t-\r a-zß-öø-ÿ0-9]+")
_OTHER = re.compile(r"[^\t-\r -~ß-öø-ÿ]")


def byte_characters() -> dict[int, str]:
    """Byte-level characters: printable Latin-1 bytes stand for themselves, the others follow from 256 on in order."""
    own = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    rest = [b for b in range(256) if b not in set(own)]
    return {b: chr(b) for b in own} | {b: chr(256 + i) for i, b in enumerate(rest)}


class SpeculativeBpe:
    """Encoder and decoder for one vocabulary file."""

    def __init__(self, path: str) -> None:
        import regex

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        self.vocab: dict[str, int] = model["vocab"]
        self.rank = {tuple(m) if isinstance(m, list) else tuple(m.split(" ")): i for i, m in enumerate(model["merges"])}
        self.suffix = model["end_of_word_suffix"] or ""
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.token = {i: t for t, i in self.vocab.items()} | {i: t for t, i in self.special.items()}
        self.split_special = regex.compile("(" + "|".join(map(regex.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None
        self.pieces = regex.compile(PIECES)
        self.chars = byte_characters()
        self.byte_table = {b: c for b, c in self.chars.items()}
        self.none = len(self.rank)
        self.number = {t: str(i) for t, i in self.vocab.items()}
        self.known = all(c in self.vocab and c + self.suffix in self.vocab for c in self.chars.values())
        self.longest = max(map(len, self.vocab))
        self.forget()
        self.older: dict[str, tuple[str, str]] = {}
        self.pairs: dict[int, bool] = {}
        self.sound: dict[int, bool] = {}

    def split(self, text: str) -> list[str]:
        """The words of a text: NFC, lower case character by character, then the pattern.

        White space only separates words, so its runs need no folding. Texts of Basic Latin and Latin-1 letters,
        digits and signs take the same pattern with plain classes.
        """
        text = text if text.isascii() else unicodedata.normalize("NFC", text)
        text = text.lower() if "Σ" not in text else "".join(c.lower() for c in text)
        return self.pieces.findall(text) if _OTHER.search(text) else _LATIN.findall(text)

    def characters(self, word: str) -> str:
        """A word as byte-level characters."""
        return word if word.isascii() and word.isprintable() else word.encode().decode("latin-1").translate(self.byte_table)

    def merged(self, symbols: list[str]) -> list[str]:
        """Exact merging: the pair of least rank, leftmost first, until none is left."""
        if len(symbols) > 64:
            return self._merged_long(symbols)
        out, get, none = list(symbols), self.rank.get, self.none
        ranks = [get(pair, none) for pair in zip(out, out[1:], strict=False)]
        while ranks and (least := min(ranks)) != none:
            at = ranks.index(least)
            out[at : at + 2] = [out[at] + out[at + 1]]
            del ranks[at]
            if at:
                ranks[at - 1] = get((out[at - 1], out[at]), none)
            if at < len(ranks):
                ranks[at] = get((out[at], out[at + 1]), none)
        return out

    def _merged_long(self, symbols: list[str]) -> list[str]:
        """The same with a heap of pairs, for words of any length."""
        out: list[str | None] = list(symbols)
        n = len(out)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = [(r, i, a, b) for i, (a, b) in enumerate(zip(out, out[1:], strict=False)) if (r := self.rank.get((a, b))) is not None]
        heapq.heapify(heap)
        while heap:
            _, i, a, b = heapq.heappop(heap)
            j = after[i]
            if out[i] != a or j >= n or out[j] != b:
                continue  # one of the two has been merged since
            out[i], out[j] = a + b, None
            after[i] = after[j]
            if after[j] < n:
                before[after[j]] = i
            for left, right in ((before[i], i), (i, after[i])):
                if left >= 0 and right < n and (r := self.rank.get((out[left], out[right]))) is not None:
                    heapq.heappush(heap, (r, left, out[left], out[right]))
        return [x for x in out if x is not None]

    def parts(self, token: str) -> list[str]:
        """A token's text as single symbols."""
        if self.suffix and token.endswith(self.suffix) and token != self.suffix:
            body = list(token[: -len(self.suffix)])
            body[-1] += self.suffix
            return body
        return list(token)

    def greedy(self, text: str) -> list[int] | None:
        """Ids by longest match from the left, the last with the word end; None where a character is unknown."""
        out, at, n, get, suffix = [], 0, len(text), self.vocab.get, self.suffix
        while at < n:
            found = get(text[at:] + suffix) if n - at <= self.longest else None
            if found is not None:
                out.append(found)
                return out
            for end in range(min(n - 1, at + self.longest), at, -1):
                found = get(text[at:end])
                if found is not None:
                    out.append(found)
                    at = end
                    break
            else:
                return None
        return out

    def compatible(self, code: int) -> bool:
        """Whether two ids, as one number, stay two tokens side by side."""
        known = self.pairs.get(code)
        if known is None:
            a, b = self.token[code >> 32], self.token[code & 0xFFFFFFFF]
            known = self.pairs[code] = self.merged(self.parts(a) + self.parts(b)) == [a, b]
        return known

    def reachable(self, i: int) -> bool:
        """Whether a token's own text is encoded as that token."""
        known = self.sound.get(i)
        if known is None:
            known = self.sound[i] = self.merged(self.parts(self.token[i])) == [self.token[i]]
        return known

    def learn(self, words: list[str]) -> int:
        """Encode distinct new words; returns how many had to be merged exactly."""
        self.held += sum(map(len, words))
        if len(self.pairs) > 2 * MOST_WORDS:
            self.pairs.clear()
        texts = [self.characters(w) for w in words]
        proposed = [self.greedy(t) for t in texts]
        size = np.array([len(p or ()) for p in proposed])
        flat = np.array([i for p in proposed if p for i in p], dtype=np.int64)
        of = np.repeat(np.arange(len(words)), size)
        bad = size == 0
        # Every token once, then every adjacent pair once: verdicts are spread back over all words.
        ids, at = np.unique(flat, return_inverse=True)
        unsound = np.array([not self.reachable(i) for i in ids.tolist()], dtype=bool)
        bad[of[unsound[at]]] = True
        inside = np.flatnonzero(of[1:] == of[:-1])
        codes, at = np.unique((flat[inside] << 32) | flat[inside + 1], return_inverse=True)
        clash = np.array([not self.compatible(c) for c in codes.tolist()], dtype=bool)
        bad[of[inside[clash[at]]]] = True
        token, number = self.token.__getitem__, self.number
        for w, text, own, exact in zip(words, texts, proposed, bad.tolist(), strict=True):
            if exact:
                symbols = list(text)
                symbols[-1] += self.suffix
                tokens = [t for t in self.merged(symbols) if t in number]
            else:
                tokens = list(map(token, own))
            self.words[w] = " ".join([number[t] for t in tokens]), " ".join(tokens)
        return int(bad.sum())

    def encode_batch(self, texts: list[str | None]) -> list[tuple[str, str]]:
        """For each text its ids and its tokens, each joined by one blank."""
        split: list[list[str]] = []
        for text in texts:
            own: list[str] = []
            for part in [text or ""] if self.split_special is None else self.split_special.split(text or ""):
                if part in self.special:
                    own.append(part)
                elif part:
                    own.extend(self.split(part))
            split.append(own)
        need = set().union(*split)
        fresh = [w for w in need if w not in self.words]
        if len(self.words) + len(fresh) > MOST_WORDS or self.held > MOST_CHARACTERS:
            # The words of two generations are remembered: those in use move on to the next.
            self.older = self.words
            self.forget()
            fresh = [w for w in need if w not in self.words]
        again = [w for w in fresh if w in self.older]
        for w in again:
            self.words[w] = self.older[w]
        self.held += sum(map(len, again))
        if len(again) < len(fresh):
            self.learn([w for w in fresh if w not in self.words])
        words = self.words
        if not self.known:
            split = [[w for w in own if words[w][0]] for own in split]
        return [(" ".join([words[w][0] for w in own]), " ".join([words[w][1] for w in own])) for own in split]

    def forget(self) -> None:
        """Start a generation with the special tokens alone."""
        self.words = {s: (str(i), s) for s, i in self.special.items()}
        self.held = 0

    def ids(self, text: str | None) -> list[int]:
        return [int(i) for i in self.encode_batch([text])[0][0].split()]

    def decode(self, ids: list[int]) -> str:
        """The tokens joined by spaces: the vocabulary's file names no decoder."""
        return " ".join(self.token[i] for i in ids)


@lru_cache(maxsize=2)
def encoder(path: str) -> SpeculativeBpe:
    return SpeculativeBpe(path)


#: Texts that a worker holds as lists of words at a time.
CHUNK = 200


def encode_columns(path: str, outputs: tuple[str, ...]):
    """A Pandas UDF from a text to a struct of the outputs asked for, among n_tokens, ids, decoded and the digests of both."""
    kinds = {"n_tokens": "long", "ids": "array<int>", "decoded": "string", "ids_sha256": "string", "decoded_sha256": "string"}

    @F.pandas_udf(", ".join(f"{name} {kinds[name]}" for name in outputs))
    def encode(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        bpe = encoder(path)
        for batch in batches:
            for at in range(0, len(batch), CHUNK):
                rows = []
                for ids, tokens in bpe.encode_batch([x if isinstance(x, str) else None for x in batch.iloc[at : at + CHUNK]]):
                    made = {"n_tokens": ids.count(" ") + 1 if ids else 0, "decoded": tokens}
                    if "ids" in outputs:
                        made["ids"] = np.fromstring(ids, dtype=np.int32, sep=" ")  # four bytes an id, a batch holds thousands of texts
                    if "ids_sha256" in outputs:
                        made["ids_sha256"] = hashlib.sha256(ids.encode()).hexdigest()
                    if "decoded_sha256" in outputs:
                        made["decoded_sha256"] = hashlib.sha256(tokens.encode()).hexdigest()
                    rows.append([made[name] for name in outputs])
                # Results leave by the chunk, so a worker never holds those of a whole batch.
                yield pd.DataFrame(rows, columns=list(outputs))

    return encode


def encoded(docs: DataFrame, path: str, text: str = "text", into: str = "bpe", outputs: tuple[str, ...] = ("n_tokens", "ids", "decoded")) -> DataFrame:
    """The table with a struct column of the tokens; no shuffle."""
    if into.lower() in {c.lower() for c in docs.columns}:
        raise ValueError(f"the table has a column {into} already")
    return docs.withColumn(into, encode_columns(path, outputs)(F.col(text)))


def token_digests(docs: DataFrame, path: str) -> DataFrame:
    """One row a document: doc_id, n_tokens, ids_sha256, decoded_sha256."""
    return encoded(docs.select("doc_id", "text"), path, into="_bpe", outputs=("n_tokens", "ids_sha256", "decoded_sha256")).select("doc_id", "_bpe.*")
