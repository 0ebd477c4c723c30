import hashlib
from collections import Counter

import public_tokenizers
import pytest
import sentencepiece
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from tidemark.llm import alignment
from tidemark.llm.alignment import SHIFT, TwoTokenizers, align, aligned, digests
from tidemark.session import table

A, B = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
BOTH = TwoTokenizers(A, B)
LIB_A, LIB_B = Tokenizer.from_file(A), sentencepiece.SentencePieceProcessor(model_file=B)
LIB_A.encode_special_tokens = True
HARD = ["", " ", "a", "Hello world, don't", "  two  blanks ", "\n\ttabs", "日本語テキスト 한국어", "é café ﬁ", "x▁y", "<s> </s> <unk> <0x41> <|endoftext|>", "\U0001f600\U0001f468‍\U0001f469", "½²", "a" * 3_000, "\x00z", "ＡＢ"]


def letters():
    printable = {*range(33, 127), *range(161, 173), *range(174, 256)}
    out, n = {}, 0
    for b in range(256):
        out[chr(b) if b in printable else chr(256 + n)] = b
        n += b not in printable
    return out


LETTER = letters()


def tokens(text):
    """Brute force: each side's (id, first byte, byte behind the last), or none."""
    if not text:
        return [], []
    side_a = [(i, bytes(LETTER[c] for c in LIB_A.id_to_token(i))) for i in LIB_A.encode(" " + text, add_special_tokens=False).ids]
    side_b = []
    for i in LIB_B.encode(text):
        piece = LIB_B.id_to_piece(i)
        byte = len(piece) == 6 and piece.startswith("<0x")
        side_b.append((i, bytes([int(piece[3:5], 16)]) if byte else piece.replace("▁", " ").encode()))
    if any(b"".join(t for _, t in side) != b" " + text.encode() for side in (side_a, side_b)):
        return [], []
    out = []
    for side in (side_a, side_b):
        at, own = 0, []
        for i, t in side:
            own.append((i, at, at + len(t)))
            at += len(t)
        out.append(own)
    return out


def brute(text):
    a, b = tokens(text)
    pairs = Counter(x * SHIFT + y for x, s, e in a for y, t, f in b if s < f and t < e)
    ends = sorted({e for _, _, e in a} & {e for _, _, e in b})
    groups, start = [], 0
    for end in ends:
        groups.append("|".join(",".join(str(i) for i, s, e in side if start <= s and e <= end) for side in (a, b)))
        start = end
    return len(a), len(b), len(ends), sum(pairs.values()), ";".join(groups), pairs


def same(got, text):
    *counts, pairs, times = got
    want = brute(text)
    assert tuple(counts) == want[:5] and dict(zip(pairs.tolist(), times.tolist(), strict=True)) == want[5]


def test_one_batch_against_brute_force():
    for text, got in zip(HARD, align(BOTH, HARD), strict=True):
        same(got, text)


def test_batches_without_tokens():
    assert [x[:5] for x in align(BOTH, ["", ""])] == [(0, 0, 0, 0, "")] * 2


@settings(max_examples=200, deadline=None)
@given(st.lists(st.text(alphabet=st.sampled_from("aabcdeinorsthäéß' .,!#12日\n\t​▁ﬁ"), max_size=40), max_size=5))
def test_random_texts(texts):
    for text, got in zip(texts, align(BOTH, texts), strict=False):
        same(got, text)


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet=st.sampled_from("aabcdeinZ'stveäßÆɏΩσЖџ¡²½ªµ 10.,!–…\n\t\r"), max_size=60))
def test_common_texts_are_split_as_by_the_library(text):
    assert BOTH.usual and (not text or BOTH.common.fullmatch(text))
    want = LIB_A.encode(" " + text, add_special_tokens=False).ids if text else []
    assert BOTH.side_a([text])[0].tolist() == want


def test_special_strings_and_other_characters():
    texts = ["<|endoftext|>", "a<|endoftext|>b", "\x1c x", "\x85\xa0y", "日本", "\u0378", "x" * 9_000]
    assert [x.tolist() for x in BOTH.side_a(texts)] == [LIB_A.encode(" " + t, add_special_tokens=False).ids for t in texts]


def test_forgetting_pieces_changes_nothing(monkeypatch):
    monkeypatch.setattr(alignment, "MOST_PIECES", 3)
    own = TwoTokenizers(A, B)
    for _ in range(2):
        assert [x.tolist() for x in own.side_a(["a b c", "d e f", ""])] == [x.tolist() for x in BOTH.side_a(["a b c", "d e f", ""])]


def want_digests(rows):
    found = [(doc, brute(text)) for doc, text in rows]
    count = Counter(p for _, f in found for p in f[5])
    most = Counter()
    for p, n in count.items():
        most[p // SHIFT] = max(most[p // SHIFT], n)
    out = []
    for doc, (n_a, n_b, n_groups, n_links, groups, pairs) in found:
        best = sum(n for p, n in pairs.items() if count[p] == most[p // SHIFT])
        out.append((doc, n_a, n_b, n_groups, n_links, best, sum(n * count[p] for p, n in pairs.items()), hashlib.sha256(groups.encode()).hexdigest() if groups else ""))
    return Counter(out)


@pytest.mark.parametrize("most", [500_000, 300, 0])
def test_documents(spark, most):
    """All of a small table against brute force; with few broadcast pairs the rest comes by shuffle."""
    docs = table(spark, "/root/testdata/sf0.001", "documents").filter("length(text) < 3000")
    got = digests(docs, A, B, most=most)
    assert got.dtypes == [*((c, "bigint") for c in ("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum")), ("groups_sha256", "string")]
    assert Counter(map(tuple, got.collect())) == want_digests([(r["doc_id"], r["text"]) for r in docs.collect()])


def test_small_chunks_change_nothing(spark, monkeypatch):
    rows = [(i, t) for i, t in enumerate(HARD)]
    monkeypatch.setattr(alignment, "CHUNK", 2)
    chunks = list(alignment._chunks(__import__("pandas").DataFrame(rows, columns=["doc_id", "text"])))
    assert max(map(len, chunks)) == 2 and [x for c in chunks for x in c] == rows


def test_edge_cases(spark):
    docs = spark.createDataFrame([(1, None, 5), (None, "a b", 5), (2, "a b", 5), (2, "a b", 5), (3, "", 5), (4, "x▁y", 5)], "doc_id long, text string, Pairs int")
    rows = [(r["doc_id"], r["text"]) for r in docs.collect()]
    assert Counter(map(tuple, digests(docs, A, B).collect())) == want_digests(rows)
    assert digests(docs.limit(0), A, B).count() == 0
    out = {r["doc_id"]: r for r in aligned(docs, A, B).collect()}
    assert out[2]["groups"] == brute("a b")[4] and out[4]["groups"] == "" and out[1]["n_a"] == 0
