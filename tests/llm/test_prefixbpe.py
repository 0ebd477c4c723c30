import base64
import hashlib
import random

import public_tokenizers
import pytest
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st

from tidemark.llm.prefixbpe import Encoding, PrefixBpe, edited, encoded, token_digests
from tidemark.session import table

PATH, PATTERN = public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN
OWN = PrefixBpe(PATH, PATTERN)
with open(PATH, "rb") as f:
    LIBRARY = tiktoken.Encoding("test", pat_str=PATTERN, mergeable_ranks={base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}, special_tokens={})
HARD = ["", " ", "  \n\t ", "Hello, WORLD's 12ab  <|endoftext|>x", "don't  we'll I'd", "a" * 300, " " * 500 + "x", "!!!! ####", "日本語テキスト 한국어 текст", "é café", " x　y\x85z\x1cw​v\x00", "\U0001f600\U0001f468‍\U0001f469", "½ ² ٣", "ÃÂÃÂÃÂÃÂÃÂ", "0" * 99, "-" * 77 + "=" * 130]
LETTERS = st.text(alphabet=st.sampled_from("aabcdeeinorsthäéß' .,!#12日\n\t​"), max_size=60)


@pytest.mark.parametrize("text", [*HARD, "ab" * 10_000, "x" * 20_000 + " end", "\n" * 9_000])
def test_as_the_library(text):
    ids = OWN.ids(text)
    assert ids == LIBRARY.encode_ordinary(text)
    assert OWN.decode(OWN.encode_batch([text])[0]) == text.encode()


@settings(max_examples=400, deadline=None)
@given(LETTERS)
def test_random_texts(text):
    assert OWN.ids(text) == LIBRARY.encode_ordinary(text)


@settings(max_examples=200, deadline=None)
@given(st.binary(max_size=40))
def test_every_prefix_has_its_last_token(data):
    last = OWN.extend(data, [])
    for end in range(1, len(data) + 1):
        want = OWN.merged(data[:end])
        assert last[end] == want[-1]


@settings(max_examples=400, deadline=None)
@given(LETTERS, st.lists(st.tuples(st.integers(-2, 70), st.integers(-2, 70), st.text(alphabet=st.sampled_from("abe' 1\n\tß日"), max_size=6)), max_size=5))
def test_edits_are_exact(text, edits):
    made, want = Encoding(OWN, text), text
    for start, end, put in edits:
        made.edit(start, end, put)
        start = min(max(start, 0), len(want))
        want = want[:start] + put + want[max(end, start) :]
        assert made.text == want and made.ids() == LIBRARY.encode_ordinary(want)


def test_appends_are_exact():
    made, want = Encoding(OWN), ""
    for part in ["Hel", "lo ", " ", "wor", "ld's", "'s ", "\n", "\n x", "12", "34 日", "本"]:
        made.append(part)
        want += part
        assert made.ids() == LIBRARY.encode_ordinary(want)


def test_edits_cost_little():
    """An edit computes entries near it alone, in a long text of words and in one long match."""
    rng = random.Random(5)
    words = " ".join("".join(rng.choices("abcdeinorst", k=rng.randint(2, 9))) for _ in range(5_000))
    match = "".join(rng.choices("abcdeinorst", k=20_000))
    for text in (words, match):
        made = Encoding(OWN, text)
        for at in (100, 10_000, len(text) - 50):
            before = made.computed
            made.edit(at, at + 3, "xyz1"[: 3 if text is match else 4])
            assert made.computed - before < 1_000
            assert made.ids() == LIBRARY.encode_ordinary(made.text)
        before = made.computed
        made.append("tail")
        assert made.computed - before < 300 and made.ids() == LIBRARY.encode_ordinary(made.text)


def test_forgetting_changes_nothing(monkeypatch):
    monkeypatch.setattr("tidemark.llm.prefixbpe.MOST_MATCHES", 5)
    monkeypatch.setattr("tidemark.llm.prefixbpe.MOST_PAIRS", 3)
    own = PrefixBpe(PATH, PATTERN)
    for text in [*HARD, *HARD]:
        assert own.ids(text) == LIBRARY.encode_ordinary(text)


def test_documents(spark):
    docs = table(spark, "/root/testdata/sf0.001", "documents")
    want = set()
    for r in docs.collect():
        ids = LIBRARY.encode_ordinary(r["text"] or "")
        want.add((r["doc_id"], len(ids), hashlib.sha256(b"".join(i.to_bytes(4, "little") for i in ids)).hexdigest(), hashlib.sha256(LIBRARY.decode_bytes(ids)).hexdigest()))
    got = token_digests(docs, PATH, PATTERN)
    assert got.dtypes == [("doc_id", "bigint"), ("n_tokens", "bigint"), ("ids_sha256", "string"), ("decoded_sha256", "string")]
    assert set(map(tuple, got.collect())) == want


def test_edge_cases(spark):
    docs = spark.createDataFrame([(1, None, 5), (None, "a b", 5), (2, "a b", 5), (2, "a b", 5), (3, "", 5)], "doc_id long, text string, N_tokens int")
    out = encoded(docs, PATH, PATTERN).collect()
    assert sorted((str(r["doc_id"]), r["bpe"]["n_tokens"], bytes(r["bpe"]["decoded"])) for r in out) == [("1", 0, b""), ("2", 2, b"a b"), ("2", 2, b"a b"), ("3", 0, b""), ("None", 2, b"a b")]
    assert token_digests(docs.limit(0), PATH, PATTERN).count() == 0
    with pytest.raises(ValueError, match="already"):
        encoded(docs, PATH, PATTERN, into="n_tokens")


def test_edited_table(spark):
    kind = "doc_id long, text string, edits array<struct<start: int, stop: int, put: string>>"
    rows = [(1, "hello world", [(0, 5, "good bye"), (100, 3, "!")]), (2, None, [(0, 0, "x")]), (3, "same", None), (4, "ab", [None, (1, None, None)])]
    out = {r["doc_id"]: r["bpe"] for r in edited(spark.createDataFrame(rows, kind), PATH, PATTERN).collect()}
    assert {k: v["text"] for k, v in out.items()} == {1: "good bye world!", 2: "x", 3: "same", 4: "ab"}
    assert all(v["ids"] == LIBRARY.encode_ordinary(v["text"]) for v in out.values())
    assert out[3]["computed"] == 0
