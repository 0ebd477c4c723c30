import hashlib

import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from tidemark.llm.bpe import SpeculativeBpe, encoded, token_digests
from tidemark.session import table

PATH = public_tokenizers.path("word_bpe_49k.json")
LIBRARY = Tokenizer.from_file(PATH)
OWN = SpeculativeBpe(PATH)
HARD = ["", "  \n\t ", "Hello, WORLD's 12ab  <|endoftext|>x ΣΑΣ é İ", "<|startoftext|><|endoftext|> 's't're", "don't  we'll I'd", "aaaaaaaaaaaaaaaaaaaaaaaaaaaa", "!!!!!!!! ######", "ｆｕｌｌ width Ǆ ﬁ", "日本語テキスト 한국어 текст", "é café", " x　y\x85z\x1cw​v", "\U0001f600\U0001f468‍\U0001f469", "½ ² ٣ x1y2", "</w> a</w>b", "'S 'T 'RE"]


def library(text):
    ids = LIBRARY.encode(text, add_special_tokens=False).ids
    return ids, LIBRARY.decode(ids, skip_special_tokens=False)


@pytest.mark.parametrize("text", [*HARD, "ab" * 20_000, "x" * 30_000 + " end"])
def test_as_the_library(text):
    ids = OWN.ids(text)
    assert (ids, OWN.decode(ids)) == library(text)


@settings(max_examples=400, deadline=None)
@given(st.text(alphabet=st.sampled_from("aabcdeeinorsthäéß' .,!#12Σİ\n<|>"), max_size=40))
def test_random_texts(text):
    assert OWN.ids(text) == library(text)[0]


def test_verification_decides(spark):
    words = list({w for r in table(spark, "/root/testdata/sf0.01", "documents").filter("doc_id % 7 = 0").select("text").collect() for w in OWN.split(r["text"])})
    failed = SpeculativeBpe(PATH).learn(words)
    assert 0 < failed < len(words)
    assert [OWN.ids(w) for w in words] == [library(w)[0] for w in words]


def test_documents(spark):
    docs = table(spark, "/root/testdata/sf0.001", "documents")
    digest = lambda x: hashlib.sha256(x.encode()).hexdigest()
    want = set()
    for r in docs.collect():
        ids, text = library(r["text"])
        want.add((r["doc_id"], len(ids), digest(" ".join(map(str, ids))), digest(text)))
    assert set(map(tuple, token_digests(docs, PATH).collect())) == want


def test_edge_cases(spark):
    docs = spark.createDataFrame([(1, None, 5), (None, "a b", 5), (2, "a b", 5), (2, "a b", 5), (3, "", 5)], "doc_id long, text string, N_tokens int")
    out = encoded(docs, PATH).collect()
    assert sorted((str(r["doc_id"]), r["bpe"]["n_tokens"], r["bpe"]["decoded"]) for r in out) == [("1", 0, ""), ("2", 2, "a</w> b</w>"), ("2", 2, "a</w> b</w>"), ("3", 0, ""), ("None", 2, "a</w> b</w>")]
    assert token_digests(docs.limit(0), PATH).count() == 0
