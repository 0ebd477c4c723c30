import hashlib
from collections import Counter

import public_tokenizers
from test_mixing import brute as brute_mixture
from test_neardup import firsts as brute_firsts
from tokenizers import Tokenizer

import corpus_pipeline
from tidemark.llm.privacy import anonymised
from tidemark.llm.quality import quality_counts
from tidemark.llm.queries import SURROGATE_KEY
from tidemark.session import table

LIBRARY = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))


def test_stages_keep_the_columns(spark):
    docs = table(spark, "/root/testdata/sf0.001", "documents")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs, None).columns == docs.columns
    empty = docs.limit(0)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, empty, None).count() == 0


def test_run_matches_brute_force(spark):
    sf = "/root/testdata/sf0.001"
    docs = table(spark, sf, "documents")
    rows = {r["doc_id"]: r for r in docs.collect()}
    kept = {r["doc_id"] for r in quality_counts(docs).collect() if r["kept"]}
    firsts = set(brute_firsts([(d, rows[d]["text"]) for d in sorted(kept)]))
    clean = anonymised(docs.filter(docs.doc_id.isin(sorted(firsts))), SURROGATE_KEY).collect()
    copies = brute_mixture([(r["doc_id"], r["text"], r["source"]) for r in clean], 0.95, 2.0, None, 1024, True)
    want = Counter()
    for r in clean:
        ids = LIBRARY.encode(r["text"], add_special_tokens=False).ids
        digest = hashlib.sha256(LIBRARY.decode(ids, skip_special_tokens=False).encode()).hexdigest()
        want[(r["doc_id"], r["source"], len(ids), tuple(ids), digest)] = copies[r["doc_id"]]
    got = Counter((r["doc_id"], r["source"], r["n_tokens"], tuple(r["ids"]), r["decoded_sha256"]) for r in corpus_pipeline.run(spark, sf).collect())
    assert got == +want and len(got) == len(firsts)


def test_defined_cases_pass_all_stages(spark):
    """Nulls in every column, repeated rows, empty and long texts, and extra columns whose names clash."""
    clean = " ".join(f"wort{i * 7919 % 10007}" for i in range(80))
    other = " ".join(f"term{i * 104729 % 10007}" for i in range(90)) + " mail anna.b@example.com"
    long = " ".join(f"w{i * i % 99991}" for i in range(60_000))
    rows = [(1, clean, "en", "s", 1), (1, clean, "en", "s", 1), (2, clean, "en", "s", 1), (None, other, None, None, None), (3, None, None, "s", None), (4, "", "en", None, 0), (5, long, "en", "s", 1), (6, None, None, None, None)]
    docs = spark.createDataFrame([(*r, 7, 8, "x") for r in rows], "doc_id long, text string, lang string, source string, n_chars long, _row int, Kept int, _hits string")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, None)
        assert out.columns == docs.columns
        docs = spark.createDataFrame(out.collect(), docs.schema)
    left = {(r["doc_id"], r["text"].split(" ")[0]) for r in docs.collect()}
    assert left == {(1, "wort0"), (None, "term0"), (5, "w0")} and not any("anna.b@example.com" in r["text"] for r in docs.collect())
    assert {r["doc_id"] for r in corpus_pipeline.STAGES[-1][1](spark, docs, None).collect()} == {1, None, 5}
