import math
import random
import zlib
from collections import Counter

import pytest

from tidemark.llm.common import stored
from tidemark.llm.toxicity import EXCEPTIONS, Lexicon, chosen, folded, labelled, learned, measures, scores, toxicity, word_starts
from tidemark.session import table


@pytest.mark.parametrize(("text", "want"), [("You IDIOT!", " you idiot "), ("st0p, m0r0n", " stop moron "), ("l0s3r's", " loser s "), ("іdіоt", " idiot "), ("привет", " привет "), (None, "  "), ("trash###", " trash "), ("ｓｃｕｍ", " scum "), ("id10t", " idiot ")])
def test_folding(text, want):
    assert folded(text) == want


def test_exceptions_and_length():
    a = Lexicon().automaton()
    assert measures(a, "a trash can and a clown fish")[0] == 0
    assert measures(a, "you trash, in the trash can")[0] == 4.0
    assert measures(a, "idiot")[1] > measures(a, "idiot " + "word " * 50)[1]
    assert measures(a, "idiotic trashy")[0] == 0


def test_closed_starts_are_chosen():
    got = chosen([("lowe", 90, 90), ("lowei", 90, 90), ("loweix", 20, 20), ("loweix ", 20, 20), ("bad ", 30, 31)], 100, 900)
    assert set(got) == {" lowei", " bad "} and all(w > 3 for w in got.values())


def test_held_out_accuracy(spark):
    docs, labels = (table(spark, "/root/testdata/sf0.1", t) for t in ("documents", "labels"))
    got = {r["doc_id"]: r for r in toxicity(docs, labels).collect()}
    truth = [(r["doc_id"], r["toxic"]) for r in labels.collect()]
    assert all(got[d]["held_out"] == (zlib.crc32(str(d).encode()) % 5 == 0) for d in got)
    held = [(got[d]["predicted"], t) for d, t in truth if got[d]["held_out"]]
    right = sum(p == t for p, t in held)
    found, toxic = sum(p and t for p, t in held), sum(t for _, t in held)
    assert right / len(held) >= 0.97 and found / toxic >= 0.85
    assert all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.5) for r in got.values())


def test_edge_cases(spark):
    docs = spark.createDataFrame([(1, None, 1), (2, "", 1), (3, "you stupid idiot", 1), (3, "you stupid idiot", 1), (None, "fine words here", 1), (4, "word " * 100_000, 1)], "doc_id long, text string, Score int")
    labels = spark.createDataFrame([(3, None), (None, 1)], "doc_id long, toxic int")
    got = sorted((str(r["doc_id"]), r["predicted"]) for r in toxicity(docs, labels).collect())
    assert got == [("1", 0), ("2", 0), ("3", 1), ("3", 1), ("4", 0), ("None", 0)]
    assert toxicity(docs.limit(0), labels.limit(0)).count() == 0
    assert scores(docs, learned(docs, labels), into="tox").columns == [*docs.columns, "tox"]


def naive(lexicon, text):
    """The measures by looking for one pattern after the other, everywhere."""
    s = folded(text)
    places = lambda p: [i for i in range(len(s)) if s.startswith(p, i)]
    spared = [(i, i + len(p) + 2) for p in EXCEPTIONS for i in places(f" {p} ")]
    hits = [w for p, w in lexicon.weights.items() for i in places(p) if not any(a <= i and i + len(p) <= b for a, b in spared)]
    return (sum(hits), 100 * sum(hits) / s.count(" "), 1.0) if hits else (0.0, 0.0, 0.0)


def test_scores_match_brute_force(spark):
    docs, labels = (table(spark, "/root/testdata/sf0.01", t) for t in ("documents", "labels"))
    lexicon = learned(docs, labels)
    got = {r["doc_id"]: r["score"] for r in toxicity(docs, labels).collect()}
    for r in docs.filter("n_chars < 3000").collect():
        z = lexicon.curve[0] + sum(min(m, 100.0) * c for m, c in zip(naive(lexicon, r["text"]), lexicon.curve[1:], strict=True))
        assert abs(got[r["doc_id"]] - 1 / (1 + math.exp(-z))) < 1e-9


def test_measures_of_mixed_texts_match_brute_force():
    rnd, lexicon = random.Random(2), Lexicon()
    lexicon.weights |= {" tra": 1.5, " trash c": -0.5, " m0r": 9.0, " lo ": 2.0, " loser": 1.0}
    a = lexicon.automaton()
    parts = ["trash", "can", "l0ser", "bracket", "m0ron", "lo", "fish", "clown", "car", "word", "Trash-can", "mörtel", "іdіоt"]
    for _ in range(300):
        text = " ".join(rnd.choices(parts, k=rnd.randrange(12)))
        assert measures(a, text) == pytest.approx(naive(lexicon, text))


def test_word_starts_match_brute_force(spark):
    docs, labels = (table(spark, "/root/testdata/sf0.01", t) for t in ("documents", "labels"))
    rows = stored(labelled(docs, labels, 200), "labelled")
    bad, every = Counter(), Counter()
    for r in rows.collect():
        starts = Counter(s for w in set(folded(r["text"]).split()) for s in [w + " ", *[w[:i] for i in range(4, min(len(w), 12) + 1)]])
        every += starts
        bad += starts if r["toxic"] else Counter()
    assert {r["start"]: (r["bad"], r["n"]) for r in word_starts(rows).collect()} == {s: (bad[s], n) for s, n in every.items()}


def test_sample_is_the_same_each_time(spark):
    """Of several texts and labels of one doc_id the same ones count, wherever the rows lie."""
    rows = [(i, f"text {j}") for i in range(1, 40) for j in range(3)] + [(2, None)]
    labels = spark.createDataFrame([(i, i % 2) for i in range(1, 40)] + [(4, 1)], "doc_id long, toxic int")
    sample = lambda r: sorted(map(tuple, labelled(spark.createDataFrame(r, "doc_id long, text string"), labels, 30).collect()))
    assert sample(rows) == sample(rows[::-1]) and {t for t, _ in sample(rows)} <= {"text 0", ""}


def test_clashing_score_column(spark):
    docs = spark.createDataFrame([(1, "idiot", 3)], "doc_id long, text string, SCORE int")
    with pytest.raises(ValueError, match="already"):
        scores(docs, Lexicon())
