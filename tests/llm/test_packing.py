import random
from collections import defaultdict

import numpy as np
import public_tokenizers
import tiktoken
from pyspark.sql import functions as F

from tidemark.llm.packing import best_fit_decreasing, matrix, packed, vocabulary, write_matrices
from tidemark.session import table

PATH = public_tokenizers.path("byte_bpe_50k.tiktoken")


def brute(lengths, capacity):
    """Best fit decreasing by trying every open row; ties go to the row opened or used last."""
    rows, left = [], []
    stacks = defaultdict(list)
    for i in sorted(range(len(lengths)), key=lambda i: -lengths[i]):
        fits = [c for c in stacks if c >= lengths[i] and stacks[c]]
        if fits:
            c = min(fits)
            row = stacks[c].pop()
            rows[row].append(i)
        else:
            c, row = capacity, len(rows)
            rows.append([i])
        if c - lengths[i]:
            stacks[c - lengths[i]].append(row)
    del left
    return rows


def test_best_fit_matches_brute_force():
    rnd = random.Random(1)
    for capacity in (1, 7, 8, 64, 100):
        for n in (0, 1, 5, 300):
            lengths = [rnd.randint(1, capacity) for _ in range(n)]
            assert best_fit_decreasing(np.array(lengths, dtype=np.int64), capacity) == brute(lengths, capacity)


def check(rows, capacity, want, pad):
    back = defaultdict(dict)
    for r in rows:
        ids, positions = np.frombuffer(r["ids"], "<u2"), np.frombuffer(r["position_ids"], "<u2")
        assert len(ids) == len(positions) == capacity and r["cu_seqlens"][0] == 0 and r["cu_seqlens"][-1] == r["n_tokens"]
        assert (ids[r["n_tokens"] :] == pad).all()
        for s, a, b in zip(r["segments"], r["cu_seqlens"][:-1], r["cu_seqlens"][1:], strict=True):
            assert b - a == s["length"] and positions[a:b].tolist() == list(range(b - a))
            back[s["doc_id"]][s["start"]] = ids[a:b].tolist()
    assert {d: [t for at in sorted(p) for t in p[at]] for d, p in back.items()} == want
    assert len({r["pack_id"] for r in rows}) == len(rows)


def test_round_trip_of_documents(spark, tmp_path):
    docs = table(spark, "/root/testdata/sf0.001", "documents")
    write_matrices(packed(docs, PATH, capacity=256, window=20_000), str(tmp_path / "packed"))
    rows = spark.read.parquet(str(tmp_path / "packed"))
    encoding: tiktoken.Encoding = vocabulary(PATH)
    want = {r["doc_id"]: encoding.encode_ordinary(r["text"]) for r in docs.collect()}
    check(rows.collect(), 256, want, 50256)
    assert matrix(rows.select("ids").toPandas().ids).shape == (rows.count(), 256)
    assert rows.agg(F.sum("n_tokens")).first()[0] >= 0.97 * 256 * rows.count()
    assert all(encoding.decode(v) == r["text"] for r in docs.collect() for v in [want[r["doc_id"]]])


def test_edge_cases(spark):
    docs = spark.createDataFrame([(1, None, 9), (2, "", 9), (None, "some text", 9), (3, "word " * 3000, 9), (4, "same", 9), (4, "same", 9)], "doc_id long, text string, N_TOKENS int")
    rows = packed(docs, PATH, capacity=64).collect()
    got = sum(len(r["segments"]) for r in rows if any(s["doc_id"] == 4 for s in r["segments"]) for _ in [0])
    assert got >= 2 and sum(s["doc_id"] == 4 for r in rows for s in r["segments"]) == 2
    assert {s["doc_id"] for r in rows for s in r["segments"]} == {None, 3, 4}
    assert packed(docs.limit(0), PATH).count() == 0
    ids = spark.createDataFrame([(1, [5, 6, 7]), (2, None), (3, [])], "doc_id long, ids array<int>")
    (row,) = packed(ids, None, capacity=4).collect()
    assert np.frombuffer(row["ids"], "<u4").tolist() == [5, 6, 7, (1 << 31) - 1]


def brute_rows(docs, encode, capacity, window, pad):
    """Packed rows of one partition: windows of tokens, full rows and rests, and best fit by trying every open row."""
    out, held, tokens = [], [], 0

    def close():
        pieces = [(d, at, ids[at : at + capacity]) for d, ids in held for at in range(0, len(ids), capacity)]
        for row in brute([len(p[2]) for p in pieces], capacity):
            ids, places, segments, ends = [], [], [], [0]
            for i in row:
                d, at, part = pieces[i]
                ids += part
                places += range(len(part))
                segments.append((d, at, len(part)))
                ends.append(len(ids))
            left = capacity - len(ids)
            out.append((segments, ends, ids + [pad] * left, places + [0] * left))

    for d, text in docs:
        if text is None:
            continue
        held.append((d, encode(text)))
        tokens += len(held[-1][1])
        if tokens >= window:
            close()
            held, tokens = [], 0
    if tokens:
        close()
    return out


def test_packed_rows_match_brute_force(spark):
    encoding = vocabulary(PATH)
    docs = [(r["doc_id"], r["text"]) for r in table(spark, "/root/testdata/sf0.001", "documents").orderBy("doc_id").collect()]
    docs += [(None, "same text here"), (7, "same text here"), (7, "same text here"), (8, None), (9, ""), (10, "word " * 120_000), (11, "x")]
    frame = spark.createDataFrame([(*d, 3) for d in docs], "doc_id long, text string, Segments int").coalesce(1)
    got = packed(frame, PATH, capacity=128, window=20_000).collect()
    rows = [([tuple(s) for s in r["segments"]], list(r["cu_seqlens"]), np.frombuffer(r["ids"], "<u2").tolist(), np.frombuffer(r["position_ids"], "<u2").tolist()) for r in got]
    assert rows == brute_rows(docs, lambda t: encoding.encode(t, disallowed_special=()), 128, 20_000, encoding.n_vocab)
    assert [r["pack_id"] for r in got] == sorted({r["pack_id"] for r in got})


def test_rows_are_full(spark):
    """At 2,048 tokens and production windows nearly all places hold a token."""
    got = packed(table(spark, "/root/testdata/sf0.1", "documents"), PATH).agg(F.sum("n_tokens"), F.count("*")).first()
    assert got[0] / (2048 * got[1]) > 0.99
