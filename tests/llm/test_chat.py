from collections import defaultdict

import duckdb
import pytest

from tidemark.llm.chat import ORACLE, numbered, rotated, rotation_report
from tidemark.session import table

SCHEMA = "conv_id long, turn long, role string, text string, messages int"


def brute(rows, size):
    talks = defaultdict(list)
    for r in rows:
        talks[r[0]].append((r[1] is not None, r[1] or 0, r[2] or "unknown", r[3] or ""))
    out = []
    for conv, turns in talks.items():
        turns.sort()
        for who in {t[2] for t in turns} - {"system"}:
            for at in range(0, len(turns), size):
                text, spans = "", []
                for _, _, role, content in turns[at : at + size]:
                    kind = "system" if role == "system" else "assistant" if role == who else "user"
                    text += f"<|im_start|>{kind}" + (f" name={role}" if kind == "user" else "") + "\n"
                    if kind == "assistant":
                        spans.append((len(text), len(text) + len(content)))
                    text += content + "<|im_end|>\n"
                out.append((conv, who, at // size, text, tuple(spans)))
    return sorted(out, key=str)


def got(df):
    return sorted(((r["conv_id"], r["perspective"], r["segment"], r["text"], tuple(map(tuple, r["mask"]))) for r in df.collect()), key=str)


@pytest.mark.parametrize("size", [3, 64])
def test_conversations(spark, size):
    turns = table(spark, "/root/testdata/sf0.01", "conversations")
    assert got(rotated(turns, size)) == brute([tuple(r) for r in turns.collect()], size)


def test_edge_cases(spark):
    rows = [(1, 0, "system", "s"), (1, 1, "anna", "é\U0001f600"), (1, 1, "anna", "é\U0001f600"), (1, 1, "bob", None), (1, None, "bob", "first"), (None, 0, None, "x"), (2, 0, "system", "only")] + [(3, i // 4, f"p{i % 3}", "t" * (i % 5)) for i in range(500)]
    turns = spark.createDataFrame([(*r, 5) for r in rows], SCHEMA)
    assert got(rotated(turns, 10)) == brute(rows, 10)
    assert rotated(turns.limit(0)).count() == 0
    assert sorted(r["_at"] for r in numbered(turns, "conv_id", "turn", "role", "text").filter("_conv = 3").collect()) == list(range(500))


def test_oracle(spark):
    con = duckdb.connect()
    con.execute("CREATE VIEW conversations AS SELECT * FROM read_parquet('/root/testdata/sf0.01/conversations.parquet')")
    names = ["conv_id", "perspective", "segment", "n_turns", "text", "mask"]
    want = con.execute(f"SELECT {', '.join(names)} FROM ({ORACLE})").fetchall()
    assert sorted(map(tuple, rotation_report(table(spark, "/root/testdata/sf0.01", "conversations")).select(*names).collect())) == sorted(want)
