import itertools
import zlib
from collections import Counter, defaultdict

import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from tidemark.llm.sharding import curve_table, depths, shard_report, write_shards
from tidemark.session import table

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.mark.parametrize(("bits", "dims"), [(2, 2), (3, 3), (4, 2)])
def test_curve_visits_neighbours(spark, bits, dims):
    n = 1 << bits
    rows = sorted((r["curve"], r["cell"]) for r in curve_table(spark, bits, dims).collect())
    assert [c for c, _ in rows] == list(range(n**dims))
    points = [tuple(cell // n**d % n for d in range(dims)) for _, cell in rows]
    assert all(sum(abs(a - b) for a, b in zip(p, q, strict=True)) == 1 for p, q in itertools.pairwise(points))


def check(docs, out):
    rows = docs.collect()
    want = Counter((r["doc_id"], len((r["text"] or "").encode()) + 1, zlib.crc32((r["text"] or "").encode())) for r in rows)
    got = out.collect()
    assert Counter((r["doc_id"], r["size"], r["text_crc32"]) for r in got) == want
    slots = defaultdict(list)
    for r in got:
        assert r["law"] == "rows" and r["grown_shard"] is None
        slots[r["shard"]].append((r["slot"], r["curve"]))
    assert all(sorted(s for s, _ in v) == list(range(len(v))) for v in slots.values())
    sizes = [len(slots[i]) for i in range(16)]
    assert max(sizes) - min(sizes) <= 1
    order = [c for i in range(16) for _, c in sorted(slots[i])]
    assert order == sorted(order)


def test_shards_of_documents(spark):
    docs = table(spark, "/root/testdata/sf0.01", "documents")
    check(docs, shard_report(docs))


def test_edge_cases(spark):
    rows = [(None, None, None, None, None), (1, "", "en", "s", 0), (2, "é" * 100_000, None, "s", 5)] + [(3, "same", "en", "hot", 4)] * 700 + [(i, "same", "en", "hot", 4) for i in range(10, 500)]
    docs = spark.createDataFrame(rows, SCHEMA).withColumn("curve", F.lit(1))
    check(docs, shard_report(docs))
    assert shard_report(spark.createDataFrame([], SCHEMA)).count() == 0


def test_written_files(spark, tmp_path):
    docs = table(spark, "/root/testdata/sf0.001", "documents")
    write_shards(docs, str(tmp_path / "out"))
    back = spark.read.parquet(str(tmp_path / "out"))
    assert sorted(map(tuple, back.select(*docs.columns).collect())) == sorted(map(tuple, docs.collect()))
    assert back.select("shard").distinct().count() == 16


def test_files_can_be_skipped(spark, tmp_path):
    """By the written files' own statistics: shards that a filter on one source or one language must read, of 16."""
    docs = table(spark, "/root/testdata/sf0.1", "documents")
    write_shards(docs, str(tmp_path / "out"))
    ranges = defaultdict(dict)
    for path in (tmp_path / "out").rglob("*.parquet"):
        shard, meta = path.parent.name, pq.ParquetFile(path).metadata
        for g in range(meta.num_row_groups):
            for c in range(meta.num_columns):
                col = meta.row_group(g).column(c)
                if col.path_in_schema in ("source", "lang"):
                    low, high = ranges[shard].get(col.path_in_schema, (col.statistics.min, col.statistics.max))
                    ranges[shard][col.path_in_schema] = min(low, col.statistics.min), max(high, col.statistics.max)
    assert len(ranges) == 16
    for name, most in (("source", 6), ("lang", 8)):
        values = [r[0] for r in docs.select(name).distinct().collect()]
        left = [sum(r[name][0] <= v <= r[name][1] for r in ranges.values()) for v in values]
        assert sum(left) / len(left) <= most


def test_axis_cells_follow_the_order_of_values(spark):
    rows = spark.createDataFrame([(v,) for v in "aaaaaaaabbccdz"], "v string")
    got = {r["v"]: (r["axis"], r["n"]) for r in depths(rows, "v", 3).collect()}
    # Middle rows of 14: 4, 9, 11, 12.5, 13.5, in eighths.
    assert got == {"a": (2, 8), "b": (5, 2), "c": (6, 2), "d": (7, 1), "z": (7, 1)}
