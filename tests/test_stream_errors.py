"""Error records of a stream: two sinks that agree with a run that was never broken, limits, and replay."""

import json

import pytest
from pyspark.sql import functions as F

from tidemark.streaming import errors as E

ROWS = [(i, "{" if i % 5 == 0 else None if i % 7 == 0 else json.dumps({"k": i})) for i in range(1, 101)]
PARSE = staticmethod(lambda text: json.loads(text)["k"]).__func__


@pytest.fixture
def source(spark, tmp_path):
    for i in range(0, 100, 25):
        spark.createDataFrame(ROWS[i : i + 25], "id long, text string").coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    return lambda: spark.readStream.schema("id long, text string").option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in").withColumn("t", E.attempt(PARSE, "text", "long"))


def read(spark, tmp_path, name):
    good, bad = (spark.read.parquet(f"{tmp_path}/{name}-{x}").drop("batch") for x in ("good", "bad"))
    return sorted(map(tuple, good.select("id", "result").collect())), sorted(map(tuple, bad.select("id", "error_type", "retries").collect()))


def run(source, tmp_path, name, **options):
    E.two_sinks(source(), "t", f"{tmp_path}/{name}-good", f"{tmp_path}/{name}-bad", f"{tmp_path}/{name}-done", **options)


WANT = [(i, None if t is None else i) for i, t in ROWS if t != "{"], [(i, "JSONDecodeError", 0) for i, t in ROWS if t == "{"]


def test_both_sinks(spark, tmp_path, source):
    run(source, tmp_path, "a")
    assert read(spark, tmp_path, "a") == WANT


def test_killed_between_the_sinks(spark, tmp_path, source):
    def fail(number):
        if number == 2:
            raise RuntimeError("killed between the sinks")

    with pytest.raises(Exception, match="killed between"):
        run(source, tmp_path, "b", between=fail)
    assert len(read(spark, tmp_path, "b")[0]) > len(read(spark, tmp_path, "b")[1]) * 2
    run(source, tmp_path, "b")
    assert read(spark, tmp_path, "b") == WANT


def test_too_many_errors_are_written_before_the_stream_fails(spark, tmp_path, source):
    with pytest.raises(Exception, match="more than 4 errors"):
        run(source, tmp_path, "c", most_errors=4)
    assert len(read(spark, tmp_path, "c")[1]) == 5
    run(source, tmp_path, "c", most_errors=5)
    assert read(spark, tmp_path, "c") == WANT


def test_replay(spark):
    letters = spark.createDataFrame([(1, '{"k": 4}', 0, "X", "m"), (2, "{", 1, "X", "m"), (3, '{"k": 4}', 3, "X", "m"), (4, None, 0, "X", "m")], "id long, text string, retries int, error_type string, message string")
    out = {r["id"]: (r["state"], r["retries"], r["result"], r["error_type"]) for r in E.replayed(letters, PARSE, "text", "long").collect()}
    assert out == {1: ("processed", 1, 4, None), 2: ("failed", 2, None, "JSONDecodeError"), 3: ("remaining", 3, None, "X"), 4: ("processed", 1, None, None)}
    assert list(E.error_counts(letters)) == [("X", 4)]
    assert E.replayed(letters.limit(0), PARSE, "text", "long").count() == 0


def test_an_empty_stream(spark, tmp_path):
    spark.createDataFrame([], "id long, text string").coalesce(1).write.parquet(f"{tmp_path}/none")
    stream = spark.readStream.schema("id long, text string").parquet(f"{tmp_path}/none").withColumn("t", E.attempt(PARSE, F.col("text"), "long"))
    E.two_sinks(stream, "t", f"{tmp_path}/d-good", f"{tmp_path}/d-bad", f"{tmp_path}/d-done")
