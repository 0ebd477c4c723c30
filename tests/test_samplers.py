"""Ring buffers of a sampled stream: against a plain fold over the sorted samples, also after a failure in the middle."""

import random
import uuid

import pytest
from pyspark.sql import functions as F

from tidemark.streaming import samplers as S
from tidemark.streaming import windows as W

IDLE, MOST = 3_600_000_000, 5


def plain(rows, most=MOST):
    out = []
    for key in {r[0] for r in rows}:
        runs, own = [], sorted((at, i, w) for k, at, i, w in rows if k == key)
        for s in own:
            if runs and s[0] - runs[-1][-1][0] <= IDLE:
                runs[-1].append(s)
            else:
                runs.append([s])
        for run in runs:
            kept = run[-most:]
            energy = sum((b[0] - a[0]) / 3.6e9 * (a[2] + b[2]) / 2 for a, b in zip(kept, kept[1:], strict=False))
            out.append((key, run[0][0], run[-1][0], len(run), len(kept), round(energy, 6), round(sum(w for *_, w in kept) / len(kept), 6), max(w for *_, w in kept)))
    return sorted(out)


def test_merging_runs():
    a, b = (0, 10, 2, [0, 10], [1, 2], [1.0, 1.0]), (30, 40, 2, [30, 40], [3, 4], [2.0, 2.0])
    assert S.merged([b, a], 19, 3) == [a, b]
    assert S.merged([b, a], 20, 3) == [(0, 40, 4, [10, 30, 40], [2, 3, 4], [1.0, 2.0, 2.0])]
    assert S.merged([], 5, 3) == []


@pytest.fixture
def rocksdb(spark):
    before = spark.conf.get("spark.sql.streaming.stateStore.providerClass")
    S.with_rocksdb(spark)
    yield
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", before)


def samples(seed=4, n=300):
    """Two keys, one of them hot, in disorder of up to 20 minutes; ties of time; null rows."""
    rng, at, rows = random.Random(seed), 1_700_000_000_000_000, []
    for i in range(n):
        at += rng.choice([0, 60, 300, 900, 5_000]) * 1_000_000
        rows.append((rng.choice("aaab"), at, i, float(rng.randint(0, 300))))
    return sorted(rows, key=lambda r: r[1] + rng.random() * 1_200_000_000)


def stream_of(spark, folder):
    return spark.readStream.schema("key string, at long, id long, watts double").option("maxFilesPerTrigger", 1).parquet(folder).withColumn("ts", F.timestamp_micros("at"))


def got(spark, out):
    rows = S.latest(spark.read.parquet(out).drop("batch")).drop("closed").collect()
    return sorted(tuple(r[c] for c in ("key", "first", "last", "n", "kept", "energy_wh", "mean_watts", "peak_watts")) for r in rows)


def feed(spark, rows, folder):
    for i in range(0, len(rows), 75):
        spark.createDataFrame(rows[i : i + 75], "key string, at long, id long, watts double").coalesce(1).write.mode("append").parquet(folder)


def test_disorder_within_the_delay(spark, tmp_path, rocksdb):
    rows = samples()
    folder, out, done = (f"{tmp_path}/{x}" for x in ("in", "out", "done"))
    feed(spark, [*rows, (None, 5, 1, 1.0), ("a", None, 1, 1.0), ("a", 5, 1, None)], folder)
    W.resumed(S.ring_buffers(stream_of(spark, folder), "1 hour", "30 minutes", MOST), out, done, "update")
    assert got(spark, out) == plain(rows)
    closed = spark.read.parquet(out).filter("closed")
    assert 0 < closed.count() and closed.groupBy("key", "first").count().filter("count > 1").count() == 0


def test_a_failed_batch_is_repeated(spark, tmp_path, rocksdb):
    """The sink fails after it has written its third batch; the restarted stream ends with the rows of an unbroken one."""
    rows = samples(9)
    folder, out, done = (f"{tmp_path}/{x}-{uuid.uuid4().hex}" for x in ("in", "out", "done"))
    feed(spark, rows, folder)

    def failing(batch, number):
        batch.write.mode("overwrite").parquet(f"{out}/batch={number}")
        if number == 2:
            raise RuntimeError("lost")

    broken = S.ring_buffers(stream_of(spark, folder), "1 hour", "30 minutes", MOST).writeStream.outputMode("update").option("checkpointLocation", done).foreachBatch(failing).trigger(availableNow=True).start()
    with pytest.raises(Exception, match="lost"):
        broken.awaitTermination()
    W.resumed(S.ring_buffers(stream_of(spark, folder), "1 hour", "30 minutes", MOST), out, done, "update")
    assert got(spark, out) == plain(rows)


def test_batches_are_cut_ahead_of_the_state(spark):
    import pandas as pd

    rows = pd.DataFrame({"key": "a", "at": range(10_000), "id": range(10_000), "watts": 1.0})
    made = pd.concat(S.cut_batches(IDLE, 100, 10**9)(iter([rows])))
    assert len(made) == 1 and made.n.iloc[0] == 10_000 and len(made["at"].iloc[0]) == 100
