"""Session windows over disordered files, with repeated and late rows, against a plain simulation of the watermark."""

import random

from pyspark.sql import functions as F

from tidemark.streaming import windows as W

MINUTE = 60_000_000
T0 = 1_700_000_000_000_000


def files(seed=8):
    """Ten files of (at, user, id, value): in disorder, some rows hours late, some sent twice."""
    rng, out, at, n = random.Random(seed), [], T0, 0
    for _ in range(10):
        own = []
        for _ in range(30):
            at += rng.randint(1, 8) * MINUTE
            late = rng.choice([0] * 12 + [5 * MINUTE, 300 * MINUTE])
            own.append((at - late, rng.choice("aab"), n, float(rng.randint(1, 9))))
            n += 1
        own += rng.sample(own, 3)
        rng.shuffle(own)
        out.append(own)
    return out


def simulated(parts, delay, gap):
    """Rows that count and how many are late: a batch drops what lies behind the watermark of the batch before the last."""
    marks, kept, late, seen, newest = [0], {}, 0, set(), 0
    for i, own in enumerate(parts):
        mark = marks[i - 1] if i else 0
        for r in own:
            if r[0] // 1000 <= mark:
                late += 1
            elif r[2] not in seen:
                seen.add(r[2])
                kept[r[2]] = r
        newest = max([newest, *(r[0] for r in own)])
        marks.append(newest // 1000 - delay // 1000)
    out = []
    for user in "ab":
        runs = []
        for r in sorted(r for r in kept.values() if r[1] == user):
            if runs and r[0] - runs[-1][-1][0] <= gap:
                runs[-1].append(r)
            else:
                runs.append([r])
        out += [(user, run[0][0], run[-1][0] + gap, len(run), sum(r[3] for r in run)) for run in runs]
    return sorted(out), late


def test_sessions(spark, tmp_path):
    parts = files()
    kind = "at long, user string, event_id long, value double"
    for own in [*parts, [(T0 + 10**11, "end", -1, 0.0)]]:
        spark.createDataFrame(own, kind).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema(kind).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in").withColumn("ts", F.timestamp_micros("at"))
    query = W.resumed(W.sessions(stream, "user", "15 minutes", "60 minutes"), f"{tmp_path}/out", f"{tmp_path}/done")
    rows = spark.read.parquet(f"{tmp_path}/out").filter("user <> 'end'").select("user", F.unix_micros("started"), F.unix_micros("ended"), "n", "total").collect()
    want, late = simulated(parts, 60 * MINUTE, 15 * MINUTE)
    assert late > 10 and W.late_rows(query) == late
    assert sorted(map(tuple, rows)) == want


def test_followed(spark, tmp_path):
    parts = files(3)
    kind = "at long, user string, event_id long, value double"
    for own in parts:
        spark.createDataFrame(own, kind).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    stream = lambda: spark.readStream.schema(kind).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in").withColumn("ts", F.timestamp_micros("at"))
    pairs = W.followed(stream().filter("value < 5"), stream().filter("value >= 5"), "user", "20 minutes", "10 hours")
    W.resumed(pairs, f"{tmp_path}/out", f"{tmp_path}/done")
    rows = [r for own in parts for r in own]
    want = sorted((a[1], a[2], b[2]) for a in rows if a[3] < 5 for b in rows if b[3] >= 5 and a[1] == b[1] and 0 <= b[0] - a[0] <= 20 * MINUTE)
    assert sorted(map(tuple, spark.read.parquet(f"{tmp_path}/out").drop("batch").collect())) == want


def test_arrivals(spark, tmp_path):
    events = spark.createDataFrame([(i, T0 + i * MINUTE) for i in range(20)], "event_id long, at long").withColumn("ts", F.timestamp_micros("at").cast("timestamp_ntz"))
    sizes = [spark.read.parquet(f"{tmp_path}/a").count() for _ in W.arrivals(events, f"{tmp_path}/a", 4)]
    assert sizes == [5, 10, 15, 20]
