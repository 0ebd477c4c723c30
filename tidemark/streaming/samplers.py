"""Samples of a running machine as a stream, with a ring buffer for each key, its energy, and an end when a key falls silent.

A key's samples form runs: a gap of more than ``idle`` ends one. Of each run the state keeps the last ``most`` samples in the order of
(time, id), in a list state, and how many there were; samples may come late within the watermark's delay. A run that the
watermark has left behind by ``idle`` can change no more: its row goes out as closed and its state is deleted, at the next
sample of the key or by a timer (half the delay more, as below). Until then each batch sends the rows of a key's open runs anew, under a higher version; ``latest`` keeps what
counts. So state is bounded by the runs that are open at a time, and what is sent is right at any point of the stream.

Ahead of the state, batches of rows are cut to the last samples of each key, run and span of half the delay, with counts
for those left out: a key with a third of all rows sends a few thousand of them to its task. Such a part is late only if its
last sample is, so samples up to half the delay behind the watermark may still arrive, and runs wait that much longer.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

#: A run of samples of one key as it is held: first and last time in microseconds, samples seen, and those kept.
RUN = "first long, last long, n long, at array<long>, id array<long>, watts array<double>"
ROWS = "key string, version long, closed boolean, first long, last long, n long, kept int, energy_wh double, mean_watts double, peak_watts double"


def with_rocksdb(spark: SparkSession) -> None:
    """The state store that list states and timers need."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


def merged(runs: list[tuple], idle: int, most: int) -> list[tuple]:
    """Runs in order, with those within ``idle`` of each other made one, each cut to its last samples."""
    out: list[list[tuple]] = []
    end = None
    for run in sorted(runs, key=lambda r: (r[0], r[1])):
        if end is not None and run[0] - end <= idle:
            out[-1].append(run)
            end = max(end, run[1])
        else:
            out.append([run])
            end = run[1]
    made = []
    for parts in out:
        if len(parts) == 1 and len(parts[0][3]) <= most:
            made.append(parts[0])
            continue
        at, ids, watts = (np.concatenate([np.asarray(p[i]) for p in parts]) for i in (3, 4, 5))
        order = np.lexsort((ids, at))[-most:]
        made.append((min(p[0] for p in parts), max(p[1] for p in parts), sum(p[2] for p in parts), at[order].tolist(), ids[order].tolist(), watts[order].tolist()))
    return made


def summary(run: tuple) -> tuple:
    """first, last, n, kept, energy by trapezoids in watt hours, mean and peak of the samples kept."""
    at, watts = np.asarray(run[3], dtype=np.int64), np.asarray(run[5], dtype=np.float64)
    hours = np.diff(at) / 3.6e9
    energy = float(((watts[1:] + watts[:-1]) / 2 * hours).sum())
    return run[0], run[1], run[2], len(at), round(energy, 6), round(float(watts.mean()), 6), float(watts.max())


class Ring(StatefulProcessor):
    """The open runs of a key as a list state, the version of its rows, and a timer for the end of its oldest run."""

    def __init__(self, idle: int, span: int, most: int) -> None:
        self.idle, self.most = idle, most
        self.wait = (idle + span) // 1000 + 1

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.runs = handle.getListState("runs", RUN)
        self.version = handle.getValueState("version", "version long")

    def _step(self, key: tuple, fresh: list[tuple], watermark: int) -> Iterator[pd.DataFrame]:
        held = merged([tuple(r) for r in self.runs.get()] + fresh, self.idle, self.most)
        version = (self.version.get()[0] if self.version.exists() else 0) + 1
        done = [r for r in held if r[1] // 1000 + self.wait < watermark]
        still = [r for r in held if r[1] // 1000 + self.wait >= watermark]
        rows = [(key[0], version, closed, *summary(r)) for closed, own in ((True, done), (False, still)) for r in own]
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)
        self.version.update((version,))
        if still:
            self.runs.put(still)
            self.handle.registerTimer(min(r[1] for r in still) // 1000 + self.wait + 1)
        else:
            self.runs.clear()
        yield pd.DataFrame(rows, columns=[c.split()[0] for c in ROWS.split(", ")])

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        fresh = [(int(f), int(e), int(n), a.tolist(), i.tolist(), w.tolist()) for part in rows for f, e, n, a, i, w in zip(part["first"], part["last"], part["n"], part["at"], part["id"], part["watts"], strict=True)]
        yield from self._step(key, fresh, timerValues.getCurrentWatermarkInMs())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        yield from self._step(key, [], timerValues.getCurrentWatermarkInMs())

    def close(self) -> None:
        pass


def cut_batches(idle: int, most: int, span: int):
    """Rows (key, at, id, watts) to runs (key, ts, first, ...) of a batch: one for each key, run and span of time."""

    def task(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            batch = batch.sort_values(["key", "at", "id"], kind="stable")
            if batch.empty:
                continue
            key, at = batch["key"].to_numpy(), batch["at"].to_numpy()
            new = np.r_[True, (key[1:] != key[:-1]) | (np.diff(at) > idle) | (at[1:] // span != at[:-1] // span)]
            cuts = np.r_[np.flatnonzero(new), len(batch)]
            ids, watts = batch["id"].to_numpy(), batch["watts"].to_numpy(dtype=float)
            rows = [(key[a], at[b - 1], at[a], at[b - 1], b - a, at[max(a, b - most) : b], ids[max(a, b - most) : b], watts[max(a, b - most) : b]) for a, b in zip(cuts, cuts[1:], strict=False)]
            yield pd.DataFrame(rows, columns=["key", "ts", "first", "last", "n", "at", "id", "watts"]).assign(ts=lambda d: pd.to_datetime(d.ts, unit="us", utc=True))

    return task


def ring_buffers(samples: DataFrame, idle: str = "2 hours", delay: str = "30 minutes", most: int = 1000) -> DataFrame:
    """A stream of (key string, ts timestamp, id long, watts double) to rows of runs; see ``latest``. Rows with a null key, time or watts are left out."""
    micros = {"second": 1_000_000, "minute": 60_000_000, "hour": 3_600_000_000, "day": 86_400_000_000}
    length = lambda text: int(text.split()[0]) * micros[text.split()[1].rstrip("s")]
    span = max(1, length(delay) // 2)
    rows = samples.select(F.col("key").cast("string").alias("key"), F.unix_micros("ts").alias("at"), F.col("id").cast("long").alias("id"), F.col("watts").cast("double").alias("watts"))
    cut = rows.filter("key IS NOT NULL AND at IS NOT NULL AND watts IS NOT NULL").mapInPandas(cut_batches(length(idle), most, span), f"key string, ts timestamp, {RUN}")
    return cut.withWatermark("ts", delay).groupBy("key").transformWithStateInPandas(Ring(length(idle), span, most), ROWS, "Update", "eventTime")


def latest(rows: DataFrame) -> DataFrame:
    """What counts of the rows sent: those of closed runs, and those of open runs in the newest version of their key."""
    newest = rows.groupBy("key").agg(F.max("version").alias("newest"))
    return rows.join(newest, "key").filter(F.col("closed") | (F.col("version") == F.col("newest"))).drop("version", "newest")
