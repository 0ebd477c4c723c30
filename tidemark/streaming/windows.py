"""Structured Streaming forms of the event analytics: windowed counts, cooldown of alerts, running state."""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

EVENTS = "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string"


def event_stream(spark: SparkSession, folder: str, name: str = "events.parquet", files: int = 10) -> DataFrame:
    """New files of a table, one file or a folder of part files, as a stream; the watermark column is a timestamp with a zone."""
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{folder}/{name}")
    parts = path.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(path).isDirectory()
    reader = spark.readStream.schema(EVENTS).option("maxFilesPerTrigger", files)
    source = reader.parquet(f"{folder}/{name}") if parts else reader.option("pathGlobFilter", name).parquet(folder)
    return source.withColumn("ts", F.col("ts").cast("timestamp"))


def windowed_counts(events: DataFrame, window: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Events and mean value of each window and type."""
    return events.withWatermark("ts", late).groupBy(F.window("ts", window), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total"))


def sessions(events: DataFrame, by: str, gap: str = "2 hours", late: str = "10 minutes", key: str = "event_id") -> DataFrame:
    """Sessions of a key: rows no further apart than the gap, each row counted once however often it arrives, closed once the watermark has passed.

    A row that comes again within the watermark's delay is dropped; so are rows behind the watermark, which ``late_rows`` counts. A session is kept
    as start, end and sums, and sessions of one task are merged before the shuffle, so a hot key sends its sessions, not its rows.
    """
    once = events.withWatermark("ts", late).dropDuplicatesWithinWatermark([key])
    made = once.groupBy(F.session_window("ts", gap).alias("s"), by).agg(F.count("*").alias("n"), F.sum("value").alias("total"))
    return made.select(by, F.col("s.start").alias("started"), F.col("s.end").alias("ended"), "n", "total")


def late_rows(query: StreamingQuery) -> int:
    """Rows that came behind the watermark, as the deduplication counted them in the batches that the query remembers."""
    return sum(s.numRowsDroppedByWatermark for p in query.recentProgress for s in p.stateOperators if "dedupe" in s.operatorName)


def followed(first: DataFrame, then: DataFrame, by: str, within: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Pairs of a row of one stream and a row of another with the same key that follows it within a time; state is what the time and the delay leave open.

    Both take columns (key, ts, event_id).
    """
    a = first.withWatermark("ts", late).select(F.col(by).alias("key"), F.col("ts").alias("first_ts"), F.col("event_id").alias("first_id"))
    b = then.withWatermark("ts", late).select(F.col(by).alias("key_"), F.col("ts").alias("then_ts"), F.col("event_id").alias("then_id"))
    return a.join(b, F.expr(f"key = key_ AND then_ts >= first_ts AND then_ts <= first_ts + interval {within}")).select("key", "first_id", "then_id")


def threshold_events(events: DataFrame, limit: float) -> DataFrame:
    """Events above a limit, as they come."""
    return events.filter(F.col("value") > limit).select("event_id", "ts", "user_id", "event_type", "value")


def cooled_down(events: DataFrame, seconds: int = 300) -> DataFrame:
    """Alerts that are sent, none within the cooldown after the last one sent of its type; state is one time a key."""

    def task(key: tuple[str], batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        last = state.get[0] if state.exists else None
        rows = pd.concat(list(batches)).sort_values(["at", "event_id"])
        sent = []
        for at, event in zip(rows["at"], rows["event_id"], strict=True):
            if last is None or at - last >= seconds * 1_000_000:
                last = int(at)
                sent.append((key[0], int(event)))
        if last is not None:
            state.update((last,))
        yield pd.DataFrame(sent, columns=["event_type", "event_id"])

    keyed = events.select("event_type", "event_id", F.unix_micros("ts").alias("at")).groupBy("event_type")
    return keyed.applyInPandasWithState(task, "event_type string, event_id long", "last long", "append", GroupStateTimeout.NoTimeout)


def arrivals(events: DataFrame, folder: str, slices: int = 4):
    """Append a table's rows to a folder in so many slices of their time, one at each step of the iteration."""
    ends = events.agg(F.min(F.unix_micros(F.col("ts").cast("timestamp"))).alias("a"), F.max(F.unix_micros(F.col("ts").cast("timestamp"))).alias("b")).first()
    wide = ((ends["b"] or 0) - (ends["a"] or 0)) // slices + 1
    at = F.floor((F.unix_micros(F.col("ts").cast("timestamp")) - F.lit(ends["a"])) / wide)
    for i in range(slices):
        events.filter(at == i).write.mode("append").parquet(folder)
        yield i


def resumed(stream: DataFrame, out: str, done: str, mode: str = "append") -> StreamingQuery:
    """Run a stream over what has come since its last run, which ``done`` remembers; a batch is written by its number, so a repeat overwrites itself."""

    def sink(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{out}/batch={number}")

    query = stream.writeStream.outputMode(mode).option("checkpointLocation", done).foreachBatch(sink).trigger(availableNow=True).start()
    query.awaitTermination()
    return query


def session_contexts(turns: DataFrame, most: int = 5) -> DataFrame:
    """A stream of (conv_id long, turn long, role string, text string) to each message with the digest of the ``most`` messages of its session before it.

    The messages of a session are taken in the order of turn, role and text within what has arrived together; state is the last ``most`` of each session, so a
    session of any length costs no more. A message without a session, role or text is an error: it is passed on with that status and enters no context.
    """

    def task(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        held = list(state.get[0]) if state.exists else []
        rows = pd.concat(list(batches)).sort_values(["turn", "role", "text"], kind="stable")
        out = []
        for turn, role, text in zip(rows.turn, rows.role, rows.text, strict=True):
            if pd.isna(key[0]) or not role or not text:
                out.append((key[0], turn, role, "error", len(held), None))
                continue
            out.append((key[0], turn, role, "ok", len(held), hashlib.md5("".join(held).encode()).hexdigest()))
            held = [*held, f"{role}: {text}"][-most:]
        state.update((held,))
        yield pd.DataFrame(out, columns=["conv_id", "turn", "role", "status", "before", "context_md5"])

    keyed = turns.select("conv_id", "turn", "role", "text").groupBy("conv_id")
    return keyed.applyInPandasWithState(task, "conv_id long, turn long, role string, status string, before int, context_md5 string", "held array<string>", "append", GroupStateTimeout.NoTimeout)


def run_to_end(stream: DataFrame, folder: str, mode: str = "append") -> DataFrame:
    """Run a stream over all that is there and read what it wrote; each batch is written by its number, so a repeat overwrites itself."""
    out, done = f"{folder}/stream-{uuid.uuid4().hex}", f"{folder}/progress-{uuid.uuid4().hex}"
    schema = stream.schema

    def sink(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{out}/batch={number}" if mode == "append" else f"{out}/batch=0")

    query = stream.writeStream.outputMode(mode).option("checkpointLocation", done).foreachBatch(sink).trigger(availableNow=True).start()
    query.awaitTermination()
    return stream.sparkSession.read.schema(schema).parquet(out).drop("batch")
