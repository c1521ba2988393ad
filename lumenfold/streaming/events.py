"""Streams: the event log as a source, chained incremental stages, and a limiter that remembers only what it let through."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.types import StructType

#: Milliseconds of silence after which a client's state goes; a window is a minute, the rest allows for late calls.
IDLE = 600_000
#: How far a call may be behind the newest one.
LATE = "10 minutes"


def read_stream(spark: SparkSession, path: str, schema: StructType, pattern: str | None = None) -> DataFrame:
    """New Parquet files of a folder; ``pattern`` picks files by name."""
    reader = spark.readStream.schema(schema)
    return (reader.option("pathGlobFilter", pattern) if pattern else reader).parquet(path)


def run_available(stream: DataFrame, each: Callable[[DataFrame, int], None], checkpoint: str, seconds: float | None = None) -> None:
    """Handle all that has arrived since the checkpoint and stop; a second call handles only what is new. A run that takes more
    than ``seconds`` is stopped with an error."""
    query = stream.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    if seconds is None:
        query.awaitTermination()
    elif not query.awaitTermination(seconds):
        query.stop()
        raise TimeoutError(f"the stream has not ended after {seconds} seconds")


def unpublished(outbox: DataFrame) -> DataFrame:
    """Events in order that no consumer has marked."""
    return outbox.where("published_at IS NULL").orderBy("event_id")


def windowed_counts(events: DataFrame, every: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Events by window and type; NTZ timestamps become timestamps, as watermarks need them."""
    at = events.withColumn("ts", F.col("ts").cast("timestamp"))
    if at.isStreaming:
        at = at.withWatermark("ts", late)
    return at.groupBy(F.window("ts", every), "event_type").agg(F.count("*").alias("n")).select(F.col("window.start").alias("start"), "event_type", "n")


def sessions(events: DataFrame, gap: str = "30 minutes") -> DataFrame:
    """(user_id, start, n): runs of events with no longer pause than the gap."""
    at = events.withColumn("ts", F.col("ts").cast("timestamp"))
    return at.groupBy("user_id", F.session_window("ts", gap)).agg(F.count("*").alias("n")).select("user_id", F.col("session_window.start").alias("start"), "n")


def limited(calls: DataFrame, per_minute: int) -> DataFrame:
    """(bucket, client, call_id, allowed): at most ``per_minute`` allowed calls in any 60 seconds; a denied call does not count.

    Which calls count depends on the ones before, so each client's calls are taken in order. A client's rows are sorted by
    Spark and streamed through; what is held is the last allowed calls, never a client's history.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key, kept = None, []
        for b in batches:
            allowed = []
            for bucket, client, at in zip(b["bucket"], b["client"], b["seconds"], strict=True):
                if (bucket, client) != key:
                    key, kept = (bucket, client), []
                kept = [x for x in kept if x > at - 60]
                ok = len(kept) < per_minute
                if ok:
                    kept.append(at)
                allowed.append(ok)
            yield b[["bucket", "client", "call_id"]].assign(allowed=allowed)

    kinds = dict(calls.dtypes)
    rows = calls.select("bucket", "client", "call_id", F.col("at").cast("timestamp").cast("double").alias("seconds"))
    ordered = rows.repartition("bucket", "client").sortWithinPartitions("bucket", "client", "seconds", "call_id")
    return ordered.mapInPandas(run, f"bucket {kinds['bucket']}, client {kinds['client']}, call_id {kinds['call_id']}, allowed boolean")


def limited_stream(calls: DataFrame, per_minute: int, late: str = LATE) -> DataFrame:
    """The same over a stream of (bucket, client, call_id, at).

    A client's state is its last allowed times, ``per_minute`` at most, and a timer: it goes when the watermark has passed its last
    call by IDLE. Of a client's calls in one micro-batch ids and times are held, to be put in order. A call that comes after later
    ones of an earlier batch is judged by the times that are kept; one that is behind the newest call of all by more than ``late`` is
    behind the watermark and gets no row.
    """
    from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        kept, last = state.get if state.exists else ([], 0.0)
        kept = list(kept)
        rows = pd.concat([b[["call_id", "seconds"]] for b in batches]).sort_values(["seconds", "call_id"])
        allowed = []
        for at in rows["seconds"]:
            kept = [x for x in kept if x > at - 60]
            allowed.append(len(kept) < per_minute)
            if allowed[-1]:
                kept.append(at)
        last = max(last, *rows["seconds"])
        state.update((kept, last))
        state.setTimeoutTimestamp(max(int(last * 1000) + IDLE, state.getCurrentWatermarkMs() + 1))
        yield pd.DataFrame({"bucket": key[0], "client": key[1], "call_id": rows["call_id"].to_numpy(), "allowed": allowed})

    timed = calls.withColumn("at", F.col("at").cast("timestamp")).withWatermark("at", late)
    rows = timed.select("bucket", "client", "call_id", "at", F.col("at").cast("double").alias("seconds"))
    kinds = dict(rows.dtypes)
    return rows.groupBy("bucket", "client").applyInPandasWithState(step, f"bucket {kinds['bucket']}, client {kinds['client']}, call_id {kinds['call_id']}, allowed boolean", "kept array<double>, last double", "append", GroupStateTimeout.EventTimeTimeout)
