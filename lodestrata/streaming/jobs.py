"""Structured Streaming: windows over events, the incident machine, the rate limiter, the feedback tick."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..operators.incidents import allowed


def event_stream(spark: SparkSession, d: str, name: str = "events") -> DataFrame:
    one = f"{d}/{name}.parquet"
    rows = spark.readStream.schema(spark.read.parquet(one).schema).option("pathGlobFilter", f"{name}.parquet").parquet(d)
    return rows.withColumn("ts", F.col("ts").cast("timestamp")) if "ts" in rows.columns else rows


def windowed(events: DataFrame, width: str = "1 hour", slide: str | None = None, late: str = "2 days") -> DataFrame:
    return events.withWatermark("ts", late).groupBy(F.window("ts", width, slide or width), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total"))


def sessions(events: DataFrame, gap: str = "30 minutes", late: str = "2 days") -> DataFrame:
    return events.withWatermark("ts", late).groupBy(F.session_window("ts", gap), "user_id").agg(F.count("*").alias("n"))


def accept(state: str | None, rows: list[tuple]) -> tuple[str | None, list[tuple]]:
    """Runs (ts, event_id, new state) in order: illegal attempts are refused and change nothing."""
    out = []
    for _, event_id, new in sorted(rows):
        ok = allowed(state, new)
        state = new if ok else state
        out.append((event_id, new, ok))
    return state, out


def _keyed(rows: DataFrame, key: str, start: Callable, step: Callable, schema: str) -> DataFrame:
    """Runs step(state, at, event_id, ...) -> (state, out) over the rows of each key in order of at and event_id.

    Rows stream through, sorted by Spark, so only one state is held however many rows a key has. A key is worked on by one
    task at a time, as its order demands.
    """
    rest = [c for c in rows.columns if c not in (key, "at", "event_id")]
    ordered = rows.select(key, "at", "event_id", *rest).repartition(key).sortWithinPartitions(key, "at", "event_id")
    names = [x.split()[0] for x in schema.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, state = (), None
        for batch in batches:
            out = []
            for k, *row in zip(*(c.to_pylist() for c in batch.columns)):
                if (k,) != now:
                    now, state = (k,), start()
                state, got = step(state, *row)
                out.append((k, *got))
            yield pa.RecordBatch.from_pylist([dict(zip(names, x)) for x in out], pa.schema([(n, {"long": pa.int64(), "string": pa.string(), "boolean": pa.bool_()}[x.split()[1]]) for n, x in zip(names, schema.split(", "))]))

    return ordered.mapInArrow(run, schema)


def accepted(rows: DataFrame) -> DataFrame:
    """(session_id, event_id, state, accepted) of rows(session_id, at, event_id, state), in batch."""

    def step(state, at, event_id, new):
        ok = allowed(state, new)
        return new if ok else state, (event_id, new, ok)

    return _keyed(rows, "session_id", lambda: None, step, "session_id long, event_id long, state string, accepted boolean")


def limited(rows: DataFrame, limit: int, seconds: int, key: str = "user_id") -> DataFrame:
    """(key, event_id, passed) of rows(key, at, event_id), in batch; the state is at most `limit` times."""

    def step(recent, at, event_id):
        recent, [got] = limit_rate(recent, [(at, event_id)], limit, seconds)
        return recent, got

    return _keyed(rows, key, list, step, f"{key} long, event_id long, passed boolean")


def incident_machine(events: DataFrame, idle: str = "30 days") -> DataFrame:
    """(session_id, event_id, state, accepted), the state kept across micro-batches.

    A session that is silent for `idle` of event time loses its state; events later than that are dropped.
    """
    span = int(pd.Timedelta(idle).total_seconds() * 1000)

    def run(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        rows = [r for f in frames for r in zip(f["ts"], f["event_id"], f["state"])]
        now, out = accept(state.get[0] if state.exists else None, rows)
        if now is not None:
            state.update((now,))
            state.setTimeoutTimestamp(max(int(r[0].timestamp() * 1000) for r in rows) + span)
        yield pd.DataFrame([(key[0], *x) for x in out], columns=["session_id", "event_id", "state", "accepted"])

    return events.withWatermark("ts", idle).groupBy("session_id").applyInPandasWithState(run, "session_id long, event_id long, state string, accepted boolean", "state string", "append", GroupStateTimeout.EventTimeTimeout)


def limit_rate(recent: list[int], rows: list[tuple[int, int]], limit: int, seconds: int) -> tuple[list[int], list[tuple[int, bool]]]:
    """rows (microseconds, event_id): a call passes if fewer than limit calls passed in the seconds before, both edges in; refused calls aren't recorded."""
    out = []
    for at, event_id in sorted(rows):
        recent = [x for x in recent if x >= at - seconds * 1_000_000]
        ok = len(recent) < limit
        recent += [at] if ok else []
        out.append((event_id, ok))
    return recent, out


#: Calls a minute of the three classes of requests; fixed values.
RATES = {"index": 5, "mutate": 20, "default": 100}


def rate_limiter(events: DataFrame, limit: int, seconds: int = 60, key: str = "user_id", late: str = "2 days") -> DataFrame:
    """(key, event_id, passed); the state of a key is at most `limit` times and goes once the watermark has passed them."""

    late_ms = int(pd.Timedelta(late).total_seconds() * 1000)

    def run(k: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        rows = [r for f in frames for r in zip(f["at"], f["event_id"])]
        recent, out = limit_rate(list(state.get[0]) if state.exists else [], rows, limit, seconds)
        state.update((recent,))
        state.setTimeoutTimestamp(max(r[0] for r in rows) // 1000 + seconds * 1000 + late_ms)
        yield pd.DataFrame([(k[0], *x) for x in out], columns=["key", "event_id", "passed"])

    rows = events.withWatermark("ts", late).select(F.col(key).alias("key"), F.unix_micros("ts").alias("at"), "event_id", "ts")
    return rows.groupBy("key").applyInPandasWithState(run, "key long, event_id long, passed boolean", "recent array<long>", "append", GroupStateTimeout.EventTimeTimeout)


def online_metrics(events: DataFrame, late: str = "10 minutes") -> DataFrame:
    """Counts, mean and errors a minute, as a stream."""
    w = events.withWatermark("ts", late).groupBy(F.window("ts", "1 minute"))
    return w.agg(F.count("*").alias("n"), F.avg("value").alias("mean"), F.count_if(F.col("event_type") == "error").alias("errors"))


def resolutions(events: DataFrame, effects: Callable[[DataFrame, int], None], checkpoint: str):
    """Hands the sessions that ended in a micro-batch to effects: (session_id, state) and the batch's number."""
    ended = events.where(F.col("state").isin("RESOLVED", "FAILED")).select("session_id", "state")
    return feedback_tick(ended, effects, checkpoint)


def stop(query) -> None:
    """Ends a running loop after the micro-batch that it is in."""
    query.processAllAvailable() if query.isActive else None
    query.stop()


def feedback_tick(feedback: DataFrame, handle: Callable[[DataFrame, int], None], checkpoint: str, every: str | None = None):
    """Hands each micro-batch and its number to handle, which should be idempotent by that number. Without `every` it takes what is there and ends."""
    trigger = {"processingTime": every} if every else {"availableNow": True}
    return feedback.writeStream.foreachBatch(handle).option("checkpointLocation", checkpoint).trigger(**trigger).start()
