"""Streams of uploads, job events and requests. Watermarks are parameters."""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from caseloom.sources.parts import Parts

UPLOADS = "tenant_id string, case_id string, sha256 string, upload_id long"


def new_uploads(uploads: DataFrame, delay: str = "1 day") -> DataFrame:
    """Uploads whose bytes their case hasn't sent within the delay."""
    return uploads.withWatermark("ts", delay).dropDuplicatesWithinWatermark(["tenant_id", "case_id", "sha256"])


def append_new(parts: Parts):
    """For foreachBatch: append a batch's uploads (tenant_id, case_id, sha256, upload_id) that earlier parts lack, as the
    part of the batch's number, each once with its least upload. Exact over all history: a batch that broke off has left
    nothing and is done anew against the same earlier parts, and one that is there isn't written again."""
    keys = ["tenant_id", "case_id", "sha256"]

    def run(batch: DataFrame, batch_id: int) -> None:
        held = parts.read("uploads", UPLOADS).filter(F.col("_part") < batch_id).select(*keys)
        fresh = batch.groupBy(*keys).agg(F.min("upload_id").alias("upload_id")).join(held, keys, "left_anti")
        parts.write(batch_id, lambda: {"uploads": fresh})

    return run


def kept_batches(parts: Parts, name: str):
    """For foreachBatch: a stream's rows as parts by batch, each written once."""

    def run(batch: DataFrame, batch_id: int) -> None:
        parts.write(batch_id, lambda: {name: batch})

    return run


class _JobStates(StatefulProcessor):
    """One job's counts and last event. A timer is set when its status is terminal; it drops the state unless the job
    has moved on meanwhile."""

    def __init__(self, terminal: list[str], keep_ms: int):
        self.terminal, self.keep = terminal, keep_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("job", "events long, attempts long, ts long, event_id long, status string")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        events, attempts, *last = self.state.get() if self.state.exists() else (0, 0, None, None, None)
        for b in rows:
            b = b.sort_values(["at", "event_id"])
            events, attempts = events + len(b), attempts + int(b["retry"].sum())
            new = (int(b["at"].iloc[-1]), int(b["event_id"].iloc[-1]), b["status"].iloc[-1])
            if last[0] is None or new[:2] > (last[0], last[1]):
                last = list(new)
        self.state.update((events, attempts, *last))
        for t in list(self.handle.listTimers()):
            self.handle.deleteTimer(t)
        if last[2] in self.terminal:
            self.handle.registerTimer(max(last[0] // 1000 + self.keep, timerValues.getCurrentWatermarkInMs() + 1))
        yield self._row(key, events, attempts, last, False)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        events, attempts, *last = self.state.get()
        self.state.clear()
        yield self._row(key, events, attempts, last, True)

    def _row(self, key, events, attempts, last, ended) -> pd.DataFrame:
        return pd.DataFrame({"job_id": [key[0]], "status": [last[2]], "attempts": [attempts], "last_sequence": [events - 1], "terminal": [last[2] in self.terminal], "ended": [ended]})

    def close(self) -> None:
        pass


def job_states(events: DataFrame, terminal: list[str], retry: str, keep: str = "1 day", delay: str = "10 minutes") -> DataFrame:
    """job_id, status, attempts (events of the kind retry), last_sequence, terminal, ended: a row for each job that a
    batch has touched, in order of (ts, event_id), and one more with ended when its state is dropped, `keep` after a
    terminal status by event time. A job that goes on after that begins anew. Events: job_id, event_id, status, ts.
    Needs the RocksDB state store (with_rocksdb)."""
    keep_ms = int(pd.Timedelta(keep).total_seconds() * 1000)
    rows = events.withWatermark("ts", delay).select("job_id", "event_id", "status", "ts", F.unix_micros("ts").alias("at"), (F.col("status") == retry).cast("int").alias("retry"))
    schema = "job_id long, status string, attempts long, last_sequence long, terminal boolean, ended boolean"
    return rows.groupBy("job_id").transformWithStateInPandas(_JobStates(terminal, keep_ms), schema, "update", "eventTime")


@contextmanager
def with_rocksdb(spark: SparkSession) -> Iterator[None]:
    """Streams that start inside keep their state in RocksDB."""
    name = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(name)
    spark.conf.set(name, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        yield
    finally:
        spark.conf.set(name, before)


def latest_states(events: DataFrame, delay: str = "10 minutes") -> DataFrame:
    """Each job's state by its highest sequence, repeated events dropped; for update mode."""
    once = events.withWatermark("ts", delay).dropDuplicatesWithinWatermark(["job_id", "sequence"])
    return once.groupBy("job_id").agg(F.max_by("status", "sequence").alias("status"), F.max("sequence").alias("sequence"))


def rate_counts(requests: DataFrame, seconds: int = 60, delay: str = "2 minutes") -> DataFrame:
    """Requests of each user and bucket in fixed windows, denied ones included."""
    w = requests.withWatermark("ts", delay).groupBy(F.window("ts", f"{seconds} seconds"), "user_id", "bucket").count()
    return w.select(F.col("window.start").alias("window_start"), "user_id", "bucket", F.col("count").alias("n"))


def stale_jobs(heartbeats: DataFrame, lease_seconds: int = 90, delay: str = "10 seconds") -> DataFrame:
    """job_id, last_seen: jobs that were silent for a lease, by event time."""

    def run(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            seen = state.get[0]
            state.remove()
            yield pd.DataFrame({"job_id": [key[0]], "last_seen": [seen]})
            return
        seen = max([b["seen"].max() for b in batches] + ([state.get[0]] if state.exists else []))
        state.update((int(seen),))
        state.setTimeoutTimestamp(max(int(seen) + lease_seconds * 1000, state.getCurrentWatermarkMs() + 1))

    beats = heartbeats.withWatermark("ts", delay).withColumn("seen", F.unix_millis("ts"))
    return beats.groupBy("job_id").applyInPandasWithState(run, "job_id long, last_seen long", "seen long", "append", GroupStateTimeout.EventTimeTimeout)
