"""Registered replays: the given tables as file streams, through the streaming operators into parts, read back as tables."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from caseloom.plans.governance import TERMINAL
from caseloom.sources.parts import Parts
from caseloom.sources.views import shared_folder, table
from caseloom.streaming import events as streaming


def _stream(spark, sf_dir: str, name: str) -> DataFrame:
    """A table's files as a stream; availableNow takes all that are there."""
    return spark.readStream.schema(table(spark, sf_dir, name).schema).option("recursiveFileLookup", "true").parquet(f"{sf_dir}/{name}.parquet")


def _run(out: DataFrame, mode: str, sink, checkpoint: str) -> None:
    """Drive a stream to its end, through foreachBatch."""
    q = out.writeStream.outputMode(mode).foreachBatch(sink).trigger(availableNow=True).option("checkpointLocation", checkpoint).start()
    try:
        q.awaitTermination()
    finally:
        q.stop()


def _replayed(out: DataFrame, mode: str) -> DataFrame:
    """All rows of a stream's batches, with the batch's number as _part."""
    folder = f"{shared_folder(out.sparkSession)}/stream-{uuid.uuid4().hex}"
    parts = Parts(out.sparkSession, f"{folder}/parts")
    _run(out, mode, streaming.kept_batches(parts, "rows"), f"{folder}/checkpoint")
    return parts.read("rows", out.schema)


class _Lost(RuntimeError):
    """What the replay of uploads lets one batch fail with."""


def st1_uploads(spark, sf_dir):
    """Documents as a stream of uploads to a manifest that knows those with labels. The batch fails once after its rows
    were computed, and is done again from the same checkpoint: each new upload is there once."""
    folder = f"{shared_folder(spark)}/stream-{uuid.uuid4().hex}"
    parts = Parts(spark, f"{folder}/parts")
    as_upload = lambda d: d.select(F.lit("t1").alias("tenant_id"), F.col("source").alias("case_id"), F.sha2(F.coalesce("text", F.lit("")), 256).alias("sha256"), F.col("doc_id").alias("upload_id"))
    known = table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels").select("doc_id").distinct(), "doc_id")
    streaming.append_new(parts)(as_upload(known), 0)
    append, failed = streaming.append_new(parts), []

    def sink(batch: DataFrame, batch_id: int) -> None:
        if not failed:
            failed.append(batch_id)
            try:
                parts.write(batch_id + 1, lambda: {"uploads": batch, "never": batch.select(F.raise_error(F.lit("lost midway")))})
            except Exception as e:
                raise _Lost("the first try of this batch") from e
        append(batch, batch_id + 1)

    for _ in range(2):
        try:
            _run(as_upload(_stream(spark, sf_dir, "documents")), "append", sink, f"{folder}/checkpoint")
        except Exception:
            if len(failed) != 1 or parts.numbers() != [0]:
                raise
    return parts.read("uploads", streaming.UPLOADS).filter("_part > 0").select("case_id", "sha256", "upload_id")


def _jobs(spark, sf_dir):
    return _stream(spark, sf_dir, "events").select(F.col("user_id").cast("long").alias("job_id"), "event_id", F.col("event_type").alias("status"), F.col("ts").cast("timestamp").alias("ts"))


def st2_states(spark, sf_dir):
    """Each job's last state, as jb4_state has it, and whether its state was dropped after its end."""
    with streaming.with_rocksdb(spark):
        rows = _replayed(streaming.job_states(_jobs(spark, sf_dir), TERMINAL, "click"), "update")
    last = rows.groupBy("job_id").agg(F.max_by(F.struct("status", "attempts", "last_sequence", "terminal", "ended"), F.struct("_part", "ended")).alias("s"))
    return last.select("job_id", "s.status", "s.attempts", "s.last_sequence", F.col("s.terminal").cast("string").alias("terminal"), F.col("s.ended").cast("string").alias("ended"))


def st3_rates(spark, sf_dir):
    """Requests of each user and kind in windows of a day, as the last update of each window says."""
    requests = _stream(spark, sf_dir, "events").select(F.col("ts").cast("timestamp").alias("ts"), "user_id", F.col("event_type").alias("bucket"))
    rows = _replayed(streaming.rate_counts(requests, 86_400), "update")
    return rows.groupBy("user_id", "bucket", F.unix_timestamp("window_start").alias("window_start")).agg(F.max_by("n", "_part").alias("n"))


def st4_stale(spark, sf_dir):
    """Jobs that were silent for a day's lease before the watermark, which ends a minute before the last event."""
    beats = _jobs(spark, sf_dir).select("job_id", "ts")
    return _replayed(streaming.stale_jobs(beats, 86_400, "1 minute"), "append").select("job_id", "last_seen")


QUERIES = {f.__name__: f for f in (st1_uploads, st2_states, st3_rates, st4_stale)}

SQL = {
    "st1_uploads": "WITH up AS (SELECT source AS case_id, doc_id, sha256(coalesce(text, '')) AS sha256 FROM documents) SELECT case_id, sha256, min(doc_id) AS upload_id FROM up WHERE (case_id, sha256) NOT IN (SELECT (case_id, sha256) FROM up WHERE doc_id IN (SELECT doc_id FROM labels)) GROUP BY ALL",
    "st2_states": """
WITH j AS (SELECT user_id AS job_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS sequence, event_type, ts FROM events)
SELECT job_id, arg_max(event_type, sequence) AS status, count(*) FILTER (WHERE event_type = 'click') AS attempts, max(sequence) AS last_sequence,
       CASE WHEN arg_max(event_type, sequence) IN ('purchase', 'error') THEN 'true' ELSE 'false' END AS terminal,
       CASE WHEN arg_max(event_type, sequence) IN ('purchase', 'error') AND (epoch_us(max(ts)) // 1000) + 86400000 <= (SELECT (epoch_us(max(ts)) // 1000) - 600000 FROM events) THEN 'true' ELSE 'false' END AS ended
FROM j GROUP BY job_id""",
    "st3_rates": "SELECT user_id, event_type AS bucket, CAST(floor(floor(epoch(ts)) / 86400) * 86400 AS BIGINT) AS window_start, count(*) AS n FROM events GROUP BY ALL",
    "st4_stale": "SELECT user_id AS job_id, (epoch_us(max(ts)) // 1000) AS last_seen FROM events GROUP BY user_id HAVING (epoch_us(max(ts)) // 1000) + 86400000 <= (SELECT (epoch_us(max(ts)) // 1000) - 60000 FROM events)",
}
