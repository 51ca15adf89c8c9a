"""The upload ledger, ending job states and damaged files, by example and brute force."""

import random

import pytest
from pyspark.sql import functions as F

from caseloom.operators import quota
from caseloom.sources import files
from caseloom.streaming import events

EVENTS = "tenant_id string, user_id string, period string, seq long, kind string, reservation_id string, size long, outcome string"


def brute(rows, max_bytes, max_files):
    """Each event's (outcome, bytes, files), from the list of what happened before."""
    out = []
    for n, (t, u, p, seq, kind, rid, size, _) in enumerate(rows):
        before = [(r, o) for r, (o, _, _) in zip(rows[:n], out) if r[:3] == (t, u, p)]
        last = {}
        for r, o in before:
            if o in ("reserved", "committed", "released"):
                last[r[5]] = (o, r[6] if o == "reserved" else last[r[5]][1])
        held = [s for o, s in last.values() if o == "reserved"]
        used = sum(r[6] for r, o in before if o == "reserved") - sum(s for r, o in before if o == "released" for s in [_size(rows[:n], out, r)])
        files_ = sum(o == "reserved" for _, o in before) - sum(o == "released" for _, o in before)
        if kind == "reserve":
            ok = rid is not None and last.get(rid, ("",))[0] != "reserved" and size is not None and 0 <= size <= max_bytes and used + size <= max_bytes and files_ + 1 <= max_files
            out.append(("reserved", used + size, files_ + 1) if ok else ("rejected", used, files_))
        elif kind in ("commit", "release") and last.get(rid, ("",))[0] == "reserved":
            out.append(("committed", used, files_) if kind == "commit" else ("released", used - last[rid][1], files_ - 1))
        else:
            out.append(("ignored", used, files_))
        assert len(held) <= max_files
    return out


def _size(rows, out, released):
    """What the reservation had that this event released."""
    n = rows.index(released)
    return [r[6] for r, (o, _, _) in zip(rows[:n], out) if o == "reserved" and r[:3] == released[:3] and r[5] == released[5]][-1]


@pytest.mark.parametrize("batch", ["3", "10000"])
def test_ledger_against_brute_force(spark, batch):
    rnd = random.Random(4)
    rows = [(rnd.choice([None, "t"]), rnd.choice("ab"), "2024-01", i, rnd.choice(["reserve"] * 4 + ["commit", "release", "release", "other", None]), rnd.choice(["r1", "r2", "r3", "r4", "r5", None]), rnd.choice([None, -1, 0, 5, 30, 60, 101]), "clash") for i in range(400)]
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", batch)
    try:
        got = {r.seq: (r.outcome, r.bytes_used, r.file_count) for r in quota.ledger(spark.createDataFrame(rows, EVENTS).repartition(4), 100, 3).collect()}
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert [got[i] for i in range(400)] == brute(rows, 100, 3)
    assert quota.ledger(spark.createDataFrame([], EVENTS), 1, 1).count() == 0


def test_job_states_end(spark, tmp_path):
    """State goes a day after the end; a job that goes on keeps it; one that comes back begins anew."""
    schema = "job_id long, event_id long, status string, ts timestamp"
    day = 86_400

    def put(n, rows):
        spark.createDataFrame(rows, "job_id long, event_id long, status string, at long").select("job_id", "event_id", "status", F.timestamp_seconds("at").alias("ts")).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in/{n}")

    seen, sizes = [], []

    def run():
        with events.with_rocksdb(spark):
            stream = spark.readStream.schema(schema).option("recursiveFileLookup", "true").parquet(f"{tmp_path}/in")
            out = events.job_states(stream, ["done"], "retry")
            q = out.writeStream.outputMode("update").foreachBatch(lambda b, n: seen.append(b.collect())).trigger(availableNow=True).option("checkpointLocation", f"{tmp_path}/c").start()
            q.awaitTermination(120)
            assert q.exception() is None
            sizes.append(q.lastProgress["stateOperators"][0]["numRowsTotal"])

    def rows():
        out = sorted((r.job_id, r.status, r.attempts, r.last_sequence, r.ended) for b in seen for r in b)
        seen.clear()
        return out

    put(1, [(1, 2, "done", 100), (1, 1, "retry", 50), (2, 3, "open", 60), (3, 4, "done", 70), (3, 5, "open", 80)])
    run()
    assert rows() == [(1, "done", 1, 1, False), (2, "open", 0, 0, False), (3, "open", 0, 1, False)]
    put(2, [(2, 6, "retry", 3 * day)])
    run()
    assert rows() == [(1, "done", 1, 1, True), (2, "retry", 1, 1, False)]
    put(3, [(1, 7, "open", 3 * day + 1)])
    run()
    assert rows() == [(1, "open", 0, 0, False)]
    assert sizes[1] < sizes[0] + 1


def test_damaged_csv_and_mail(spark):
    long = "x" * 200_000
    texts = [(1, f"a,b\n{long},2"), (2, "a\0b,c\nd"), (3, None), (4, ""), (5, 'a,"open\nnever closed')]
    got = {r.i: r.c for r in spark.createDataFrame(texts, "i int, t string").select("i", files.csv_rows("t").alias("c")).collect()}
    assert got[1] == [["a", "b"], [long, "2"]] and got[3] is None and got[4] == [] and len(got[5]) == 1 and got[2][-1][0].startswith("d")
    mails = [b"Content-Type: text/plain; charset=nonsense\nSubject: one\n\nb\xc3\xa9", b"Content-Type: text/plain; charset=utf-8\nSubject: two\n\nplain", b"", None, b"Content-Type: application/x-odd; charset=none\n\nraw", b"Content-Transfer-Encoding: base64\nContent-Type: text/plain\n\n!!notbase64", b"Subject: =?nonsense?q?x?=\nDate: not a date\n\ntext"]
    got = [r.m for r in spark.createDataFrame([(i, m) for i, m in enumerate(mails)], "i int, c binary").orderBy("i").select(files.email_parts("c").alias("m")).collect()]
    assert got[0].body == "bé" and "Subject: one" in got[0].header and got[1].body.strip() == "plain" and got[6].body == "text"
    assert all(m.header.startswith("From: ") and m.attachments == 0 for m in got)
