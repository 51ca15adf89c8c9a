"""An upload ledger: two monthly budgets, bytes and files, with reservations that are committed or given back."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

KEYS = ["tenant_id", "user_id", "period"]
SCHEMA = "tenant_id string, user_id string, period string, seq long, kind string, reservation_id string, size long, outcome string, bytes_used long, file_count long"


class Account:
    """One user's month: what is used, and the sizes of open reservations, of which there are at most as many as files
    may be. Uploads that don't fit both budgets are rejected and use nothing; a release gives back what a reservation
    that isn't committed took; what names no open reservation changes nothing."""

    def __init__(self, max_bytes: int, max_files: int):
        self.max_bytes, self.max_files, self.bytes, self.files = max_bytes, max_files, 0, 0
        self.open: dict[str | None, int] = {}

    def take(self, kind: str | None, reservation: str | None, size: int | None) -> str:
        if kind == "reserve":
            if reservation is None or reservation in self.open or size is None or not 0 <= size <= self.max_bytes or self.bytes + size > self.max_bytes or self.files + 1 > self.max_files:
                return "rejected"
            self.open[reservation] = size
            self.bytes, self.files = self.bytes + size, self.files + 1
            return "reserved"
        if kind not in ("commit", "release") or reservation not in self.open:
            return "ignored"
        size = self.open.pop(reservation)
        if kind == "commit":
            return "committed"
        self.bytes, self.files = max(0, self.bytes - size), max(0, self.files - 1)
        return "released"


def ledger(events: DataFrame, max_bytes: int, max_files: int) -> DataFrame:
    """Each event (tenant_id, user_id, period, seq, kind, reservation_id, size) with its outcome and what is used after it.

    Events of a user's month are taken in order of seq (then reservation, kind and size). They meet in one task, since
    each depends on those before, but come there sorted and pass one by one: an account is all that is held. Null keys
    are keys of their own; a repeated reservation that is still open is rejected.
    """
    columns = [*KEYS, "seq", "kind", "reservation_id", "size"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, account = object(), None
        for b in batches:
            out = []
            for *key, _, kind, reservation, size in zip(*(c.to_pylist() for c in b.columns)):
                if key != now:
                    now, account = key, Account(max_bytes, max_files)
                out.append((account.take(kind, reservation, size), account.bytes, account.files))
            made = list(zip(*out)) or [(), (), ()]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(made[0], pa.string()), pa.array(made[1], pa.int64()), pa.array(made[2], pa.int64())], names=[*columns, "outcome", "bytes_used", "file_count"])

    typed = [F.col(c).cast("long" if c in ("seq", "size") else "string").alias(c) for c in columns]
    dealt = events.select(*typed).repartition(*KEYS).sortWithinPartitions(*[F.asc_nulls_first(c) for c in [*KEYS, "seq", "reservation_id", "kind", "size"]])
    return dealt.mapInArrow(run, SCHEMA)
