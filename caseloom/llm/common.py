"""Shared helpers: scratch tables in the cluster's shared folder and word hashing in numpy."""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from caseloom.sources.views import shared_folder, stored as saved  # noqa: F401


@contextmanager
def batches_of(spark: SparkSession, rows: int) -> Iterator[None]:
    """Arrow batches of at most so many rows for what runs inside: rows with whole texts or sets are large."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    spark.conf.set(key, str(min(rows, int(before)) if int(before) > 0 else rows))
    try:
        yield
    finally:
        spark.conf.set(key, before)


#: A key is hot from this many rows on (or from a 100,000th of all rows), so that fewer than 100,000 keys ever are.
HOT = 50_000


def hot_keys(rows: DataFrame, key: str) -> DataFrame | None:
    """key, _parts: the hot keys of rows (a stored table), fewer than 100,000, and over how many parts their rows are
    dealt; none where all rows together are too few for one."""
    if rows.count() <= HOT:
        return None
    counts = saved(rows.groupBy(key).agg(F.count("*").alias("_n")), "hot-counts")
    most = max(HOT, (counts.agg(F.sum("_n")).first()[0] or 0) // 100_000)
    return counts.filter(F.col("_n") > most).select(key, (F.floor(F.col("_n") / most) + 1).cast("int").alias("_parts"))


def salted_join(many: DataFrame, one: DataFrame, key: str, spread: str, hot: DataFrame | None, how: str = "inner") -> DataFrame:
    """many joined with one (unique by key), rows of hot keys dealt over their parts by the hash of the column spread."""
    if hot is None:
        return many.join(one, key, how)
    hot = F.broadcast(hot)
    dealt = many.join(hot, key, "left").withColumn("_part", F.coalesce(F.pmod(F.xxhash64(spread), F.col("_parts")), F.lit(0)).cast("int")).drop("_parts")
    copied = one.join(hot, key, "left").withColumn("_part", F.explode(F.sequence(F.lit(0), F.coalesce("_parts", F.lit(1)) - 1))).drop("_parts")
    return dealt.join(copied, [key, "_part"], how).drop("_part")


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every input bit moves about half of the output bits."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))
