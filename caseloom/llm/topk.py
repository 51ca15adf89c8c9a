"""Exact top-k by inner product with no-random-access aggregation over sorted lists.

Each component of the vectors is a list of the candidates sorted by that component, read from the top where the
query's component is positive and from the bottom where it is negative. Lists are read sequentially, a STEP of their
length at a time. What has been read bounds every candidate's score: a component not read yet lies between the list's
far end and the value where reading stands. As the reading depth is the same for all queries of a slice, the bounds of
their (query, candidate) pairs are matrix products over clipped vectors. Candidates whose upper bound is below a query's
k-th lower bound (of this block, or the k-th score of the blocks that the task has seen before) are outsiders and leave
the lists; reading stops where few others are left, whose final scores are resolved. Bounds are first taken one step
before the depth at which the slice before stopped, as they are of no use far above it.

Candidates are packed in blocks where they lie, as 16-bit integers where these suffice; queries are dealt to groups of
bounded size. Each block meets each group once; blocks are dealt to as many buckets as keep all tasks busy. A block
keeps k rows a query at most, and these are merged by (score desc, id).

Cases: vectors that are null, or hold null or non-finite components, and rows without an id take no part (nor do vectors
of another length than most of a block's: lengths are compared exactly, and only equal lengths meet); ties go to the
smaller id; repeated rows with equal id count as one candidate each except the query's own id, and as one query (its smallest
vector); empty tables give empty
tables; other columns are ignored. Scores are exact while their sums stay below 2**53.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Rows of a block of candidates, queries of a group and of a slice, and the steps that a list is read in.
BLOCK, GROUP, SLICE, STEPS = 4096, 4096, 128, 8


def _exact(n: float) -> type:
    return np.float32 if n < 2**24 else np.float64


def scan(q_ids: np.ndarray, q: np.ndarray, c_ids: np.ndarray, c: np.ndarray, k: int, bars: dict[int, int] | None = None) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """For each query, (ids, scores) of its k best candidates in this block (of those that reach its bar, if it has one),
    and how many were resolved at the end. bars: the k-th score so far of each query, raised here."""
    bars = {} if bars is None else bars
    kind = _exact(float(np.abs(q).max(initial=0)) * float(np.abs(c).max(initial=0)) * max(1, q.shape[1]))
    lists = np.sort(c, axis=0)  # the sorted lists' values
    out, first, wide, columns = [], STEPS // 2, c.astype(np.float64), c.astype(kind)
    for at in range(0, len(q), SLICE):
        ids, part = q_ids[at:at + SLICE], q[at:at + SLICE]
        held = np.array([bars.get(i, -np.inf) for i in ids.tolist()])
        alive, where, first = _read(part.astype(kind), ids[:, None] != c_ids[None, :], columns, lists, k, held, first)
        for i in range(len(part)):
            left = where[alive[i]]
            scores = wide[left] @ part[i].astype(np.float64)
            if len(left) > k:
                keep = scores >= np.partition(scores, len(left) - k)[len(left) - k]
                left, scores = left[keep], scores[keep]
            order = np.lexsort((c_ids[left], -scores))[:k]
            if len(order) == k:
                bars[int(ids[i])] = max(bars.get(int(ids[i]), scores[order[-1]]), scores[order[-1]])
            out.append((c_ids[left[order]], scores[order].astype(np.int64), int(alive[i].sum())))
    return out


def _read(q: np.ndarray, alive: np.ndarray, c: np.ndarray, lists: np.ndarray, k: int, held: np.ndarray, step: int) -> tuple[np.ndarray, np.ndarray, int]:
    """Which candidates are left for each query when reading stops, their rows, and the step to begin with next time."""
    n, where, began = len(c), np.arange(len(c)), step
    low, high = (lists[0], lists[-1]) if n else (None, None)
    up, down = np.maximum(q, 0), np.minimum(q, 0)
    while n > 4 * k and step < STEPS:
        depth = n * step // STEPS
        top, bottom = lists[n - 1 - depth], lists[depth]  # reading stands here from the top, and from the bottom
        read_top, read_bottom = c >= top, c <= bottom
        least = up @ np.where(read_top, c, low).T.astype(q.dtype) + down @ np.where(read_bottom, c, high).T.astype(q.dtype)
        least[~alive] = -np.inf
        bar = np.maximum(held, np.partition(least, len(c) - k, axis=1)[:, len(c) - k] if len(c) > k else -np.inf)
        most = up @ np.where(read_top, c, top).T.astype(q.dtype) + down @ np.where(read_bottom, c, bottom).T.astype(q.dtype)
        alive &= most >= bar[:, None]
        stays = alive.any(axis=0)
        if not stays.all():
            alive, c, where = alive[:, stays], c[stays], where[stays]
        if alive.sum() <= 4 * k * len(q):
            break
        step += 1
    return alive, where, max(1, step - 1) if step == began else min(step, STEPS - 1)


def quantised(vector: Column, scale: int = 64) -> Column:
    """floor(scale * x) of each component as doubles; null where the vector takes no part."""
    bad = vector.isNull() | F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return F.when(~bad, F.transform(vector, lambda x: F.floor(x.cast("double") * scale).cast("double")))


def _bytes(rows: list[np.ndarray], dim: int) -> bytes:
    """The rows as 16-bit integers, or as doubles where these don't suffice."""
    values = np.stack(rows) if dim else np.zeros((len(rows), 0))
    return values.astype(np.int16 if np.abs(values).max(initial=0) < 2**15 else np.float64).tobytes()


def _rows(raw: bytes, n: int, dim: int) -> np.ndarray:
    return np.frombuffer(raw, dtype=np.int16 if len(raw) == 2 * n * dim else np.float64).reshape(n, dim).astype(np.float64)


def _packed(rows: DataFrame, size: int) -> DataFrame:
    """Blocks of at most size rows of one vector length, made where the rows lie: dim, n, ids, values."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: dict[int, list] = {}

        def block(dim: int, part: list) -> pd.DataFrame:
            ids = np.array([x[0] for x in part], dtype=np.int64)
            return pd.DataFrame({"dim": [dim], "n": [len(part)], "ids": [ids.tobytes()], "values": [_bytes([x[1] for x in part], dim)]})

        for b in batches:
            for key, v in zip(b["_id"], b["_v"]):
                part = held.setdefault(len(v), [])
                part.append((key, np.asarray(v, dtype=np.float64)))
                if len(part) == size:
                    yield block(len(v), part)
                    held[len(v)] = []
        for dim, part in held.items():
            if part:
                yield block(dim, part)

    return rows.mapInPandas(run, "dim int, n int, ids binary, values binary")


def top_k(vectors: DataFrame, is_query: Column, k: int = 20, scale: int = 64, id_col: str = "vec_id", vector_col: str = "embedding", block: int = BLOCK, group: int = GROUP) -> DataFrame:
    """query_id, rank, id_col, score: for each query row, its k best other rows."""
    base = vectors.select(F.col(id_col).cast("long").alias("_id"), quantised(F.col(vector_col), scale).alias("_v"), is_query.alias("_q")).filter("_v is not null and _id is not null")
    asks = base.filter("_q").groupBy("_id").agg(F.min("_v").alias("_v"))
    n = asks.count()
    groups = max(1, -(-n // group))
    dealt = asks.select(F.pmod(F.xxhash64("_id"), F.lit(groups)).cast("int").alias("g"), "_id", "_v")
    queries = dealt.repartition(groups, "g").sortWithinPartitions("g")

    def by_group(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: dict[tuple[int, int], list] = {}

        def out(key: tuple[int, int]) -> pd.DataFrame:
            part = held.pop(key)
            return pd.DataFrame({"g": [key[0]], "dim": [key[1]], "q_ids": [np.array([x[0] for x in part], dtype=np.int64).tobytes()], "q_values": [_bytes([x[1] for x in part], key[1])]})

        for b in batches:
            for g, i, v in zip(b["g"], b["_id"], b["_v"]):
                for done in [x for x in held if x[0] != g]:
                    yield out(done)
                part = held.setdefault((g, len(v)), [])
                part.append((i, np.asarray(v, dtype=np.float64)))
                if len(part) == group:
                    yield out((g, len(v)))
        for key in list(held):
            yield out(key)

    asked = queries.mapInPandas(by_group, "g int, dim int, q_ids binary, q_values binary")
    buckets = max(1, int(vectors.sparkSession.conf.get("spark.sql.shuffle.partitions")) // groups)
    asked = asked.withColumn("b", F.explode(F.sequence(F.lit(0), F.lit(buckets - 1))))
    blocks = _packed(base.select("_id", "_v"), block).withColumn("b", F.pmod(F.xxhash64("ids"), F.lit(buckets)).cast("int"))
    blocks = blocks.withColumn("g", F.explode(F.sequence(F.lit(0), F.lit(groups - 1))))
    met = blocks.join(asked, ["g", "b", "dim"]).select("dim", "ids", "values", "q_ids", "q_values")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        bars: dict[int, int] = {}
        for b in batches:
            for dim, ids, values, q_ids, q_values in b.itertuples(index=False):
                a, z = np.frombuffer(q_ids, dtype=np.int64), np.frombuffer(ids, dtype=np.int64)
                if len(bars) > 200_000:
                    bars.clear()
                found = scan(a, _rows(q_values, len(a), dim), z, _rows(values, len(z), dim), k, bars)
                sizes = [len(f[0]) for f in found]
                yield pd.DataFrame({"query_id": np.repeat(a, sizes), id_col: np.concatenate([f[0] for f in found]), "score": np.concatenate([f[1] for f in found])})

    hits = met.mapInPandas(run, f"query_id long, `{id_col}` long, score long")
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), id_col)
    return hits.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k).select("query_id", "rank", id_col, "score")
