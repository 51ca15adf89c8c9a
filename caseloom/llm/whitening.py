"""Whitening of embeddings by spectrum slicing.

Vectors are made integers; each distinct one counts once in the fit. Sums come first, then the covariance of what is
centred, both added up where the vectors lie; what reaches the driver is one matrix of the vectors' length. There,
LDL^T factors of the covariance less a shift tell by their signs how many eigenvalues lie above the shift (Sylvester's
law of inertia). Bisection by such counts slices the spectrum until an interval holds one leading eigenvalue alone;
Rayleigh quotient iteration then converges on it cubically, and two more counts, just below and just above, certify
that the value found is the one of its number. Eigenvalues too close to be told apart are taken from one interval, with
vectors kept orthogonal to those found before.

Cases: vectors that are null or hold null or non-finite entries take no part; so do those of another length than the
commonest (the shorter one of equals) and rows of an empty vector; a null id keeps its rows; repeated rows count once in
the fit, and each has its result; components without variance (an eigenvalue that rounding can't tell from 0) are left
out, so fewer than asked for may come, and none where all vectors are equal; an empty table gives an empty table. A
deviation beyond 64 bits is null. Entries beyond 64 bits are cut to the nearest that fits.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from caseloom.llm.common import saved

COMPONENTS = 4
_EPS = np.finfo(float).eps


def integers(vector: Column, scale: int = 256) -> Column:
    """floor(scale * x) of each entry; null where the vector takes no part."""
    bad = F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    limit = 2.0**63
    whole = lambda y: F.when(y >= limit, F.lit((1 << 63) - 1)).when(y <= -limit, F.lit(-(1 << 63))).otherwise(F.floor(y))
    return F.when(vector.isNotNull() & ~bad, F.transform(vector, lambda x: whole(x.cast("double") * scale)))


def factored(a: np.ndarray) -> tuple[np.ndarray, list[np.ndarray], np.ndarray]:
    """L, the diagonal's blocks of one or two rows, and the order of rows p, with a[p][:, p] = L D L^T (Bunch-Kaufman)."""
    a, n = a.copy(), len(a)
    low, order, blocks, k = np.eye(n), np.arange(n), [], 0
    alpha = (1 + 17**0.5) / 8

    def swap(i: int, j: int) -> None:
        if i != j:
            a[[i, j]] = a[[j, i]]
            a[:, [i, j]] = a[:, [j, i]]
            low[[i, j], :k] = low[[j, i], :k]
            order[[i, j]] = order[[j, i]]

    while k < n:
        size = 1
        if k < n - 1:
            below = np.abs(a[k + 1:, k])
            r = k + 1 + int(below.argmax())
            most = below[r - k - 1]
            if most > 0 and abs(a[k, k]) < alpha * most:
                row = np.abs(a[k:, r])
                row[r - k] = 0
                other = row.max()
                if abs(a[k, k]) * other < alpha * most * most:
                    if abs(a[r, r]) >= alpha * other:
                        swap(k, r)
                    else:
                        size = 2
                        swap(k + 1, r)
        d = a[k:k + size, k:k + size].copy()
        blocks.append(d)
        rest = slice(k + size, n)
        column = a[rest, k:k + size]
        if size == 2:
            m = column @ np.linalg.inv(d)
        else:
            m = column / d if d[0, 0] != 0 else np.zeros_like(column)
        low[rest, k:k + size] = m
        a[rest, rest] -= m @ column.T
        k += size
    return low, blocks, order


def above(a: np.ndarray, shift: float) -> int:
    """How many eigenvalues of a are greater than shift: those of D that are positive."""
    n = 0
    for d in factored(a - shift * np.eye(len(a)))[1]:
        if len(d) == 1:
            n += d[0, 0] > 0
        else:
            det = d[0, 0] * d[1, 1] - d[0, 1] * d[1, 0]
            n += 1 if det < 0 else 2 * (d[0, 0] + d[1, 1] > 0)
    return int(n)


def _solved(f: tuple[np.ndarray, list[np.ndarray], np.ndarray], b: np.ndarray, least: float) -> np.ndarray:
    """x with a x = b, from a's factors; diagonal entries below least count as least, since a may be singular."""
    low, blocks, order = f
    y = np.linalg.solve(low, b[order])
    at = 0
    for d in blocks:
        if len(d) == 1:
            y[at] /= d[0, 0] if abs(d[0, 0]) > least else least
        else:
            y[at:at + 2] = np.linalg.solve(d, y[at:at + 2])
        at += len(d)
    x = np.empty(len(b))
    x[order] = np.linalg.solve(low.T, y)
    return x


def leading(v: np.ndarray, k: int = COMPONENTS) -> tuple[np.ndarray, np.ndarray]:
    """The k greatest eigenvalues (those that aren't 0, falling) of a covariance, and their unit vectors as rows."""
    d = len(v)
    scale = float(np.abs(v).sum(axis=1).max(initial=0))  # no eigenvalue is greater
    if d == 0 or scale == 0 or not np.isfinite(scale):
        return np.zeros(0), np.zeros((0, d))
    a, noise = v / scale, 4 * d * _EPS
    counts = {noise: above(a, noise), 1 + noise: 0}
    k = min(k, counts[noise])
    values, vectors = [], np.zeros((0, d))
    for number in range(1, k + 1):
        # the interval (low, high] that holds the eigenvalue of this number
        while True:
            low = max(x for x, n in counts.items() if n >= number)
            high = min(x for x, n in counts.items() if n < number)
            alone = counts[low] == number and counts[high] == number - 1
            if high - low <= noise or alone and (found := _iterated(a, low, high, vectors, noise, alone)):
                break
            middle = (low + high) / 2
            counts[middle] = above(a, middle)
        if high - low <= noise:
            found = _iterated(a, low, high, vectors, noise, False)
        value, vector = found
        values.append(value)
        vectors = np.vstack([vectors, vector])
    return np.array(values) * scale, vectors


def _iterated(a: np.ndarray, low: float, high: float, before: np.ndarray, noise: float, certify: bool):
    """Rayleigh quotient iteration from the middle of (low, high], orthogonal to the vectors before: value and vector,
    or None if it leaves the interval or (certify) if counts around the value don't number it alone."""
    x = np.cos(np.arange(len(a)) * 1.7 + 0.3)
    shift = (low + high) / 2
    for step in range(60):
        x = x - before.T @ (before @ x)
        x = x / np.linalg.norm(x)
        y = _solved(factored(a - shift * np.eye(len(a))), x, _EPS * noise)
        y = y - before.T @ (before @ y)
        y = y / np.linalg.norm(y)
        quotient = float(y @ a @ y)
        rest = np.linalg.norm(a @ y - quotient * y)
        x = y
        if rest <= noise / 4 and step >= 2:
            break
        # a few inverse steps with the middle as shift first, so that the quotient starts within the interval
        shift = quotient if low < quotient <= high and step >= 1 else shift
    if not low - noise <= quotient <= high + noise:
        return None
    if certify and above(a, quotient - noise) - above(a, quotient + noise) != 1:
        return None
    return quotient, x / np.linalg.norm(x)


def _rows(column: pa.Array) -> np.ndarray:
    """Lists of equal length as a matrix."""
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(column), -1)


def _summed(fit: DataFrame, of, size: int) -> np.ndarray:
    """The sum over all vectors of what of(matrix) returns for a batch (size numbers): added up in each task, then by
    place, so that what comes to the driver has that size."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(size)
        for b in batches:
            if b.num_rows:
                total += of(_rows(b.column(0)))
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(size, dtype=np.int32)), pa.array(total)], names=["at", "v"])

    got = fit.select("x").mapInArrow(run, "at int, v double").groupBy("at").agg(F.sum("v").alias("v")).collect()
    out = np.zeros(size)
    for r in got:
        out[r.at] = r.v
    return out


class Whitening:
    """What a fit has found: n, the exact sums, the components (rows) with their eigenvalues, the trace."""

    def __init__(self, n: int, sums: list[int], values: np.ndarray, vectors: np.ndarray, trace: float, error: float):
        self.n, self.sums, self.values, self.vectors, self.trace, self.identity_error = n, sums, values, vectors, trace, error


def _centred(x: np.ndarray, mean: np.ndarray) -> np.ndarray:
    return x.astype(np.float64) - mean


def fit(vectors: DataFrame, k: int = COMPONENTS) -> Whitening:
    """The whitening of x (arrays of long of one length), each distinct one counted once."""
    own = saved(vectors.select("x").distinct(), "whitening-fit")
    dim = own.select(F.size("x")).first()
    if dim is None or dim[0] == 0:
        return Whitening(0, [], np.zeros(0), np.zeros((0, 0)), 0.0, 0.0)
    dim = dim[0]
    n = own.count()
    by_place = own.select(F.posexplode("x").alias("at", "v")).groupBy("at").agg(F.sum(F.col("v").cast("decimal(38,0)")).alias("v"))
    sums = [0] * dim
    for r in by_place.collect():  # one row a dimension
        sums[r.at] = int(r.v)
    mean = np.array([s / n for s in sums])
    cov = _summed(own, lambda x: (lambda c: (c.T @ c).reshape(-1))(_centred(x, mean)), dim * dim).reshape(dim, dim) / n
    cov = (cov + cov.T) / 2
    values, found = leading(cov, k)
    m = len(values)
    error = 0.0
    if m:
        scaled = found / np.sqrt(values)[:, None]
        # sums and products of the whitened vectors
        both = _summed(own, lambda x: (lambda w: np.concatenate([w.sum(axis=0), (w.T @ w).reshape(-1)]))(_centred(x, mean) @ scaled.T), m + m * m) / n
        error = float(np.abs(both[m:].reshape(m, m) - np.outer(both[:m], both[:m]) - np.eye(m)).max())
    return Whitening(n, sums, values, found, float(np.trace(cov)), error)


def deviations(x: np.ndarray, n: int, sums: list[int]) -> list[int | None]:
    """The exact sum over dimensions of (n * x - sum)^2 of each row; null beyond 64 bits."""
    most = max(1, int(np.abs(x.astype(np.float64)).max(initial=0)) + 1) * n + max(map(abs, sums))
    if most * most * max(1, x.shape[1]) < 1 << 62:
        y = x * n - np.array(sums, dtype=np.int64)
        return (y * y).sum(axis=1).tolist()
    exact = [sum((int(c) * n - s) ** 2 for c, s in zip(row, sums)) for row in x.tolist()]
    return [e if e < 1 << 63 else None for e in exact]


def whitened(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", scale: int = 256, k: int = COMPONENTS) -> DataFrame:
    """id_col, component, n, deviation, whitened, explained, identity_error for each vector that takes part."""
    base = vectors.select(F.col(id_col).cast("long").alias("id"), integers(F.col(vector_col), scale).alias("x")).filter("x is not null and size(x) > 0")
    common = base.groupBy(F.size("x").alias("dim")).count().orderBy(F.desc("count"), "dim").first()
    base = base.filter(F.size("x") == (common[0] if common else 0))
    w = fit(base, k)
    m = len(w.values)
    names = ["id", "component", "n", "deviation", "whitened", "explained", "identity_error"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        mean = np.array([s / w.n for s in w.sums])
        for b in batches:
            if b.num_rows == 0 or m == 0:
                continue
            x = _rows(b.column(1))
            out = (x.astype(np.float64) - mean) @ w.vectors.T / np.sqrt(w.values)
            deviation = pa.array(deviations(x, w.n, w.sums), pa.int64())
            each = pa.array(np.repeat(np.arange(b.num_rows), m))
            size = b.num_rows * m
            columns = [b.column(0).take(each), pa.array(np.tile(np.arange(1, m + 1, dtype=np.int32), b.num_rows)), pa.array(np.full(size, w.n)), deviation.take(each), pa.array(out.reshape(-1)), pa.array(np.tile(w.values / w.trace, b.num_rows)), pa.array(np.full(size, w.identity_error))]
            yield pa.RecordBatch.from_arrays(columns, names=names)

    return base.mapInArrow(run, "id long, component int, n long, deviation long, whitened double, explained double, identity_error double").withColumnRenamed("id", id_col)
