"""Severity grades by cumulative-link (proportional odds) regression on sparse text features.

P(grade <= k) = sigmoid(theta_k - w.x): one weight vector serves all ordered thresholds. x holds the presence of a
text's words, of their prefixes of 3 to 6 letters, and of prefixes that at least 1, 2 or 4 in 100 of its distinct words
have: what a long text may hold by chance is telling in a short one. The model is fitted on a bounded sample of labelled
rows (the `most` smallest by hash of the id; every other step covers all rows): features that are commoner in graver rows,
by a likelihood ratio of `TELLING` or more, stay, and proximal AdaGrad fits their weights, its L1 step keeping them
sparse. The expected severity is the sum over k of P(grade > k).

Cases: null and empty texts have no features, and get the severity of an empty text; labels that are null are left
out; of texts that repeat a labelled id each counts, up to `most` in all; without labelled rows, or with one grade only, that grade (0 without any) is expected everywhere; repeated rows
are scored alike; empty tables give empty tables; other columns are ignored by `score`. Texts are read as a whole.
"""

from __future__ import annotations

import json
import string
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Labelled rows used to fit, at most; prefix lengths; shares (in 100 distinct words) that a prefix is told by.
MOST, PREFIXES, SHARES = 8_000, (3, 4, 5, 6), (1, 2, 4)
#: The log likelihood ratio (times 2) and the rows that a feature needs.
TELLING, ROWS = 25.0, 4
#: Documents whose P(grade > 0) reaches this are rejected.
LIMIT = 0.15
#: Characters that are taken off both ends of a token.
EDGE = string.punctuation + string.digits + "\u2018\u2019\u201c\u201d\u00ab\u00bb\u2013\u2014\u2026\u00bf\u00a1"


def words_of(text: str | None) -> set[str]:
    """A text's distinct lower-cased words, without punctuation and digits around them."""
    return {w for t in set((text or "").lower().split()) if (w := t.strip(EDGE))}


def features(words: set[str], of: int | None = None) -> set[str]:
    """Each word (with a mark at its end), its prefixes, and with its share each prefix that many words have; words may
    be some of a text's `of` distinct words, if they are all that begin with the same three letters."""
    prefixes = Counter(w[:n] for w in words for n in PREFIXES if len(w) >= n)
    of = len(words) if of is None else of
    return {w + "$" for w in words} | set(prefixes) | {f"{p}%{x}" for p, k in prefixes.items() for x in SHARES if 100 * k >= x * of}


def ratio(a: int, b: int, n1: int, n0: int) -> float:
    """Twice the log likelihood ratio of two shares, a of n1 and b of n0, against one share for both."""
    share = (a + b) / (n1 + n0)

    def part(k: int, n: int) -> float:
        return (k * np.log(k / n / share) if k else 0.0) + ((n - k) * np.log((n - k) / n / (1 - share)) if k < n else 0.0)

    return float(2 * (part(a, n1) + part(b, n0)))


@dataclass
class Model:
    weights: dict[str, float]
    thresholds: np.ndarray

    def above(self, scores: np.ndarray) -> np.ndarray:
        """P(grade > k) for each score and threshold."""
        return 1 / (1 + np.exp(-np.clip(scores[:, None] - self.thresholds[None, :], -30, 30)))


def loss(w: np.ndarray, first: float, gaps: np.ndarray, index: np.ndarray, owner: np.ndarray, grades: np.ndarray) -> tuple[float, np.ndarray, np.ndarray]:
    """The mean negative log likelihood and its gradients by the weights and by (first, gaps). Thresholds are first and
    first plus the running sums of exp(gaps); row owner[i] has the feature index[i]."""
    n, k = len(grades), len(gaps) + 2
    theta = np.concatenate([[first], first + np.cumsum(np.exp(gaps))])
    s = np.bincount(owner, weights=w[index], minlength=n)
    f = 1 / (1 + np.exp(-np.clip(theta[None, :] - s[:, None], -30, 30)))
    edge = np.concatenate([np.zeros((n, 1)), f, np.ones((n, 1))], axis=1)
    below, upto = edge[np.arange(n), grades], edge[np.arange(n), grades + 1]
    p = np.maximum(upto - below, 1e-12)
    g = np.bincount(index, weights=((1 - upto - below) / n)[owner], minlength=len(w))
    t = np.zeros(k + 1)
    np.add.at(t, grades + 1, -upto * (1 - upto) / p / n)
    np.add.at(t, grades, below * (1 - below) / p / n)
    t = t[1:k]
    return float(-np.log(p).mean()), g, np.concatenate([[t.sum()], np.cumsum(t[::-1])[::-1][1:] * np.exp(gaps)])


def fit_words(rows: list[set[str]], grades: np.ndarray, steps: int = 400, rate: float = 0.5, l1: float = 1e-4) -> Model:
    """Fit on sets of words and grades 0..K-1."""
    k = int(grades.max(initial=0)) + 1
    if len(rows) == 0 or len(np.unique(grades)) < 2:
        at = int(grades[0]) if len(rows) else 0
        return Model({}, np.array([-30.0] * at + [30.0], dtype=np.float64))
    cut = max(1, int(np.unique(grades)[1]))
    hits: tuple[Counter, Counter] = (Counter(), Counter())
    for r, g in zip(rows, grades.tolist()):
        hits[g >= cut].update(features(r))
    n0, n1 = int((grades < cut).sum()), int((grades >= cut).sum())

    def differs(f: str) -> bool:
        a, b = hits[0][f], hits[1][f]
        return a + b >= ROWS and b * n0 > a * n1 and ratio(b, a, n1, n0) >= TELLING

    names = sorted(f for f in set(hits[0]) | set(hits[1]) if differs(f))
    place = {f: i for i, f in enumerate(names)}
    lists = [sorted(place[f] for f in features(r) if f in place) for r in rows]
    index = np.array([i for x in lists for i in x], dtype=np.int64)
    owner = np.repeat(np.arange(len(rows)), [len(x) for x in lists])
    used = names
    w, seen = np.zeros(len(used)), np.full(len(used), 1e-8)
    share = np.array([(grades <= j).mean() for j in range(k - 1)]).clip(1e-3, 1 - 1e-3)
    first, gaps = np.log(share[0] / (1 - share[0])), np.full(k - 2, 0.0)
    seen_t = np.full(k - 1, 1e-8)
    for _ in range(steps):
        _, g, t = loss(w, first, gaps, index, owner, grades)
        seen += g * g
        lr = rate / np.sqrt(seen)
        w -= lr * g
        w = np.sign(w) * np.maximum(np.abs(w) - lr * l1, 0)
        seen_t += t * t
        step = rate / np.sqrt(seen_t) * t
        first, gaps = first - step[0], np.clip(gaps - step[1:], -5, 5)
    return Model({f: float(x) for f, x in zip(names, w) if x}, np.concatenate([[first], first + np.cumsum(np.exp(gaps))]))


def severity_grade(toxic: Column, quality: Column) -> Column:
    """0: not toxic; 1: toxic; 2: toxic and of low quality. Null where toxic is null."""
    return F.when(toxic == 0, 0).when(toxic == 1, F.when(quality == 0, 2).otherwise(1))


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", grade_col: str = "grade", most: int = MOST) -> Model:
    """Fit on at most `most` labelled rows; labels: id_col and grade_col."""
    picked = labels.select(F.col(id_col).alias("_id"), F.col(grade_col).cast("int").alias("_grade")).filter("_grade is not null and _id is not null")
    sample = picked.orderBy(F.xxhash64("_id"), "_id", "_grade").limit(most)  # bounded, so it may be sent everywhere
    joined = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text")).join(F.broadcast(sample), "_id")

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            words = [" ".join(sorted(words_of(t))) for t in b.column("_text").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("_id").cast(pa.string()), b.column("_grade"), pa.array(words, pa.string())], names=["id", "grade", "words"])

    def train(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got = sorted((i, g, f) for b in batches for i, g, f in zip(*(c.to_pylist() for c in b.columns)))
        m = fit_words([set(f.split()) for _, _, f in got], np.array([g for _, g, _ in got], dtype=np.int64))
        yield pa.RecordBatch.from_arrays([pa.array([json.dumps(m.weights)]), pa.array([m.thresholds.tolist()], pa.list_(pa.float64()))], names=["w", "t"])

    fed = joined.mapInArrow(rows, "id string, grade int, words string")
    fed = fed.orderBy(F.xxhash64("id"), "id", "grade", "words").limit(most)  # ids may repeat: what one task gets is bounded too
    got = fed.coalesce(1).mapInArrow(train, "w string, t array<double>").collect()
    if not got:
        return fit_words([], np.zeros(0, dtype=np.int64))
    return Model(json.loads(got[0]["w"]), np.array(got[0]["t"], dtype=np.float64))


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id_col, severity (expected grade), p_toxic (P(grade > 0)), grade (the most probable)."""
    picked = docs.select(F.col(id_col), F.col(text_col).alias("_text"))
    run = scorer(model, id_col)
    kind = picked.schema[0].dataType.simpleString()
    return picked.mapInArrow(run, f"`{id_col}` {kind}, severity double, p_toxic double, grade int")


def totals(texts: list[str | None], weights: dict[str, float]) -> np.ndarray:
    """w.x of each text."""
    starts = {start[:3] for f in weights for start in (f, f.rstrip("$"))}
    out = np.zeros(len(texts))
    for i, t in enumerate(texts):
        words = words_of(t)
        near = {w for w in words if w[:3] in starts}
        out[i] = sum(sorted(weights[f] for f in features(near, len(words)) if f in weights))
    return out


def scorer(model: Model, id_col: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            above = model.above(totals(b.column(1).to_pylist(), model.weights))
            each = -np.diff(np.concatenate([np.ones((len(above), 1)), above, np.zeros((len(above), 1))], axis=1), axis=1)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(above.sum(axis=1).round(6)), pa.array(above[:, 0].round(6)), pa.array(each.argmax(axis=1).astype(np.int32))], names=[id_col, "severity", "p_toxic", "grade"])

    return run


def kept(docs: DataFrame, model: Model, text_col: str = "text", limit: float = LIMIT) -> DataFrame:
    """The rows of docs, all columns as they are, whose P(grade > 0) is below the limit."""
    weights, thresholds = model.weights, model.thresholds

    @F.pandas_udf("double")
    def toxic(col: pd.Series) -> pd.Series:
        return pd.Series(Model(weights, thresholds).above(totals(list(col), weights))[:, 0])

    return docs.filter(toxic(F.col(text_col)) < limit)
