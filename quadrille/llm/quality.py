"""A regularised quadratic discriminant that tells apart two classes of texts.

A text is described by transformed statistics (logarithms and log-odds of
counts). Each class gets a mean and a covariance, shrunk towards the diagonal of
the pooled covariance; the score is the logistic of an affine function of the
difference of the two Gaussian log-densities, whose Mahalanobis terms come from
Cholesky factors kept with the model. The shrinkage and the affine calibration
are chosen by cross-validation over folds of the training rows.

Fitting collects at most about `max_fit_rows` labelled rows of statistics, by a
hash of the id; the statistics themselves are computed for every text.

Defined results: null and empty texts have the statistics of a text without
words and are scored like any other; labels other than 0 and 1 are left out; of
several labels for one id the largest counts; if only one class is labelled, all
scores are 0.5; other columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from quadrille.llm.kernel import NOT_SPACE, buffers, rolling, slices, span_hash, spans

MAX_FIT_ROWS = 20_000
SHRINKAGES = (0.02, 0.05, 0.1, 0.2, 0.4)
FOLDS = 4

# Classes of bytes: other, lower, upper, digit, full stop, mark, symbol, blank, line end, non-ASCII.
_CLASS = np.zeros(256, np.int64)
for _k, _bytes in enumerate((b"abcdefghijklmnopqrstuvwxyz", b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"0123456789", b".", b",;:!?'\"()-", b"#$%&*+/<=>@[\\]^_`{|}~", b" \t", b"\n\r", range(0x80, 0x100)), 1):
    _CLASS[list(_bytes)] = _k
_N = 10
STATISTICS = 19


def _odds(part: np.ndarray, whole: np.ndarray) -> np.ndarray:
    return np.log((part + 0.5) / (np.maximum(whole - part, 0) + 0.5))


def _distinct(keys: np.ndarray, rows: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """For each row: its distinct keys, and the count of its most frequent one."""
    order = np.lexsort((keys, rows)) if len(rows) and (rows[1:] < rows[:-1]).any() else np.argsort(keys, kind="stable")
    order = order[np.argsort(rows[order], kind="stable")]
    k, r = keys[order], rows[order]
    new = np.ones(len(k), bool)
    new[1:] = (k[1:] != k[:-1]) | (r[1:] != r[:-1])
    at = np.flatnonzero(new)
    counts = np.diff(np.append(at, len(k)))
    most = np.zeros(n, np.int64)
    np.maximum.at(most, r[at], counts)
    return np.bincount(r[at], minlength=n), most


def statistics(data: np.ndarray, off: np.ndarray) -> np.ndarray:
    """One row of STATISTICS numbers for each text."""
    n = len(off) - 1
    size = np.diff(off)
    row_of = np.repeat(np.arange(n), size)
    kind = _CLASS[data]
    c = np.bincount(row_of * _N + kind, minlength=n * _N).reshape(n, _N)
    starts, ends, rows = spans(data, off, NOT_SPACE)
    words = np.bincount(rows, minlength=n)
    hashes = span_hash(data, starts, ends)
    same = lambda mask: np.bincount(rows[mask], minlength=n)
    length = ends - starts
    first, last = kind[starts], kind[ends - 1]
    again = np.zeros(len(rows), bool)
    again[1:] = (hashes[1:] == hashes[:-1]) & (rows[1:] == rows[:-1])
    letter = np.isin(kind, (1, 2, 9))
    lettered = np.concatenate([[0], np.cumsum(letter)])
    bare = lettered[ends] == lettered[starts]
    three, whole = rolling(hashes, rows, 3)
    r3 = rows[: len(three)][whole]
    threes = np.bincount(r3, minlength=n)
    distinct, most = _distinct(hashes, rows, n)
    distinct3, _ = _distinct(three[whole], r3, n)
    letters = c[:, 1] + c[:, 2] + c[:, 9]
    body = size - c[:, 7] - c[:, 8]
    return np.column_stack([
        np.log1p(words), np.log((body + 1) / (words + 1)), np.log1p(c[:, 8]) - np.log1p(words),
        _odds(c[:, 2], letters), _odds(c[:, 3], body), _odds(c[:, 4], body), _odds(c[:, 5], body), _odds(c[:, 6], body), _odds(c[:, 0], body), _odds(c[:, 9], body),
        _odds(distinct, words), _odds(most, words), _odds(distinct3, threes), _odds(same(again), words),
        _odds(same(last == 6), words), _odds(same(last == 5), words), _odds(same(first == 2), words), _odds(same(length <= 2), words), _odds(same(bare), words),
    ])


@dataclass
class Model:
    """Scaling, then for each class the mean, the Cholesky factor and its log-determinant, and the calibration."""

    centre: np.ndarray
    scale: np.ndarray
    means: list[np.ndarray]
    factors: list[np.ndarray]
    slope: float
    shift: float

    def margin(self, x: np.ndarray) -> np.ndarray:
        """Log-density of class 1 minus that of class 0."""
        z = (x - self.centre) / self.scale
        out = []
        for mean, factor in zip(self.means, self.factors, strict=True):
            y = np.linalg.solve(factor, (z - mean).T)
            out.append(-0.5 * (y * y).sum(0) - np.log(np.diag(factor)).sum())
        return out[1] - out[0]

    def score(self, x: np.ndarray) -> np.ndarray:
        if not len(x) or not self.means:
            return np.full(len(x), 0.5)
        return 1 / (1 + np.exp(-np.clip(self.slope * self.margin(x) + self.shift, -40, 40)))


def _gaussians(x: np.ndarray, y: np.ndarray, shrinkage: float) -> Model:
    centre, scale = x.mean(0), np.maximum(x.std(0), 1e-6)
    z = (x - centre) / scale
    pooled = sum(np.cov(z[y == k].T, bias=True) * (y == k).mean() for k in (0, 1))
    target = np.diag(np.maximum(np.diag(pooled), 1e-3))
    means = [z[y == k].mean(0) for k in (0, 1)]
    factors = [np.linalg.cholesky((1 - shrinkage) * np.cov(z[y == k].T, bias=True) + shrinkage * target) for k in (0, 1)]
    return Model(centre, scale, means, factors, 1.0, 0.0)


def _logistic(m: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Slope and shift of the calibration, by Newton's method with a weak prior; margins are tamed first by the caller."""
    a, b = 1.0 / max(1.0, np.abs(m).std()), 0.0
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(a * m + b, -40, 40)))
        w = p * (1 - p) + 1e-9
        g = np.array([((p - y) * m).sum() + 1e-3 * a, (p - y).sum() + 1e-3 * b])
        h = np.array([[(w * m * m).sum() + 1e-3, (w * m).sum()], [(w * m).sum(), w.sum() + 1e-3]])
        step = np.linalg.solve(h, g)
        a, b = a - step[0], b - step[1]
        if np.abs(step).max() < 1e-8:
            break
    return max(a, 1e-6), b


def fit(x: np.ndarray, y: np.ndarray, folds: np.ndarray) -> Model:
    """The model with the shrinkage of the lowest cross-validated loss, calibrated on the held-out margins."""
    if min((y == 0).sum(), (y == 1).sum()) < 2:
        return Model(np.zeros(x.shape[1]), np.ones(x.shape[1]), [], [], 1.0, 0.0)
    best = None
    for shrinkage in SHRINKAGES:
        out = np.zeros(len(y))
        for k in np.unique(folds):
            rest, here = folds != k, folds == k
            if min((y[rest] == 0).sum(), (y[rest] == 1).sum()) < 2:
                rest = np.ones(len(y), bool)
            out[here] = _gaussians(x[rest], y[rest], shrinkage).margin(x[here])
        slope, shift = _logistic(out, y)
        p = 1 / (1 + np.exp(-np.clip(slope * out + shift, -40, 40)))
        loss = -np.log(np.where(y == 1, p, 1 - p) + 1e-12).mean()
        if best is None or loss < best[0]:
            best = (loss, shrinkage, slope, shift)
    model = _gaussians(x, y, best[1])
    model.slope, model.shift = best[2], best[3]
    return model


def describe(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and the statistics of every text."""
    kind = to_arrow_type(docs.schema[id_col].dataType)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            x = statistics(*buffers(batch.column(1)))
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1) * STATISTICS, pa.int32()), pa.array(x.ravel()))
            yield pa.RecordBatch.from_arrays([batch.column(0).cast(kind), lists], ["doc_id", "x"])

    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(run, f"doc_id {docs.schema[id_col].dataType.simpleString()}, x array<double>")


def learn(described: DataFrame, labels: DataFrame, max_fit_rows: int = MAX_FIT_ROWS, label_col: str = "quality") -> Model:
    """Fit on the described rows that have a label; the caller leaves out those to be held out."""
    marks = labels.where(F.col(label_col).isin(0, 1)).groupBy("doc_id").agg(F.max(label_col).alias("y"))
    every = max(1, -(-marks.count() // max_fit_rows))
    marks = marks.where(F.pmod(F.xxhash64("doc_id"), F.lit(every)) == 0)
    rows = described.join(marks, "doc_id").select("x", "y", F.pmod(F.xxhash64("doc_id", F.lit("fold")), F.lit(FOLDS)).alias("fold")).collect()
    if not rows:
        return fit(np.zeros((0, STATISTICS)), np.zeros(0), np.zeros(0))
    return fit(np.array([r[0] for r in rows]), np.array([r[1] for r in rows]), np.array([r[2] for r in rows]))


def score(described: DataFrame, model: Model) -> DataFrame:
    """doc_id and the score of every described row."""
    shared = described.sparkSession.sparkContext.broadcast(model)
    kind = to_arrow_type(described.schema["doc_id"].dataType)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = batch.column(1).flatten().to_numpy(zero_copy_only=False).reshape(-1, STATISTICS)
            yield pa.RecordBatch.from_arrays([batch.column(0).cast(kind), pa.array(shared.value.score(x))], ["doc_id", "score"])

    return described.select("doc_id", "x").mapInArrow(run, f"doc_id {described.schema['doc_id'].dataType.simpleString()}, score double")
