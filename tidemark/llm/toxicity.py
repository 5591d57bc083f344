"""Toxicity: cumulative-link ordinal regression over sparse word features.

P(grade <= k) = sigmoid(theta_k - w.x): one weight vector, ordered thresholds. The output is the expected grade.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame

from .features import sample_features, training_rows, word_counts
from .kernels import blocks

BITS = 20
#: Bound on the labelled rows used for fitting.
SAMPLE = 12000
GRADES = 4
#: A word must be in so many sampled documents to have a weight.
LEAST_DOCS = 5


@dataclass
class Ordinal:
    buckets: np.ndarray  # those with a weight, sorted
    w: np.ndarray
    theta: np.ndarray  # ascending

    def expected(self, z: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Probability of each grade, and their expectation."""
        below = 1 / (1 + np.exp(-np.clip(self.theta[None, :] - z[:, None], -40, 40)))
        p = np.diff(np.concatenate([np.zeros((len(z), 1)), below, np.ones((len(z), 1))], 1), axis=1)
        return p, p @ np.arange(p.shape[1])


def grade_binary(y: np.ndarray, row: np.ndarray, word: np.ndarray, grades: int = GRADES) -> np.ndarray:
    """Severity grades from 0/1 labels: clean rows are 0; toxic ones 1 to grades - 1 by how many telling words they hold.

    A word is telling if its smoothed odds in toxic rows are at least 20 times those in clean rows. Equal counts get equal grades.
    """
    toxic = y[row] > 0
    size = int(word.max()) + 1 if len(word) else 1
    a, b = np.bincount(word[toxic], minlength=size), np.bincount(word[~toxic], minlength=size)
    ratio = ((a + 0.5) / (y.sum() + 1)) / ((b + 0.5) / (len(y) - y.sum() + 1))
    telling = (ratio >= 20) & (a >= LEAST_DOCS)
    hits = np.bincount(row, telling[word], len(y))
    out = np.zeros(len(y), np.int64)
    own = hits[y > 0]
    if len(own):
        cuts = np.quantile(own, np.arange(1, grades - 1) / (grades - 1))
        out[y > 0] = 1 + np.searchsorted(cuts, own, "left")
    return out


def fit(grade: np.ndarray, row: np.ndarray, word: np.ndarray, x: np.ndarray, grades: int = GRADES, l1: float = 2e-4, steps: int = 300, rate: float = 0.1) -> Ordinal:
    """Mean negative log likelihood plus an L1 penalty on the shared weights: Adam steps, each followed by soft thresholding.

    Thresholds stay ordered: they are the first one plus exponentials. No rows: all weights are 0.
    """
    docs = np.bincount(word, minlength=1) if len(word) else np.zeros(1)
    buckets = np.flatnonzero(docs >= LEAST_DOCS)
    n, k = len(grade), grades - 1
    counts = np.bincount(grade, minlength=grades) + 0.5
    share = np.cumsum(counts)[:k] / counts.sum()
    theta = np.log(share / (1 - share))
    if n == 0 or grade.max() == 0 or len(buckets) == 0:
        return Ordinal(buckets, np.zeros(len(buckets)), theta)
    at = np.searchsorted(buckets, word)
    at[at == len(buckets)] = 0
    ok = buckets[at] == word
    row, at, x = row[ok], at[ok], x[ok]
    par = np.concatenate([np.zeros(len(buckets)), [theta[0]], np.log(np.maximum(np.diff(theta), 1e-3))])
    m, s, d = np.zeros_like(par), np.zeros_like(par), len(buckets)
    sig = lambda t: 1 / (1 + np.exp(-np.clip(t, -40, 40)))
    for step in range(1, steps + 1):
        gaps = np.exp(par[d + 1 :])
        theta = par[d] + np.concatenate([[0], np.cumsum(gaps)])
        z = np.bincount(row, par[at] * x, n)
        upper = np.where(grade < k, sig(theta[np.minimum(grade, k - 1)] - z), 1.0)
        lower = np.where(grade > 0, sig(theta[np.maximum(grade - 1, 0)] - z), 0.0)
        p = np.maximum(upper - lower, 1e-9)
        du, dl = upper * (1 - upper) / p, lower * (1 - lower) / p
        dz = (du - dl) / n  # of the loss with respect to z
        gt = np.zeros(k)
        np.subtract.at(gt, grade[grade < k], du[grade < k] / n)
        np.add.at(gt, grade[grade > 0] - 1, dl[grade > 0] / n)
        tail = np.cumsum(gt[::-1])[::-1]
        g = np.concatenate([np.bincount(at, dz[row] * x, d), [tail[0]], tail[1:] * gaps])
        m, s = 0.9 * m + 0.1 * g, 0.99 * s + 0.01 * g * g
        scale = rate / (np.sqrt(s / (1 - 0.99**step)) + 1e-6)
        par -= scale * m / (1 - 0.9**step)
        par[:d] = np.sign(par[:d]) * np.maximum(np.abs(par[:d]) - np.minimum(scale[:d] * l1, 0.05), 0)
    gaps = np.exp(par[d + 1 :])
    keep = par[:d] != 0
    return Ordinal(buckets[keep], par[:d][keep], par[d] + np.concatenate([[0], np.cumsum(gaps)]))


def train(docs: DataFrame, labels: DataFrame, label: str = "toxic", grades: int = GRADES, sample: int = SAMPLE, binary: bool = True, allowed: Column | None = None) -> Ordinal:
    """Fit on a bounded sample of the rows that are `allowed`. `binary` labels are graded first; else the label column holds
    grades from 0. Rows that repeat a doc_id count once; null labels and ids don't count; without rows all weights are 0."""
    y, cut, word, tf, _ = sample_features(training_rows(docs, labels, label, sample, allowed), BITS)
    row = np.repeat(np.arange(len(y)), np.diff(cut))
    grade = grade_binary(y, row, word, grades) if binary else np.clip(y, 0, grades - 1).astype(np.int64)
    return fit(grade, row, word, 1 + np.log(tf), grades)


SCHEMA = "doc_id long, expected_severity double, severity int, p_toxic double, is_toxic boolean"


def score(docs: DataFrame, model: Ordinal) -> DataFrame:
    """Expected severity of every row, its likeliest grade and the probability of any toxicity; one pass, no shuffle.

    The broadcast model holds weights of the sampled vocabulary only. Null and empty texts are scored as having no words;
    repeated rows and rows with a null doc_id are scored each.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ordinal = shared.value
        weight = np.zeros(1 << BITS)
        weight[ordinal.buckets] = ordinal.w
        for batch in batches:
            for lo, hi, b, off in blocks(batch.column("text")):
                row, word, n = word_counts(b, off, BITS)
                p, expected = ordinal.expected(np.bincount(row, weight[word] * (1 + np.log(n)), hi - lo))
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(lo, hi - lo), pa.array(expected), pa.array(p.argmax(1).astype(np.int32)), pa.array(1 - p[:, 0]), pa.array(p[:, 0] <= 0.5)], names=["doc_id", "expected_severity", "severity", "p_toxic", "is_toxic"])

    return docs.select("doc_id", "text").mapInArrow(run, SCHEMA)
