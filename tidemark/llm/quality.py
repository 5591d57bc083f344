"""Quality classifier: a factorisation machine over hashed words, binned structure statistics and length.

score = sigmoid(w0 + sum w_i x_i + 1/2 sum_f [(sum_i v_if x_i)^2 - sum_i v_if^2 x_i^2]), linear in the number of features.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .features import N_BINS, N_STATS, sample_features, stat_bins, statistics, training_rows, word_counts
from .kernels import SCAN_BYTES, blocks

BITS = 18
RANK = 8
#: Bound on the labelled rows used for fitting.
SAMPLE = 6000
THRESHOLD = 0.3
_STAT_WEIGHT = 1.0 / np.sqrt(N_STATS)


@dataclass
class Machine:
    w0: float
    w: np.ndarray
    v: np.ndarray

    def margin(self, start: np.ndarray, index: np.ndarray, x: np.ndarray) -> np.ndarray:
        """Scores of rows whose features are index[start[i]:start[i+1]]; every row has at least one."""
        v = self.v[index] * x[:, None]
        linear = np.add.reduceat(self.w[index] * x, start[:-1])
        total = np.add.reduceat(v, start[:-1])
        return self.w0 + linear + 0.5 * (total**2 - np.add.reduceat(v * v, start[:-1])).sum(1)


def assemble_rows(n: int, row: np.ndarray, word: np.ndarray, tf: np.ndarray, stats: np.ndarray, bits: int = BITS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, index and value of each row's features: words weighted 1 + ln(tf) with unit norm, then the statistics' bins. `row`
    ascends."""
    x = 1 + np.log(tf)
    norm = np.sqrt(np.bincount(row, x * x, n))
    start = np.concatenate([[0], np.cumsum(np.bincount(row, minlength=n) + N_STATS)])
    index, value = np.empty(start[-1], np.int32), np.full(start[-1], _STAT_WEIGHT)
    at = np.arange(len(row)) + row * N_STATS
    index[at], value[at] = word, x / np.maximum(norm, 1e-12)[row]
    index[start[1:, None] - N_STATS + np.arange(N_STATS)] = stat_bins(stats) + (1 << bits)
    return start, index, value


def assemble_sample(cut: np.ndarray, word: np.ndarray, tf: np.ndarray, stats: np.ndarray, bits: int = BITS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The same for a whole sample, whose row i has word[cut[i]:cut[i+1]], some rows at a time: beside the result little is held."""
    start = cut + N_STATS * np.arange(len(cut))
    index, value = np.empty(start[-1], np.int32), np.empty(start[-1])
    for lo in range(0, len(cut) - 1, 64):
        hi = min(lo + 64, len(cut) - 1)
        row, here, own = np.repeat(np.arange(hi - lo), np.diff(cut[lo : hi + 1])), slice(start[lo], start[hi]), slice(cut[lo], cut[hi])
        _, index[here], value[here] = assemble_rows(hi - lo, row, word[own], tf[own].astype(float), stats[lo:hi], bits)
    return start, index, value


def fit(y: np.ndarray, start: np.ndarray, index: np.ndarray, x: np.ndarray, size: int, rank: int = RANK, epochs: int = 12, least_steps: int = 800, rate: float = 0.05, decay: float = 1e-5, seed: int = 7) -> Machine:
    """Logistic loss, Adam on mini-batches, only the features that the sample holds. One class or no rows: a constant."""
    if len(y) == 0 or y.min() == y.max():
        p = (y.sum() + 1) / (len(y) + 2)
        return Machine(float(np.log(p / (1 - p))), np.zeros(size, np.float32), np.zeros((size, rank), np.float32))
    seen = np.zeros(size, bool)
    seen[index] = True
    used, local = np.flatnonzero(seen), np.cumsum(seen) - 1
    rng = np.random.default_rng(seed)
    theta = np.zeros((len(used), rank + 1))
    theta[:, 1:] = rng.normal(0, 0.05, (len(used), rank))
    m, s, w0 = np.zeros_like(theta), np.zeros_like(theta), float(np.log((y.mean() + 1e-3) / (1 - y.mean() + 1e-3)))
    step, batches = 0, max(1, len(y) // 64)
    epochs = max(epochs, -(-least_steps // batches))
    for epoch in range(epochs):
        order = rng.permutation(len(y))
        for batch in np.array_split(order, batches):
            lengths = start[batch + 1] - start[batch]
            take = np.repeat(start[batch], lengths) + np.arange(lengths.sum()) - np.repeat(np.cumsum(lengths) - lengths, lengths)
            feature, value = local[index[take]], x[take]
            cut = np.cumsum(lengths) - lengths
            par = theta[feature]
            v = par[:, 1:] * value[:, None]
            total = np.add.reduceat(v, cut)
            margin = w0 + np.add.reduceat(par[:, 0] * value, cut) + 0.5 * (total**2 - np.add.reduceat(v * v, cut)).sum(1)
            g = (1 / (1 + np.exp(-margin)) - y[batch]) / len(batch)
            each = np.repeat(g, lengths)[:, None] * value[:, None]
            grad = np.concatenate([each, each * (np.repeat(total, lengths, 0) - v)], 1)
            touched, where = np.unique(feature, return_inverse=True)
            full = np.stack([np.bincount(where, grad[:, c], len(touched)) for c in range(rank + 1)], 1) + decay * theta[touched]
            step += 1
            m[touched] = 0.9 * m[touched] + 0.1 * full
            s[touched] = 0.99 * s[touched] + 0.01 * full**2
            theta[touched] -= rate / (1 + 12 * epoch / epochs) ** 0.5 * (m[touched] / (1 - 0.9**step)) / (np.sqrt(s[touched] / (1 - 0.99**step)) + 1e-8)
            w0 -= rate * g.sum()
    w, v = np.zeros(size, np.float32), np.zeros((size, rank), np.float32)
    w[used], v[used] = theta[:, 0], theta[:, 1:]
    return Machine(w0, w, v)


def train(docs: DataFrame, labels: DataFrame, label: str = "quality", allowed: F.Column | None = None, sample: int = SAMPLE) -> Machine:
    y, cut, word, tf, stats = sample_features(training_rows(docs, labels, label, sample, allowed), BITS)
    rows = assemble_sample(cut, word, tf, stats)
    del word, tf, stats
    return fit(y.astype(float), *rows, size=(1 << BITS) + N_STATS * N_BINS)


def held_out(doc_id: F.Column) -> F.Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(False))


def score(docs: DataFrame, machine: Machine, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, held_out, score and predicted for every row, in one pass without a shuffle. The model (9 floats for each of
    2^18 buckets, whatever the corpus) is broadcast. Null and empty texts are scored by their statistics alone; repeated rows
    and rows with a null doc_id (never held out) are scored each."""
    shared = docs.sparkSession.sparkContext.broadcast(machine)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for batch in batches:
            for lo, hi, b, off in blocks(batch.column("text"), SCAN_BYTES):
                row, word, n = word_counts(b, off, BITS)
                p = 1 / (1 + np.exp(-np.clip(model.margin(*assemble_rows(hi - lo, row, word, n.astype(float), statistics(b, off))), -40, 40)))
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(lo, hi - lo), pa.array(p)], names=["doc_id", "score"])

    got = docs.select("doc_id", "text").mapInArrow(run, "doc_id long, score double")
    return got.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def filter_documents(docs: DataFrame, machine: Machine, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of `docs` that score at least the threshold, with their columns; one pass. Null and empty texts are judged by
    their statistics, repeated rows alike."""
    shared = docs.sparkSession.sparkContext.broadcast(machine)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for batch in batches:
            keep = [np.zeros(0, bool)]
            for lo, hi, b, off in blocks(batch.column("text"), SCAN_BYTES):
                row, word, n = word_counts(b, off, BITS)
                p = 1 / (1 + np.exp(-np.clip(model.margin(*assemble_rows(hi - lo, row, word, n.astype(float), statistics(b, off))), -40, 40)))
                keep.append(p >= threshold)
            yield batch.filter(pa.array(np.concatenate(keep)))

    return docs.mapInArrow(run, docs.schema)
