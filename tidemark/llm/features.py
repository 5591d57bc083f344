"""Hashed word features and structure statistics of documents, and bounded training samples."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .kernels import ALNUM, SPACE, blocks, lower_ascii, prefix_hash, span_hash, words

N_STATS = 12
N_BINS = 10


def word_counts(b: np.ndarray, off: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row, hashed word and count of each distinct word of each document of a block, sorted by row."""
    low = lower_ascii(b)
    s, e, first = words(low, off, ALNUM)
    h = span_hash(prefix_hash(low), s, e) >> np.uint64(64 - bits)
    row = np.repeat(np.arange(len(off) - 1, dtype=np.uint64), np.diff(first))
    key, n = np.unique((row << np.uint64(bits)) | h, return_counts=True)
    return (key >> np.uint64(bits)).astype(np.int64), (key & np.uint64((1 << bits) - 1)).astype(np.int64), n


def statistics(b: np.ndarray, off: np.ndarray) -> np.ndarray:
    """Structure of each document, each value between 0 and 1: shares of kinds of bytes, word lengths, lines, length."""
    n, size = len(off) - 1, np.maximum(np.diff(off), 1)
    share = lambda mask: np.diff(np.concatenate([[0], np.cumsum(mask)])[off]) / size
    s, e, first = words(b, off, SPACE)
    n_words = np.diff(first)
    per_word = np.maximum(n_words, 1)
    along = lambda x: np.diff(np.concatenate([[0], np.cumsum(x)])[first]) / per_word
    length = e - s
    end_byte = b[e - 1] if len(e) else np.zeros(0, np.uint8)
    upper, digit, newline = (b >= 65) & (b <= 90), (b >= 48) & (b <= 57), b == 10
    alpha = upper | ((b >= 97) & (b <= 122)) | (b >= 128)
    space = ~SPACE[b]
    plain = np.isin(end_byte, np.frombuffer(b".,;:'\")", np.uint8))
    odd_end = ~plain & ~(((end_byte >= 48) & (end_byte <= 57)) | ((end_byte >= 65) & (end_byte <= 90)) | ((end_byte >= 97) & (end_byte <= 122)) | (end_byte >= 128))
    return np.stack(
        [
            share(alpha), share(upper), share(digit), share(space), share(newline) * 20, share(~(alpha | digit | space)) * 4, along(length) / 16, along(length == 1), along(length > 16) * 4, along(odd_end),
            np.log1p(n_words) / 12, share((b == 46) | (b == 44)) * 8,
        ],
        1,
    ).clip(0, 1)


def stat_bins(stats: np.ndarray) -> np.ndarray:
    """Column index of each statistic's bin."""
    return np.minimum((stats * N_BINS).astype(np.int64), N_BINS - 1) + np.arange(N_STATS) * N_BINS


def training_rows(docs: DataFrame, labels: DataFrame, label: str, most: int, allowed: F.Column | None = None) -> DataFrame:
    """doc_id, text and label of at most `most` labelled documents, those with the smallest hash of doc_id.

    Several labels of one document count as their maximum; null labels are left out. Of rows that repeat a doc_id one counts,
    that with the smallest text, so the bound holds whatever the tables repeat. Only these bounded ids are broadcast, and copies
    are dropped before anything is shuffled.
    """
    y = labels.where(F.col(label).isNotNull() & F.col("doc_id").isNotNull())
    y = y.where(allowed) if allowed is not None else y
    y = y.groupBy("doc_id").agg(F.max(label).cast("int").alias("y")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(most)
    return docs.select("doc_id", "text").join(F.broadcast(y), "doc_id").groupBy("doc_id").agg(F.min("text").alias("text"), F.max("y").alias("y"))


SAMPLE_SCHEMA = "y int, word array<int>, tf array<int>, stats array<double>"


def sample_features(rows: DataFrame, bits: int) -> list:
    """Features of the training rows, computed on the executors; the result is bounded by the sample."""

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi, b, off in blocks(batch.column("text")):
                row, word, n = word_counts(b, off, bits)
                cut = np.searchsorted(row, np.arange(hi - lo + 1)).astype(np.int32)
                yield pa.RecordBatch.from_arrays([batch.column("y").slice(lo, hi - lo), pa.ListArray.from_arrays(cut, pa.array(word.astype(np.int32))), pa.ListArray.from_arrays(cut, pa.array(n.astype(np.int32))), pa.array(statistics(b, off).tolist(), pa.list_(pa.float64()))], names=["y", "word", "tf", "stats"])

    got = rows.select("y", "text").mapInArrow(make, SAMPLE_SCHEMA).toArrow()
    y = got.column("y").to_numpy()
    word, tf, stats = (got.column(c).combine_chunks() for c in ("word", "tf", "stats"))
    if not len(y):
        return y, np.zeros(1, np.int64), np.zeros(0, np.int32), np.zeros(0, np.int32), np.zeros((0, N_STATS))
    # words and counts as they came: the sample is small for a cluster, but not for a driver that holds it several times
    return y, np.concatenate([[0], np.cumsum(word.value_lengths().to_numpy(False), dtype=np.int64)]), word.flatten().to_numpy(), tf.flatten().to_numpy(), np.array(stats.flatten()).reshape(-1, N_STATS)
