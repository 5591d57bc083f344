"""Rows compared with rows, block by block: a task holds two blocks, and what it gives is only what belongs to the answer.

For work that is quadratic by nature. No row is shuffled for a pair: what is sent are the rows, once for each block of the other side."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Rows of a block, about; smaller ones where there would be too few tasks, but not below LEAST.
LIMIT, LEAST = 1 << 15, 1 << 10
#: Queries and rows that are compared at once, rows that give the first bounds, and pairs that are returned at once.
QUERIES, ROWS, FIRST, PAIRS = 128, 4096, 2048, 1 << 17


def shape(asked: int, rows: int, cores: int) -> tuple[int, int]:
    """Numbers of blocks of queries and of rows: as few as their sizes and four tasks for each core allow."""
    a, b = max(1, math.ceil(asked / LIMIT)), max(1, math.ceil(rows / LIMIT))
    while a * b < 4 * cores:
        more_a, more_b = asked >= (a + 1) * LEAST, rows >= (b + 1) * LEAST
        if more_b and (not more_a or asked * b <= rows * a):  # another block of rows takes a copy of all queries
            b += 1
        elif more_a:
            a += 1
        else:
            break
    return a, b


def block(key: str, n: int):
    return F.pmod(F.xxhash64(key), F.lit(n)).cast("int")


def _dealt(df: DataFrame, groups: int) -> DataFrame:
    return df.repartition(groups, "_i", "_j").groupBy("_i", "_j")  # a stated number: small partitions are not put together


def _held(batches: Iterator[pa.RecordBatch]) -> pa.Table:
    return pa.Table.from_batches(list(batches)).combine_chunks()


def _lists(column: pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """Lengths of lists (null: -1) and their values one after the other."""
    lengths = column.combine_chunks().value_lengths().fill_null(-1).to_numpy(zero_copy_only=False)
    return lengths, column.combine_chunks().flatten().to_numpy(zero_copy_only=False)


# -- pairs that share a member


def overlaps(tags: DataFrame, key: str, x: str = "kc") -> DataFrame:
    """(a, b, shared) for all pairs of rows, a < b, whose lists share a member. `key` is unique and a whole number."""
    own = tags.where(F.col(key).isNotNull()).select(F.col(key).cast("long").alias("_key"), F.col(x).alias("_x"))
    n = own.count()
    k = max(1, math.ceil(n / LIMIT), min(8, math.ceil(n / LEAST)))
    own = own.withColumn("_b", block("_key", k)).withColumn("_o", F.explode(F.sequence(F.lit(0), F.lit(k - 1))))
    sent = own.select(F.least("_b", "_o").alias("_i"), F.greatest("_b", "_o").alias("_j"), (F.col("_b") > F.col("_o")).alias("_right"), "_key", "_x")
    most, schema = PAIRS, pa.schema([("a", pa.int64()), ("b", pa.int64()), ("shared", pa.int64())])

    def pairs(key: tuple[pa.Scalar, ...], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = _held(batches)
        keys, right = t.column("_key").to_numpy(), t.column("_right").to_numpy()
        lengths, values = _lists(t.column("_x"))
        starts = np.concatenate([[0], np.cumsum(np.maximum(lengths, 0))])
        same = key[0].as_py() == key[1].as_py()
        left = np.flatnonzero(~right)
        others = left if same else np.flatnonzero(right)
        left, others = left[np.argsort(keys[left], kind="stable")], others[np.argsort(keys[others], kind="stable")]
        # postings: for each member the places of the other rows that hold it, ascending
        cells, codes = np.unique(values, return_inverse=True)
        at = np.full(len(keys), -1, dtype=np.int64)
        at[others] = np.arange(len(others))
        held = np.repeat(at, np.maximum(lengths, 0))
        order = np.argsort(codes[held >= 0], kind="stable")
        posted = held[held >= 0][order]
        ends = np.searchsorted(codes[held >= 0][order], np.arange(len(cells) + 1))
        theirs, done, n = keys[others], [], 0
        for i in left:
            mine = codes[starts[i] : starts[i + 1]]
            if not len(mine):
                continue
            shared = np.bincount(np.concatenate([posted[ends[c] : ends[c + 1]] for c in mine]), minlength=len(others))
            if same:
                shared[: np.searchsorted(theirs, keys[i], side="right")] = 0
            met = np.flatnonzero(shared)
            b, a = theirs[met], np.full(len(met), keys[i])
            done.append((np.minimum(a, b), np.maximum(a, b), shared[met]))
            n += len(met)
            if n >= most:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c), pa.int64()) for c in zip(*done)], schema=schema)
                done, n = [], 0
        if n:
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c), pa.int64()) for c in zip(*done)], schema=schema)

    return _dealt(sent, k * (k + 1) // 2).applyInArrow(pairs, "a long, b long, shared long")


# -- the n nearest


class Sets:
    """Sets as bits, and their Hamming distance."""

    def __init__(self, column: pa.ChunkedArray):
        lengths, values = _lists(column)
        cells, codes = np.unique(values, return_inverse=True)
        self.words = np.zeros((max(1, math.ceil(len(cells) / 64)), len(lengths)), dtype=np.uint64)
        np.bitwise_or.at(self.words, (codes >> 6, np.repeat(np.arange(len(lengths)), np.maximum(lengths, 0))), np.uint64(1) << (codes & 63).astype(np.uint64))
        self.kind = np.uint8 if len(cells) < 255 else np.int32

    def between(self, q: np.ndarray, r: np.ndarray):
        """Bounds from below and from above of the distances of rows q to rows r."""
        d = np.zeros((len(q), len(r)), dtype=self.kind)
        for w in self.words:
            d += np.bitwise_count(w[q][:, None] ^ w[r])
        return d, d

    def exact(self, q: np.ndarray, r: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Distances of pairs, and whether they are unknown."""
        return sum(np.bitwise_count(w[q] ^ w[r]).astype(np.float64) for w in self.words), np.zeros(len(q), dtype=bool)

    def below(self, nth: np.ndarray) -> np.ndarray:
        """What a bound must stay under if a later row is to be nearer than this."""
        return nth


class Vectors:
    """Vectors and their Euclidean distance, in double precision; null where one is null or they differ in length."""

    def __init__(self, column: pa.ChunkedArray):
        lengths, values = _lists(column)
        values = values.astype(np.float64)
        self.lengths, dims = lengths, max(1, lengths.max(initial=0))
        self.x = np.zeros((len(lengths), dims))
        self.x[np.arange(dims) < lengths[:, None]] = values
        self.null = lengths < 0
        flat = column.combine_chunks().flatten()
        if flat.null_count:  # lists with nulls in them
            self.null[np.repeat(np.arange(len(lengths)), np.maximum(lengths, 0))[flat.is_null().to_numpy(zero_copy_only=False)]] = True
        with np.errstate(invalid="ignore"):
            fine = (np.abs(self.x) < 1e100).all(axis=1)
        self.odd = self.null | ~fine | (lengths != np.bincount(lengths + 1).argmax() - 1)
        self.plain = np.where(self.odd[:, None], 0.0, self.x)
        self.norm = (self.plain * self.plain).sum(axis=1)

    def between(self, q: np.ndarray, r: np.ndarray):
        """Bounds of the squares by a matrix product; none for pairs with odd rows."""
        size = self.norm[q][:, None] + self.norm[r]
        d = self.plain[q] @ self.plain[r].T
        d *= -2
        d += size
        size *= 1e-13 * (self.x.shape[1] + 8)  # far above what rounding can be
        low, high = d - size, d + size
        if self.odd[q].any() or self.odd[r].any():
            strange = self.odd[q][:, None] | self.odd[r]
            low[strange], high[strange] = -np.inf, np.inf
        return low, high

    def exact(self, q: np.ndarray, r: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        a, b, total = self.x[q], self.x[r], np.zeros(len(q))
        with np.errstate(all="ignore"):
            for i in range(self.x.shape[1]):  # one after the other, as engines add
                d = a[:, i] - b[:, i]
                total += d * d
            total = np.sqrt(total)
        unknown = self.null[q] | self.null[r] | (self.lengths[q] != self.lengths[r])
        return np.where(unknown, np.nan, total), unknown

    def below(self, nth: np.ndarray) -> np.ndarray:
        return nth * nth * (1 + 1e-12) + 1e-300


def _first(n: int, q: np.ndarray, d: np.ndarray, unknown: np.ndarray, r: np.ndarray):
    """Of pairs the n first of each query by distance, those without one last, then place of the row."""
    order = np.lexsort((r, d, unknown, q))
    q, d, unknown, r = q[order], d[order], unknown[order], r[order]
    keep = np.arange(len(q)) - np.searchsorted(q, q) < n
    return q[keep], d[keep], unknown[keep], r[keep]


def _tops(rows, queries: np.ndarray, others: np.ndarray, codes: np.ndarray, n: int):
    """For some queries at a time (place of the query, of the row, distance, whether it is unknown) of the n nearest others.

    `others` come in the order that settles ties, so a later row must be nearer than the n-th to displace it.
    """
    for at in range(0, len(queries), QUERIES):
        q = queries[at : at + QUERIES]
        best = (np.empty(0, np.int64), np.empty(0), np.empty(0, bool), np.empty(0, np.int64))
        under, start = np.full(len(q), np.inf), 0
        while start < len(others):
            stop = start + (ROWS if start else max(FIRST, 2 * n))
            r = others[start:stop]
            low, high = rows.between(q, r)
            if start == 0 and len(r) > n + 1:  # of n + 1 rows of another key the n-th at least; the query's own row is one too many
                nth = np.partition(np.where(codes[q][:, None] == codes[r], np.inf, high), n - 1, axis=1)[:, n - 1]
                met = low <= nth[:, None]
            else:
                met = (low < under[:, None]) | np.isinf(under)[:, None]
            i, j = np.nonzero(met)
            own = codes[q[i]] != codes[r[j]]
            i, j = i[own], j[own]
            if len(i):
                best = _first(n, *(np.concatenate(c) for c in zip(best, (i, *rows.exact(q[i], r[j]), j + start))))
                full = np.flatnonzero(np.bincount(best[0], minlength=len(q)) == n)
                last = best[1][np.searchsorted(best[0], full, side="right") - 1]
                under[full] = np.where(np.isfinite(last), rows.below(last), np.inf)
            start = stop
        yield q[best[0]], others[best[3]], best[1], best[2]


def nearest(own: DataFrame, asked: DataFrame, key: str, n: int, x: str, kind: Callable, of: str, ties: tuple[Column, ...] = (), extra: tuple[str, ...] = ()) -> DataFrame:
    """(q, key, extra columns, distance) with the n rows of `own` nearest to each row of `asked`, and more: the n of each block.

    `own` is read several times, so it should be written. Equal distances go by `ties`, then key. Blocks are chosen by hash.
    """
    context = own.sparkSession.sparkContext
    rows = own.where(F.col(key).isNotNull()).select(F.col(key).alias("_key"), F.col(x).alias("_x"), *extra)
    q = rows.join(asked.select(F.col(key).alias("_key")).distinct(), "_key", "left_semi")
    a, b = shape(q.count(), rows.count(), context.defaultParallelism)
    every = lambda k: F.explode(F.sequence(F.lit(0), F.lit(k - 1)))
    cols = ["_i", "_j", "_rank", "_key", "_x", *extra]
    order = F.row_number().over(Window.partitionBy("_j").orderBy(*ties, "_key"))
    held = rows.withColumn("_j", block("_key", b)).withColumn("_rank", order).withColumn("_i", every(a)).select(cols)
    sent = q.withColumn("_i", block("_key", a)).withColumn("_j", every(b)).withColumn("_rank", F.lit(0)).select(cols).unionByName(held)
    fields = {f.name: f.dataType for f in sent.schema.fields}
    schema = ", ".join([f"q {fields['_key'].simpleString()}", f"`{key}` {fields['_key'].simpleString()}", *(f"`{e}` {fields[e].simpleString()}" for e in extra), f"distance {of}"])

    def tops(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = _held(batches)
        rank = t.column("_rank").to_numpy()
        queries, others = np.flatnonzero(rank == 0), np.flatnonzero(rank > 0)
        others = others[np.argsort(rank[others], kind="stable")]
        keys = t.column("_key").combine_chunks()
        codes = keys.dictionary_encode().indices.to_numpy(zero_copy_only=False)
        for i, j, d, unknown in _tops(kind(t.column("_x")), queries, others, codes, n):
            found = [t.column(e).combine_chunks().take(pa.array(j)) for e in extra]
            distance = pa.array(d, mask=unknown) if of == "double" else pa.array(d.astype(np.int64))
            yield pa.RecordBatch.from_arrays([keys.take(pa.array(i)), keys.take(pa.array(j)), *found, distance], names=["q", key, *extra, "distance"])

    return _dealt(sent, a * b).applyInArrow(tops, schema)
