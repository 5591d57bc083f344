"""Suffix-array deduplication: bytes covered by a string of 100 bytes that also starts earlier in the corpus.

Every window of 100 bytes is sampled at its minimiser, the 32-gram in it with the smallest hash: equal windows have equal
minimisers at equal places, so only suffixes that start there need sorting, about three in a hundred. Windows next to each
other with one minimiser form a stretch: the suffix at the minimiser, and the few bytes to its left.

1. Each chunk of documents sends the hashes of its minimisers and how often it has each; those that stand once can't repeat.
2. For the rest, each chunk sorts the suffixes at its minimisers and sends them as front-coded runs (length of the prefix
   shared with the suffix before, then the tail), dealt by the minimiser. Equal stretches of a chunk are neighbours in its
   run; all but the first are marked at once and not sent.
3. Runs are merged by a tournament tree of losers that carries the length of the prefix known to be shared with the last
   winner: bytes known to be equal are never compared again. What repeats is read off these lengths: a window that starts d
   bytes before the minimiser repeats where 100 - d bytes of the suffix and d bytes to the left, which are sorted alike, are
   shared with an earlier one. Runs of minimisers that very many chunks hold are merged in two steps.
4. Marks go back to their chunks, which drop the covered bytes.

A minimiser that stands before very many different texts would be one group; such hot ones are sampled at every window start
instead, so that each window is a suffix by itself and goes by its own hash.

Documents are dealt out to chunks of bounded size by one shuffle of the texts, which all three passes read.
"""

from __future__ import annotations

import hashlib
import math
import struct
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .kernels import BLOCK_BYTES, U64, mix, powers, prefix_hash, text_buffers

WIDTH = 100
GRAM = 32
#: Bytes of text in a chunk, as a rule (a document is never divided), and those whose minimisers share a bucket; fewest buckets.
CHUNK_BYTES, BUCKET_BYTES, LEAST_BUCKETS = 32 << 20, 12 << 20, 16
#: Minimisers that more chunks than this hold are merged in two steps; those with more stretches than that are hot.
WIDE, HOT = 64, 1 << 16
#: Suffixes that repeats are read off at once, as a rule (suffixes of one minimiser stay together).
SLICE = 100_000
_IS_WIDE, _IS_HOT = 1, 2
#: Steps of merging: runs that are merged for good, and marks on their way; numbers from 0 are groups of chunks.
_LAST, _MARKS = -1, -2
_SHIFT = U64(16)
_BLOB = pa.schema([("bucket", pa.int32()), ("part", pa.int32()), ("chunk", pa.int32()), ("blob", pa.binary())])
_BLOB_SQL = "bucket int, part int, chunk int, blob binary"


def rows_in_order(table: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray, pa.Array]:
    """doc_id (null: the largest), bytes and offsets of a chunk's documents in an order that every pass finds again."""
    table = table.take(pc.sort_indices(table, sort_keys=[("doc_id", "ascending"), ("text", "ascending")])).combine_chunks()
    ids = table.column("doc_id").combine_chunks() if table.num_rows else pa.array([], pa.int64())
    buf, off = text_buffers(table.column("text").combine_chunks() if table.num_rows else pa.array([], pa.string()))
    return ids.fill_null(np.iinfo(np.int64).max).to_numpy(), buf[off[0] : off[-1]], off - off[0], ids


def _pieces(off: np.ndarray) -> Iterator[tuple[int, int]]:
    """Runs of bytes to look at together: about a megabyte of whole documents; a longer document in overlapping parts."""
    i, n = 0, len(off) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(off, off[i] + BLOCK_BYTES, "right")) - 1)
        a, z = int(off[i]), int(off[j])
        while z - a > 2 * BLOCK_BYTES:
            yield a, a + BLOCK_BYTES + WIDTH - 1
            a += BLOCK_BYTES
        yield a, z
        i = j


def stretches(buf: np.ndarray, off: np.ndarray, width: int = WIDTH, gram: int = GRAM) -> tuple[np.ndarray, ...]:
    """First and last window start, minimiser's place and its 48-bit hash, for each stretch of a chunk's windows."""
    out = []
    ends = off[1:]
    for a, z in _pieces(off):
        b = buf[a:z]
        if len(b) < width:
            continue
        run = prefix_hash(b)
        h = mix((run[gram:] - run[:-gram]) * powers(len(run), True)[: len(run) - gram])
        bits = U64(max(1, int(len(b)).bit_length()))
        key = ((h >> bits) << bits) | np.arange(len(h), dtype=U64)
        span, have = width - gram + 1, 1
        while 2 * have <= span:
            key = np.minimum(key[:-have], key[have:])
            have *= 2
        if have < span:
            key = np.minimum(key[: len(key) - (span - have)], key[span - have :])
        place = (key & ((U64(1) << bits) - U64(1))).astype(np.int64)
        # windows that stay within their document
        start = np.arange(len(place)) + a
        doc = np.searchsorted(off, start, "right") - 1
        ok = start + width <= ends[doc]
        new = np.ones(len(place), bool)
        new[1:] = (place[1:] != place[:-1]) | (ok[1:] != ok[:-1]) | (doc[1:] != doc[:-1])
        first = np.flatnonzero(new)
        last = np.append(first[1:], len(place)) - 1
        keep = ok[first]
        first, last = first[keep], last[keep]
        # the smallest hashes of many are small: mixed again they deal out evenly
        out.append(np.stack([first + a, last + a, place[first] + a, (mix(h[place[first]]) >> _SHIFT).astype(np.int64)]))
    return tuple(np.concatenate(out, 1)) if out else tuple(np.zeros((4, 0), np.int64))


def _pack48(h: np.ndarray) -> bytes:
    return np.ascontiguousarray(h.astype("<i8").view(np.uint8).reshape(-1, 8)[:, :6]).tobytes()


def _unpack48(b: bytes) -> np.ndarray:
    out = np.zeros((len(b) // 6, 8), np.uint8)
    out[:, :6] = np.frombuffer(b, np.uint8).reshape(-1, 6)
    return out.view("<i8").ravel()


def _cuts(h: np.ndarray, buckets: int) -> np.ndarray:
    """Places in sorted 48-bit hashes where the buckets begin, and the end."""
    inner = np.searchsorted(h, np.array([i * (1 << 48) // buckets for i in range(1, buckets)], np.int64))
    return np.concatenate([[0], inner, [len(h)]])


def _table(rows: list[tuple[int, int, int, bytes]]) -> pa.Table:
    cols = list(zip(*rows)) or [[]] * 4
    return pa.Table.from_arrays([pa.array(c, f.type) for c, f in zip(cols, _BLOB)], schema=_BLOB)


def front_code(suffixes: list[bytes], known: list[int] | None = None) -> tuple[np.ndarray, bytes]:
    """Lengths of the prefix that each sorted suffix shares with the one before, unless `known`, and the tails in a row."""
    lcp, tails, before = np.zeros(len(suffixes), np.uint8), [], b""
    for i, s in enumerate(suffixes):
        lcp[i] = n = known[i] if known else common(before, s, 0)
        tails.append(s[n:])
        before = s
    return lcp, b"".join(tails)


def common(a: bytes, b: bytes, known: int) -> int:
    """Length of the common prefix of two strings of which `known` bytes are known to be equal."""
    n = min(len(a), len(b))
    x = int.from_bytes(a[known:n], "big") ^ int.from_bytes(b[known:n], "big")
    return n - (x.bit_length() + 7) // 8


class LoserTree:
    """Merges sorted runs of (string, prefix shared with the string before), and gives each string's common prefix with the
    one that came out before it. A loser keeps the length of the prefix it shares with the string that beat it, which is
    what it shares with the last winner when its turn comes."""

    def __init__(self, runs: list[tuple[list[bytes], list[int]]]):
        self.runs, self.at = runs, [0] * len(runs)
        self.size = 1
        while self.size < len(runs):
            self.size *= 2
        self.tree = [(-1, 0)] * self.size
        self.winner = self._build(1)

    def _build(self, node: int) -> tuple[int, int]:
        if node >= self.size:
            r = node - self.size
            return (r, 0) if r < len(self.runs) and self.runs[r][0] else (-1, 0)
        won, self.tree[node] = self._play(self._build(2 * node), self._build(2 * node + 1))
        return won

    def _play(self, x: tuple[int, int], y: tuple[int, int]):
        """(winner, loser) of two (run, prefix shared with the last winner)."""
        if x[0] < 0:
            return y, x
        if y[0] < 0 or x[1] > y[1]:
            return x, y
        if y[1] > x[1]:
            return y, x
        a, b = self.runs[x[0]][0][self.at[x[0]]], self.runs[y[0]][0][self.at[y[0]]]
        n = common(a, b, x[1])
        if n == len(a) if n == len(a) or n == len(b) else a[n] < b[n]:
            return x, (y[0], n)
        return y, (x[0], n)

    def __iter__(self) -> Iterator[tuple[int, int, int]]:
        """(run, index in it, prefix shared with the string before) in sorted order."""
        runs, at, tree, play = self.runs, self.at, self.tree, self._play
        r, shared = self.winner
        while r >= 0:
            i = at[r]
            yield r, i, shared
            at[r] = i + 1
            cur = (r, runs[r][1][i + 1]) if i + 1 < len(runs[r][0]) else (-1, 0)
            node = (r + self.size) >> 1
            while node:
                other = tree[node]
                if other[0] >= 0:
                    if cur[0] < 0 or other[1] > cur[1]:
                        cur, tree[node] = other, cur
                    elif other[1] == cur[1]:
                        cur, tree[node] = play(cur, other)
                node >>= 1
            r, shared = cur


@dataclass
class Run:
    """A sorted run: suffixes, the prefix each shares with the one before, the bytes to their left, and four numbers of each:
    doc_id, row in its chunk, start of the stretch in the document, chunk."""

    suffixes: list[bytes]
    lcp: list[int]
    lefts: list[bytes]
    numbers: np.ndarray

    def encode(self) -> bytes:
        lcp, tails = front_code(self.suffixes, self.lcp)
        head = np.array([[len(x) for x in self.suffixes], [len(x) for x in self.lefts]], np.uint8)
        body = struct.pack("<I", len(lcp)) + lcp.tobytes() + head.tobytes() + self.numbers[:, 0].astype("<i8").tobytes() + self.numbers[:, 1:].astype("<u4").tobytes() + tails + b"".join(self.lefts)
        return zstandard.ZstdCompressor(level=1).compress(body)

    @staticmethod
    def decode(blob: bytes) -> Run:
        body = zstandard.ZstdDecompressor().decompress(blob)
        n = struct.unpack_from("<I", body)[0]
        lcp = np.frombuffer(body, np.uint8, n, 4).tolist()
        sizes, left_sizes = np.frombuffer(body, np.uint8, 2 * n, 4 + n).reshape(2, -1).tolist()
        numbers = np.concatenate([np.frombuffer(body, "<i8", n, 4 + 3 * n).reshape(-1, 1), np.frombuffer(body, "<u4", 3 * n, 4 + 11 * n).reshape(-1, 3).astype(np.int64)], 1)
        at, suffixes, lefts, before = 4 + 23 * n, [], [], b""
        for k, size in zip(lcp, sizes):
            before = before[:k] + body[at : at + size - k]
            at += size - k
            suffixes.append(before)
        for size in left_sizes:
            lefts.append(body[at : at + size])
            at += size
        return Run(suffixes, lcp, lefts, numbers)


def merge_runs(runs: list[Run]) -> Run:
    """One sorted run of several; the lengths of shared prefixes come out of the tree."""
    which, place, lcp = [], [], []
    for r, i, shared in LoserTree([(x.suffixes, x.lcp) for x in runs]):
        which.append(r)
        place.append(i)
        lcp.append(shared)
    first = np.cumsum([0] + [len(x.lcp) for x in runs])
    numbers = np.concatenate([x.numbers for x in runs])[first[which] + place] if which else np.zeros((0, 4), np.int64)
    return Run([runs[r].suffixes[i] for r, i in zip(which, place)], lcp, [runs[r].lefts[i] for r, i in zip(which, place)], numbers)


def _between(shared: np.ndarray, kept: np.ndarray) -> np.ndarray:
    """Prefixes that neighbours share once only the entries at `kept` (ascending) are left: the least on the way."""
    return np.minimum.reduceat(shared, np.concatenate([[0], kept[:-1] + 1])) if len(kept) else shared[:0]


def repeats(run: Run, width: int = WIDTH, gram: int = GRAM) -> tuple[np.ndarray, np.ndarray]:
    """What repeats of sorted suffixes, read off the lengths of shared prefixes: for each entry whether all of its windows do,
    and for each entry and d whether its window that starts d bytes before the suffix does.

    Entries with the same d last bytes to the left are neighbours when these are sorted from their end, and their shared lengths
    say so in the same way. Of windows that are equal the first by doc_id, chunk, row and start doesn't repeat.
    """
    n, deep = len(run.lcp), width - gram + 1
    lcp, size = np.array(run.lcp, np.int64), np.array([len(x) for x in run.suffixes], np.int64)
    back, left_size = [x[::-1] for x in run.lefts], np.array([len(x) for x in run.lefts], np.int64)
    by_left = np.array(sorted(range(n), key=back.__getitem__), np.int64)
    shared = np.array([0] + [common(back[a], back[b], 0) for a, b in zip(by_left.tolist(), by_left[1:].tolist())], np.int64)
    rank = np.empty(n, np.int64)
    rank[np.lexsort((run.numbers[:, 2], run.numbers[:, 1], run.numbers[:, 3], run.numbers[:, 0]))] = np.arange(n)

    def alike(right: np.ndarray, left: np.ndarray, among: np.ndarray) -> np.ndarray:
        """Those of `among` with an earlier entry alike in both."""
        key = right[among] * (n + 1) + left[among]
        order = np.lexsort((rank[among], key))
        return among[order[1:]][key[order[1:]] == key[order[:-1]]]

    # stretches that are equal as a whole
    at, before = np.empty(n, np.int64), lambda x: np.concatenate([[-1], x[:-1]])
    in_order = left_size[by_left]
    at[by_left] = np.cumsum((shared != in_order) | (before(in_order) != in_order))
    whole = np.zeros(n, bool)
    whole[alike(np.cumsum((lcp != size) | (before(size) != size)), at, np.arange(n))] = True
    kept = np.flatnonzero(~whole)
    lcp, size, left_size, rank = _between(lcp, kept), size[kept], left_size[kept], rank[kept]
    number = np.cumsum(~whole) - 1
    stays = np.flatnonzero(~whole[by_left])
    shared, by_left = _between(shared, stays), number[by_left[stays]]
    again, at = np.zeros((n, deep), bool), np.empty(len(kept), np.int64)
    for d in range(deep):
        near = lcp >= width - d
        near[:-1] |= near[1:]
        among = np.flatnonzero(near & (size >= width - d) & (left_size >= d))
        if len(among) > 1:
            at[by_left] = np.cumsum(shared < d)
            again[kept[alike(np.cumsum(lcp < width - d), at, among)], d] = True
    return whole, again


def _marks(run: Run, whole: np.ndarray, again: np.ndarray, width: int) -> np.ndarray:
    """(chunk, row, first and last window start) of what repeats."""
    start, left, size = run.numbers[:, 2], np.array([len(x) for x in run.lefts], np.int64), np.array([len(x) for x in run.suffixes], np.int64)
    edge = np.diff(np.pad(again, ((0, 0), (1, 1))).astype(np.int8), axis=1)
    entry, low = np.nonzero(edge > 0)
    high = np.nonzero(edge < 0)[1] - 1
    entry, first, last = (np.concatenate(x) for x in ((np.flatnonzero(whole), entry), (start[whole], start[entry] + left[entry] - high), ((start + left + size - width)[whole], start[entry] + left[entry] - low)))
    return np.stack([run.numbers[entry, 3], run.numbers[entry, 1], first, last], 1)


def _slices(run: Run, gram: int, alone: bool) -> Iterator[Run]:
    """Parts of a run between minimisers; suffixes that no other shares its minimiser with are left out, unless `alone`."""
    starts = np.flatnonzero(np.array(run.lcp, np.int64) < gram)
    size = np.diff(np.append(starts, len(run.lcp)))
    keep = np.flatnonzero(np.repeat((size > 1) | alone, size))
    number = np.repeat(np.cumsum(size) // SLICE, size)[keep]
    cuts = np.flatnonzero(np.diff(number, prepend=-1)).tolist()
    for a, z in zip(cuts, [*cuts[1:], len(keep)]):
        own = keep[a:z].tolist()
        yield Run([run.suffixes[i] for i in own], [run.lcp[i] for i in own], [run.lefts[i] for i in own], run.numbers[own])


def deduplicate(docs: DataFrame, width: int = WIDTH, gram: int = GRAM) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 and kept (the remaining bytes) of every row (doc_id, text).

    Texts are taken as UTF-8 bytes (null: empty); matches stay within a document, and strings are judged on the input. The
    earlier of two places is that of the smaller doc_id, null being last and rows with equal ids going by their text; within
    a document, that of the smaller start. Texts below `width` bytes lose nothing. Repeated rows are each taken.
    """
    spark = docs.sparkSession
    text = F.coalesce("text", F.lit(""))
    n_bytes = docs.select(F.sum(F.octet_length(text))).first()[0] or 0
    # at small sizes three for each task, so that tasks come out even
    parts = max(3 * int(spark.conf.get("spark.sql.shuffle.partitions")), -(-n_bytes // CHUNK_BYTES))
    # each chunk sends a row to each bucket: their number follows the bytes, not the number of tasks
    groups, buckets = math.ceil(parts**0.5), max(LEAST_BUCKETS, -(-n_bytes // BUCKET_BYTES))
    wide, hot = WIDE, HOT
    spread = F.xxhash64("doc_id", F.when(F.col("doc_id").isNull(), F.col("text")))
    chunks = docs.select(F.pmod(spread, F.lit(parts)).cast("int").alias("chunk"), "doc_id", text.alias("text")).groupBy("chunk")

    def grams(key, table):
        _, buf, off, _ = rows_in_order(table)
        h, times = np.unique(stretches(buf, off, width, gram)[3], return_counts=True)
        bits = np.log2(np.maximum(times, 1)).astype(np.uint8)
        cut = _cuts(h, buckets)
        return _table([(int(i), 0, key[0].as_py(), _pack48(h[cut[i] : cut[i + 1]]) + bits[cut[i] : cut[i + 1]].tobytes()) for i in np.flatnonzero(np.diff(cut))])

    def repeated(key, table):
        blobs = [x.as_py() for x in table.column("blob")]
        sizes = [len(x) // 7 for x in blobs]
        h = _unpack48(b"".join(x[: 6 * n] for x, n in zip(blobs, sizes)))
        times = 1 << np.frombuffer(b"".join(x[6 * n :] for x, n in zip(blobs, sizes)), np.uint8).astype(np.int64)
        order = np.argsort(h)
        first = np.flatnonzero(np.diff(h[order], prepend=-1))
        have, all_times = np.diff(np.append(first, len(h))), np.add.reduceat(times[order], first)
        flag = np.empty(len(h), np.uint8)
        flag[order] = np.repeat(np.where(all_times > 1, 4, 0) + np.where(have > wide, _IS_WIDE, 0) + np.where(all_times > hot, _IS_HOT, 0), have)
        at = np.concatenate([[0], np.cumsum(sizes)])
        rows = [(0, 0, c, _pack48(h[a:z][ok]) + flag[a:z][ok].tobytes()) for c, a, z in zip(table.column("chunk").to_pylist(), at, at[1:]) if (ok := flag[a:z] > 0).any()]
        return _table(rows)

    def runs(key, table, shared):
        if not table.num_rows or not shared.num_rows:
            return _table([])
        chunk = key[0].as_py()
        ids, buf, off, _ = rows_in_order(table)
        first, last, place, h = stretches(buf, off, width, gram)
        blobs = [(x.as_py(), len(x.as_py()) // 7) for x in shared.column("blob")]
        known = _unpack48(b"".join(x[: 6 * n] for x, n in blobs))
        order = np.argsort(known)
        known, flag = known[order], np.frombuffer(b"".join(x[6 * n :] for x, n in blobs), np.uint8)[order]
        at = np.minimum(np.searchsorted(known, h), len(known) - 1)
        wanted = np.flatnonzero(known[at] == h)
        first, last, place, h, flag = first[wanted], last[wanted], place[wanted], h[wanted], flag[at[wanted]]
        row = np.searchsorted(off, first, "right") - 1
        raw = buf.tobytes()
        own: dict[tuple[int, int], list] = {}
        bucket = (h.astype(object) * buckets >> 48).tolist() if len(h) else []
        for a, z, p, r, k, f in zip(first.tolist(), last.tolist(), place.tolist(), row.tolist(), bucket, flag.tolist()):
            part = chunk % groups if f & _IS_WIDE else _LAST
            start = a - int(off[r])
            if f & _IS_HOT:
                for i in range(z - a + 1):
                    w = raw[a + i : a + i + width]
                    own.setdefault((int.from_bytes(hashlib.blake2b(w, digest_size=6).digest()) * buckets >> 48, part), []).append((w, b"", int(ids[r]), r, start + i))
            else:
                own.setdefault((k, part), []).append((raw[p : z + width], raw[a:p], int(ids[r]), r, start))
        out, marks = [], []
        for (k, part), entries in own.items():
            entries.sort()
            new = [True] + [x[:2] != y[:2] for x, y in zip(entries, entries[1:])]
            marks += [(r, start, start + len(s) + len(left) - width) for (s, left, _, r, start), n in zip(entries, new) if not n]
            kept = [e for e, n in zip(entries, new) if n]
            out.append((k, part, chunk, Run([e[0] for e in kept], [], [e[1] for e in kept], np.array([(*e[2:], chunk) for e in kept], np.int64)).encode()))
        if marks:
            out.append((chunk, _MARKS, chunk, np.array(marks, "<u4").tobytes()))
        return _table(out)

    def merge(key, table):
        bucket, part = key[0].as_py(), key[1].as_py()
        blobs = [x.as_py() for x in table.column("blob")]
        if part == _MARKS:
            return _table([(bucket, _MARKS, bucket, b"".join(blobs))])
        found, out = [], []
        for run in _slices(merge_runs([Run.decode(x) for x in blobs]), gram, part >= 0):
            whole, again = repeats(run, width, gram)
            found.append(_marks(run, whole, again, width))
            if part >= 0:  # the first ones go on to meet those of the other groups
                windows = np.array([len(s) + len(x) - width + 1 for s, x in zip(run.suffixes, run.lefts)])
                kept = np.flatnonzero(~whole & (again.sum(1) < windows))
                if len(kept):
                    lcp = _between(np.array(run.lcp), kept)
                    lcp[0] = 0
                    out.append((bucket, _LAST, -1, Run([run.suffixes[i] for i in kept], lcp.tolist(), [run.lefts[i] for i in kept], run.numbers[kept]).encode()))
        m = np.concatenate(found) if found else np.zeros((0, 4), np.int64)
        m = m[np.argsort(m[:, 0], kind="stable")]
        c, at = np.unique(m[:, 0], return_index=True)
        return _table(out + [(int(i), _MARKS, int(i), m[a:z, 1:].astype("<u4").tobytes()) for i, a, z in zip(c, at, [*at[1:], len(m)])])

    def drop(key, table, marked):
        if not table.num_rows:
            return _RESULT.empty_table()
        _, buf, off, ids = rows_in_order(table)
        m = np.frombuffer(b"".join(x.as_py() for x in marked.column("blob")), "<u4").reshape(-1, 3).astype(np.int64)
        edge = np.zeros(len(buf) + 1, np.int64)
        np.add.at(edge, off[m[:, 0]] + m[:, 1], 1)
        np.subtract.at(edge, off[m[:, 0]] + m[:, 2] + width, 1)
        gone = np.cumsum(edge)[:-1] > 0
        begins = gone.copy()
        begins[1:] &= ~gone[:-1]
        heads = off[:-1][off[:-1] < len(buf)]
        begins[heads] = gone[heads]
        per = lambda x: np.diff(np.concatenate([[0], np.cumsum(x)])[off])
        n_removed, n_spans = per(gone), per(begins)
        kept, at = buf[~gone].tobytes(), np.concatenate([[0], np.cumsum(np.diff(off) - n_removed)])
        left = [kept[a:z] for a, z in zip(at, at[1:])]
        return pa.Table.from_arrays([ids, pa.array(np.diff(off)), pa.array(n_removed), pa.array(n_spans), pa.array([hashlib.sha256(x).hexdigest() for x in left]), pa.array(left, pa.binary())], schema=_RESULT)

    asked = chunks.applyInArrow(grams, _BLOB_SQL).groupBy("bucket").applyInArrow(repeated, _BLOB_SQL)
    sent = chunks.cogroup(asked.groupBy("chunk")).applyInArrow(runs, _BLOB_SQL)
    marked = sent.groupBy("bucket", "part").applyInArrow(merge, _BLOB_SQL).groupBy("bucket", "part").applyInArrow(merge, _BLOB_SQL)
    return chunks.cogroup(marked.groupBy("chunk")).applyInArrow(drop, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept binary")


_RESULT = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("n_removed", pa.int64()), ("n_spans", pa.int64()), ("kept_sha256", pa.string()), ("kept", pa.binary())])
