"""Vectorised byte kernels shared by the corpus operators.

A block is a run of whole documents taken straight from an Arrow string column: `buf` holds their UTF-8 bytes back to
back and `off` their boundaries. Blocks are kept near a megabyte, so the 8-byte temporaries stay small whatever the
batch size is; a longer document is a block of its own.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

U64 = np.uint64
BLOCK_BYTES = 1 << 20
#: For scans that make many temporaries of a block and gain nothing by larger ones.
SCAN_BYTES = 1 << 18
_BASE = 0x9E3779B97F4A7C15 | 1
_BASE_INVERSE = pow(_BASE, -1, 1 << 64)
_powers: dict[int, np.ndarray] = {}


def text_buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and int64 offsets of a string column, without copying; null rows are empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    kind = np.int64 if wide else np.int32
    _, offsets, data = column.buffers()
    if offsets is None or len(column) == 0:
        return np.zeros(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    off = np.frombuffer(offsets, kind)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    buf = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return buf, off


def blocks(column: pa.Array, most: int = BLOCK_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, row after the last, bytes, offsets from 0) for runs of about `most` bytes."""
    buf, off = text_buffers(column)
    at, n = 0, len(off) - 1
    while at < n:
        to = max(at + 1, int(np.searchsorted(off, off[at] + most, "right")) - 1)
        to = min(to, n)
        yield at, to, buf[off[at] : off[to]], off[at : to + 1] - off[at]
        at = to


def lower_ascii(b: np.ndarray) -> np.ndarray:
    """A-Z in lower case, other bytes as they are."""
    return b + (((b >= 65) & (b <= 90)).astype(np.uint8) << 5)


def mix(h: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (splitmix64), in place where it can."""
    h = h ^ (h >> U64(30))
    h *= U64(0xBF58476D1CE4E5B9)
    h ^= h >> U64(27)
    h *= U64(0x94D049BB133111EB)
    h ^= h >> U64(31)
    return h


def powers(n: int, inverse: bool = False) -> np.ndarray:
    have = _powers.get(inverse)
    if have is None or len(have) < n:
        size = max(n, BLOCK_BYTES + 1)
        have = np.full(size, _BASE_INVERSE if inverse else _BASE, U64)
        have[0] = 1
        np.multiply.accumulate(have, out=have)
        _powers[inverse] = have
    return have[:n]


def prefix_hash(b: np.ndarray) -> np.ndarray:
    """Running polynomial hash; with `spans` it gives the hash of any substring."""
    run = np.zeros(len(b) + 1, U64)
    terms = b.astype(U64)
    terms += U64(1)
    terms *= powers(len(b))
    np.cumsum(terms, out=run[1:])
    return run


def span_hash(run: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    return mix((run[end] - run[start]) * powers(len(run), True)[start] + (end - start).astype(U64))


#: Separators of words taken as [^\x20\x09-\x0D]+.
SPACE = np.ones(256, bool)
SPACE[[32, 9, 10, 11, 12, 13]] = False
#: Bytes of words taken as [^\x00-\x2F\x3A-\x60\x7B-\x7F]+ : digits, a-z and every byte of a non-ASCII character.
ALNUM = np.zeros(256, bool)
ALNUM[48:58] = ALNUM[97:123] = ALNUM[128:] = True


def words(b: np.ndarray, off: np.ndarray, table: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the words of a block, and the index of each document's first word (one more at the end)."""
    is_word = table[b]
    edge = np.zeros(len(b) + 1, bool)
    edge[off] = True
    before = np.zeros(len(b) + 1, bool)
    before[1:] = is_word
    inside = np.zeros(len(b) + 1, bool)
    inside[:-1] = is_word
    starts = np.flatnonzero(inside & (~before | edge))
    ends = np.flatnonzero(before & (~inside | edge))
    return starts, ends, np.searchsorted(starts, off)


def ngram_hash(h: np.ndarray, n: int) -> np.ndarray:
    """Hash of every n consecutive word hashes (len(h) - n + 1 of them)."""
    m = len(h) - n + 1
    if m <= 0:
        return np.zeros(0, U64)
    g = h[:m].copy()
    for i in range(1, n):
        g *= U64(_BASE)
        g += h[i : i + m]
    return mix(g)
