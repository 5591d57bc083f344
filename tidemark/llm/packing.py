"""Best-fit packing of token sequences: a configuration linear program over the length histogram.

Tokens are counted once; everything after works on the histogram of piece lengths, which has at most `capacity` rows
whatever the corpus. Lengths are grouped upward into classes that hold enough pieces each, and the covering program (choose
how often to use each way of filling a sequence with classes) is solved by multiplicative weights: classes that are short of
coverage gain weight, and a knapsack over the capacity prices the configurations. The solution is rounded to whole sequences
by carrying remainders on; each slot takes the longest piece of its class, the last one the longest that fits. Pieces whose
sequence would stay too empty, and what is left, are packed best-fit into the rooms left open and into new sequences. The
resulting plan - ranges of ranks within each length - places every piece.
"""

from __future__ import annotations

import os
import re
import zlib
from bisect import bisect_right, insort
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .kernels import prefix_hash, span_hash
from .shared import materialise

CAPACITY = 4096
END_ID = 1
#: Words whose ids a worker remembers before it starts anew, and bytes of text that it looks at together.
_CACHE_WORDS, BLOCK_BYTES = 400_000, 1 << 18

#: Classes of lengths are made so wide that they hold this many pieces each, on the whole.
CLASS_PIECES = 32
#: Rounded sequences may have this share of empty room.
EMPTY = 0.001
#: Shares of the program's solution that rounding is tried with; what they leave goes to best fit.
SHARES = (1.0, 0.9, 0.75, 0.6)

# Text within Latin-1 needs no Unicode tables: it is in normal form, and its letters, digits and white space are these.
_BEYOND = re.compile(r"[^\x00-\xff]")
_SPACE = re.compile(rb"[\t-\r \x85\xa0]")
_NOTHING, _LETTER, _DIGIT, _OTHER = range(4)
_KIND = np.full(256, _OTHER, np.uint8)
_KIND[[*range(9, 14), 32, 0x85, 0xA0]] = _NOTHING
_KIND[[*range(0x41, 0x5B), *range(0x61, 0x7B), 0xAA, 0xB5, 0xBA, *range(0xC0, 0xD7), *range(0xD8, 0xF7), *range(0xF8, 0x100)]] = _LETTER
_KIND[[*range(0x30, 0x3A), 0xB2, 0xB3, 0xB9, 0xBC, 0xBD, 0xBE]] = _DIGIT
_APOSTROPHE = ord("'")
#: What an apostrophe takes with it: these letters, or these pairs of letters.
_TAKES_ONE, _TAKES_TWO = np.frombuffer(b"stmd", np.uint8), [tuple(x) for x in (b"re", b"ve", b"ll")]


def latin_words(b: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the tokenizer's words in lower-cased Latin-1 texts that lie end to end: contractions, runs of
    letters, single digits, and runs of what is neither these nor white space."""
    if not len(b):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    kind = _KIND[b]
    heads = off[:-1][off[:-1] < len(b)]
    before = np.concatenate([[np.uint8(_NOTHING)], kind[:-1]])
    before[heads] = _NOTHING
    start = (kind != _NOTHING) & ((kind != before) | (kind == _DIGIT))
    q = np.flatnonzero((b[:-1] == _APOSTROPHE) & start[:-1] & (kind[1:] == _LETTER) & (before[1:] == _OTHER))
    second = np.minimum(q + 2, len(b) - 1)
    goes_on = (q + 2 < len(b)) & (kind[second] == _LETTER) & (before[second] == _LETTER)
    two = np.zeros(len(q), bool)
    for x, y in _TAKES_TWO:
        two |= (b[q + 1] == x) & (b[second] == y)
    takes = np.where(np.isin(b[q + 1], _TAKES_ONE), 1, np.where(two & goes_on, 2, 0))
    q, takes = q[takes > 0], takes[takes > 0]
    start[q + 1] = False
    after = (q + 1 + takes)[q + 1 + takes < len(b)]
    start[after[(kind[after] == _LETTER) & (before[after] == _LETTER)]] = True
    stop = start | (kind == _NOTHING)
    stop[heads] = True
    s, places = np.flatnonzero(start), np.append(np.flatnonzero(stop), len(b))
    return s, places[np.searchsorted(places, s, "right")]


class WordTokenizer:
    """Ids of a BPE tokenizer that lower-cases, splits into words and merges within a word: each distinct word is encoded
    once, and the ids of a block of texts are put together at once. Words are told apart by 64-bit hashes.

    Texts beyond Latin-1, or with what may be a special token, go to the tokenizer whole.
    """

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        vocabulary = self.tokenizer.get_vocab()
        self.ends_word = np.zeros(max(vocabulary.values()) + 1, bool)
        self.ends_word[[i for w, i in vocabulary.items() if w.endswith("</w>")]] = True
        self._forget()

    def _forget(self) -> None:
        """Sorted hashes of known words and their numbers; by number the place and length of their ids in the store."""
        self.known, self.number = np.zeros(0, np.uint64), np.zeros(0, np.int32)
        self.store, self.at, self.size = np.zeros(0, "<u4"), np.zeros(0, np.int32), np.zeros(0, np.int32)

    def ids(self, text: str) -> np.ndarray:
        return self.encode([text])[0]

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        """The ids of each text. Long texts are cut at white space, so that blocks stay small."""
        out: list[list[np.ndarray]] = [[] for _ in texts]
        rows, parts, size = [], [], 0
        for i, text in enumerate(texts):
            if "<|" in text or _BEYOND.search(text):
                out[i].append(self._whole(text))
                continue
            data, at = text.lower().encode("latin-1"), 0
            while at < len(data):
                cut = _SPACE.search(data, at + BLOCK_BYTES) if len(data) - at > 2 * BLOCK_BYTES else None
                end = cut.start() if cut else len(data)
                rows.append(i)
                parts.append(data[at:end])
                size += end - at
                at = end
                if size >= BLOCK_BYTES:
                    self._block(rows, parts, out)
                    rows, parts, size = [], [], 0
        self._block(rows, parts, out)
        return [x[0] if len(x) == 1 else np.concatenate(x) if x else np.zeros(0, "<u4") for x in out]

    def _block(self, rows: list[int], parts: list[bytes], out: list[list[np.ndarray]]) -> None:
        raw, off = b"".join(parts), np.concatenate([[0], np.cumsum([len(x) for x in parts], dtype=np.int64)])
        b = np.frombuffer(raw, np.uint8)
        s, e = latin_words(b, off)
        h, first, of = np.unique(span_hash(prefix_hash(b), s, e), return_index=True, return_inverse=True)
        if len(self.known) > _CACHE_WORDS:
            self._forget()
        place = np.searchsorted(self.known, h)
        new = np.flatnonzero(np.append(self.known, np.uint64(0))[place] != h) if len(self.known) else np.arange(len(h))
        if len(new):
            self._learn([raw[s[i] : e[i]].decode("latin-1") for i in first[new].tolist()])
            have = len(self.known)
            self.known = np.insert(self.known, place[new], h[new])
            self.number = np.insert(self.number, place[new], np.arange(have, have + len(new), dtype=np.int32))
        number = self.number[np.searchsorted(self.known, h)]
        n, at = self.size[number][of].astype(np.int64), self.at[number][of].astype(np.int64)
        total = np.cumsum(n)
        ids = self.store[np.repeat(at - (total - n), n) + np.arange(total[-1] if len(total) else 0)]
        cut = np.concatenate([[0], total])[np.searchsorted(s, off)].tolist()
        for i, a, z in zip(rows, cut, cut[1:]):
            out[i].append(ids[a:z])

    def _learn(self, new: list[str]) -> None:
        """Encode words in one call, which costs far less than one each, and cut the ids at word ends."""
        ids = self._whole(" ".join(new))
        end = np.flatnonzero(self.ends_word[ids]) + 1
        if len(end) != len(new):  # an id that ends a word within one: take each by itself
            own = [self._whole(w) for w in new]
            ids, end = np.concatenate(own), np.cumsum([len(x) for x in own])
        start = np.concatenate([[0], end[:-1]])
        self.at, self.size = np.append(self.at, (len(self.store) + start).astype(np.int32)), np.append(self.size, (end - start).astype(np.int32))
        self.store = np.append(self.store, ids)

    def _whole(self, text: str) -> np.ndarray:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4")


@lru_cache(maxsize=2)
def worker_tokenizer(path: str) -> WordTokenizer:
    """One for each worker process, so that what it knows outlives a task."""
    return WordTokenizer(path)


def tokenizer_path(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


PIECE_SCHEMA = "doc_id long, piece int, start long, length long, ids_crc32 long"


def pieces(docs: DataFrame, path: str, capacity: int = CAPACITY, end_id: int = END_ID, with_ids: bool = False) -> DataFrame:
    """One row for each piece of each document: its tokens and the end id, cut every `capacity` tokens. No shuffle."""
    end = np.array([end_id], "<u4")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tok = worker_tokenizer(path)
        for whole in batches:
            size = np.cumsum(pc.fill_null(pc.binary_length(whole.column("text")), 0).to_numpy(False).astype(np.int64))
            cuts = np.searchsorted(size, np.arange(4 * BLOCK_BYTES, size[-1] if len(size) else 0, 4 * BLOCK_BYTES))
            for a, z in zip([0, *cuts.tolist()], [*cuts.tolist(), whole.num_rows]):
                if a == z:
                    continue
                batch = whole.slice(a, z - a)
                doc, piece, start, length, crc, body = [], [], [], [], [], []
                for d, ids in zip(batch.column("doc_id").to_pylist(), tok.encode([t or "" for t in batch.column("text").to_pylist()])):
                    ids = np.append(ids, end)
                    for k, at in enumerate(range(0, len(ids), capacity)):
                        part = ids[at : at + capacity].tobytes()
                        doc.append(d)
                        piece.append(k)
                        start.append(at)
                        length.append(len(part) // 4)
                        crc.append(zlib.crc32(part))
                        if with_ids:
                            body.append(part)
                cols = [pa.array(doc, pa.int64()), pa.array(piece, pa.int32()), pa.array(start, pa.int64()), pa.array(length, pa.int64()), pa.array(crc, pa.int64())]
                names = ["doc_id", "piece", "start", "length", "ids_crc32"]
                yield pa.RecordBatch.from_arrays(cols + [pa.array(body, pa.binary())] * with_ids, names=names + ["ids"] * with_ids)

    return docs.select("doc_id", "text").mapInArrow(run, PIECE_SCHEMA + ", ids binary" * with_ids)


def _knapsack(lengths: np.ndarray, value: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """Best value within each capacity, and the index of the length to take there (-1: leave one token empty)."""
    best, take = np.zeros(capacity + 1), np.full(capacity + 1, -1)
    upto = np.searchsorted(lengths, np.arange(capacity + 1), "right")
    for c in range(1, capacity + 1):
        best[c] = best[c - 1]
        if k := upto[c]:
            got = best[c - lengths[:k]] + value[:k]
            i = int(got.argmax())
            if got[i] > best[c]:
                best[c], take[c] = got[i], i
    return best, take


def _trace(take: np.ndarray, lengths: np.ndarray, c: int) -> dict[int, int]:
    out: dict[int, int] = {}
    while c > 0:
        i = int(take[c])
        if i < 0:
            c -= 1
        else:
            out[i] = out.get(i, 0) + 1
            c -= int(lengths[i])
    return out


def solve(lengths: np.ndarray, counts: np.ndarray, capacity: int = CAPACITY, rounds: int = 24, rate: float = 4.0, slack: float = 0.02, extra: int = 200) -> list[tuple[float, dict[int, int]]]:
    """A fractional cover of the histogram as [(times, {index of length: number of it})], by multiplicative weights.

    The first `rounds` rounds each cover an equal share more of every length's demand, `extra` rounds at most what is then
    missing. The knapsack prices all capacities at once, which gives for every length the best configuration that holds it;
    those worth at least 1 - slack of the best are used. A length's weight is its size, times the exponential of how far its
    coverage lags behind; lengths that are covered have none. Ends when no configuration is left that fills 1 - slack of the
    capacity.
    """
    total: dict[tuple, float] = {}
    covered = np.zeros(len(lengths))
    size = lengths / capacity
    for r in range(1, rounds + extra + 1):
        goal = min(1.0, r / rounds)
        rest = counts - covered
        weight = np.where(rest > 1e-9 * counts, size * np.exp(-rate * np.minimum(covered / counts - goal, 0.0)), 0.0)
        if not weight.any():
            break
        best, take = _knapsack(lengths, weight, capacity)
        used = 0.0
        for i in np.argsort(-(weight + best[capacity - lengths])):
            if weight[i] + best[capacity - lengths[i]] < (1 - slack) * best[capacity]:
                break
            if covered[i] >= counts[i] * goal:
                continue
            config = _trace(take, lengths, int(capacity - lengths[i]))
            config[i] = config.get(i, 0) + 1
            config = {k: min(n, int(counts[k])) for k, n in config.items()}
            if sum(int(lengths[k]) * n for k, n in config.items()) < (1 - slack) * capacity:
                continue
            times = min((counts[i] * goal - covered[i]) / config[i], min((counts[k] - covered[k]) / n for k, n in config.items()))
            if times <= 0:
                continue
            key = tuple(sorted(config.items()))
            total[key] = total.get(key, 0) + times
            used += times
            for k, n in config.items():
                covered[k] += times * n
        if r > rounds and used <= 1e-4 * (counts @ size):
            break
    return [(x, dict(key)) for key, x in sorted(total.items(), key=lambda kx: (-kx[1], kx[0]))]


def best_fit(lengths: np.ndarray, counts: np.ndarray, capacity: int, begun: list[tuple[int, dict[int, int]]] = ()) -> list[tuple[int, dict[int, int]]]:
    """Best-fit decreasing on a histogram, into the rooms of sequences already begun and new ones: bins alike in content are
    handled together, so counts don't matter for time."""
    bins: dict[int, list[list]] = {}  # by room left: [number of bins, content]
    for many, content in begun:
        bins.setdefault(capacity - sum(int(lengths[i]) * n for i, n in content.items()), []).append([many, content])
    add = lambda content, i, n: content | {i: content.get(i, 0) + n}
    left = counts.copy()
    for i in range(len(lengths) - 1, -1, -1):
        n, size = int(left[i]), int(lengths[i])
        for room in sorted(r for r in bins if r >= size) if n else ():
            if not n:
                break
            for kind in bins.pop(room):
                many, content = kind
                each = room // size
                full = min(many, n // each)
                if full:
                    bins.setdefault(room - each * size, []).append([full, add(content, i, each)])
                    n -= full * each
                if full < many and 0 < n:
                    bins.setdefault(room - n * size, []).append([1, add(content, i, n)])
                    full, n = full + 1, 0
                if full < many:
                    bins.setdefault(room, []).append([many - full, content])
        if n:
            each = capacity // size
            if n // each:
                bins.setdefault(capacity - each * size, []).append([n // each, {i: each}])
            if n % each:
                bins.setdefault(capacity - n % each * size, []).append([1, {i: n % each}])
    return [(many, content) for room in sorted(bins) for many, content in bins[room]]


def classes(lengths: np.ndarray, counts: np.ndarray, capacity: int) -> tuple[int, np.ndarray]:
    """Width of the classes of lengths, a power of two, and each length's class: it is at most class * width."""
    width = 1
    while 64 * width < capacity and counts.sum() < CLASS_PIECES * len(np.unique(-(-lengths // width))):
        width *= 2
    return width, -(-lengths // width)


def round_up(solution: list[tuple[float, dict[int, int]]], tops: np.ndarray, lengths: np.ndarray, counts: np.ndarray, capacity: int) -> tuple[list[tuple[int, dict[int, int]]], np.ndarray]:
    """Whole sequences made of a fractional cover of classes (`tops`: the largest length of each), and the counts left over.

    A configuration is used as often as its share and the remainder carried from those before it say. A slot takes the longest
    piece that is left up to its class, the last one the longest that fits. Sequences with more than EMPTY room are undone.
    """
    left, out, carry = counts.astype(np.int64).copy(), [], 0.0
    have = [int(i) for i in np.flatnonzero(left)]  # lengths that are left, ascending like their indices
    size = lengths.tolist()
    for x, config in solution:
        carry += x
        times = int(carry)
        carry -= times
        slots = [int(tops[k]) for k in sorted(config, reverse=True) for _ in range(config[k])]
        states = [(times, {}, capacity)] if times else []
        for nth, top in enumerate(slots, 1):
            after = []
            for many, content, room in states:
                while many:
                    at = bisect_right(have, room if nth == len(slots) else min(room, top), key=size.__getitem__) - 1
                    if at < 0:
                        after.append((many, content, room))
                        break
                    i = have[at]
                    n = min(many, int(left[i]))
                    left[i] -= n
                    if not left[i]:
                        have.pop(at)
                    after.append((n, content | {i: content.get(i, 0) + 1}, room - size[i]))
                    many -= n
            states = after
        for many, content, room in states:
            if room <= EMPTY * capacity:
                out.append((many, content))
            else:
                for i, n in content.items():
                    if not left[i]:
                        insort(have, i)
                    left[i] += many * n
    return out, left


def plan_bins(lengths: np.ndarray, counts: np.ndarray, capacity: int = CAPACITY) -> tuple[list[tuple[int, dict[int, int]]], float]:
    """Whole configurations that hold each piece once, and the share of tokens that the program placed: its solution is rounded,
    the rest goes to best fit. Of several shares of the solution the largest counts that takes the fewest sequences."""
    width, of = classes(lengths, counts, capacity)
    kinds, inverse = np.unique(of, return_inverse=True)
    solution = solve(kinds, np.bincount(inverse, counts).astype(np.int64), capacity // width)
    tops = lengths[np.searchsorted(inverse, np.arange(len(kinds)), "right") - 1]
    tried = []
    for share in SHARES:
        begun, left = round_up([(share * x, config) for x, config in solution], tops, lengths, counts, capacity)
        tried.append((best_fit(lengths, left, capacity, begun), 1 - float((lengths * left).sum() / (lengths * counts).sum())))
    return min(tried, key=lambda plan: sum(n for n, _ in plan[0]))


@dataclass
class Plan:
    """For each length, ranges of ranks: ranks from `low` go to sequences from `base`, `each` to one, from `offset` on."""

    key: np.ndarray
    base: np.ndarray
    each: np.ndarray
    offset: np.ndarray
    sequences: int


def make_plan(lengths: np.ndarray, counts: np.ndarray, capacity: int = CAPACITY) -> Plan:
    """The plan's size depends on the number of distinct lengths (at most the capacity), not on the corpus."""
    used, rows, base = np.zeros(len(lengths), np.int64), [], 0
    for times, config in plan_bins(lengths, counts, capacity)[0]:
        at = 0
        for i, n in sorted(config.items(), reverse=True):
            rows.append((int(lengths[i]), int(used[i]), base, n, at))
            used[i] += times * n
            at += n * int(lengths[i])
        base += times
    assert (used == counts).all()
    a = np.array(sorted(rows), np.int64).reshape(-1, 5)
    return Plan((a[:, 0] << 44) | a[:, 1], a[:, 2], a[:, 3], a[:, 4], base)


def _ranked(p: DataFrame, hist: list) -> DataFrame:
    """Adds `rank`: 0, 1, ... among the pieces of each length, without bringing a length into one task.

    Pieces of a length are dealt into groups of about the square root of all pieces; ranks are counted within groups, and
    groups are added up within lengths, so neither window sees more than about that many rows.
    """
    spark = p.sparkSession
    group = max(200, int(sum(n for _, n in hist) ** 0.5))
    sizes = F.broadcast(spark.createDataFrame([(int(a), int(-(-n // group))) for a, n in hist], "length long, groups long"))
    p = p.join(sizes, "length").withColumn("g", F.pmod(F.xxhash64("doc_id", "piece", "start"), F.col("groups"))).drop("groups")
    sums = p.groupBy("length", "g").agg(F.count("*").alias("n"))
    before = sums.select("length", "g", (F.sum("n").over(Window.partitionBy("length").orderBy("g")) - F.col("n")).alias("before"))
    inner = F.row_number().over(Window.partitionBy("length", "g").orderBy("doc_id", "piece")) - 1
    return p.withColumn("inner", inner).join(before, ["length", "g"]).withColumn("rank", F.col("before") + F.col("inner")).drop("before", "inner", "g")


def place(p: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """Adds sequence_id and offset to a table of pieces, which must be one that can be read again (see `pack`)."""
    hist = sorted((r["length"], r["n"]) for r in p.groupBy("length").agg(F.count("*").alias("n")).collect())
    names = [c for c in p.columns]
    if not hist:
        return p.withColumn("sequence_id", F.lit(0).cast("long")).withColumn("offset", F.lit(0).cast("long"))
    plan = make_plan(np.array([a for a, _ in hist]), np.array([n for _, n in hist]), capacity)
    shared = p.sparkSession.sparkContext.broadcast(plan)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        q = shared.value
        for batch in batches:
            length, rank = batch.column("length").to_numpy(), batch.column("rank").to_numpy()
            i = np.searchsorted(q.key, (length << 44) | rank, "right") - 1
            along = rank - (q.key[i] & ((1 << 44) - 1))
            yield pa.RecordBatch.from_arrays([batch.column(c) for c in names] + [pa.array(q.base[i] + along // q.each[i]), pa.array(q.offset[i] + along % q.each[i] * length)], names=names + ["sequence_id", "offset"])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in p.schema.fields) + ", sequence_id long, offset long"
    return _ranked(p, hist).select(*names, "rank").mapInArrow(run, schema)


def pack(docs: DataFrame, path: str | None = None, capacity: int = CAPACITY, with_ids: bool = False) -> DataFrame:
    """Pack all documents (doc_id, text) into sequences of at most `capacity` tokens.

    Null and empty texts have just the end id. Repeated rows are packed each. Pieces are tokenised once and written to
    the shared folder; only the histogram (at most `capacity` rows) comes to the driver.
    """
    return place(materialise(pieces(docs, path or tokenizer_path(), capacity, with_ids=with_ids), "pieces"), capacity)
