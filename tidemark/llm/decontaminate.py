"""Benchmark decontamination: words and word pairs as seeds find where test items may stand in documents, and
Smith-Waterman alignment over words scores each place, so that edited and paraphrased copies are found as well.

Of each item the rarest seeds are kept until no alignment without a hit on one of them can reach the least score, so seeds
lose nothing: how often an item is leaked decides what a scan costs, never what it finds.

The benchmark is taken in blocks of bounded size, which are broadcast; documents are only scanned, never shuffled.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .kernels import ALNUM, SCAN_BYTES, blocks, lower_ascii, ngram_hash, prefix_hash, span_hash, words
from .shared import materialise

#: Items of fewer words than this say little: by default they must also share SHORT_RUN words in a row with a document (or
#: stand whole), as an item of two words would else stand wherever one of them does. `short_run=0` turns that off.
SHORT, SHORT_RUN = 8, 3
#: Words of benchmark text in one broadcast block (about 90 bytes each with their seeds); more items make more blocks.
BLOCK_WORDS = 500_000
#: An alignment counts when it reaches this share of the item's own score.
LEAST_SCORE = 0.5
MATCH, MISMATCH, GAP = 2, 1, 1
#: Blocks of the benchmark that one scan of `clean` searches; with more, what is left is written between scans.
BLOCKS_AT_ONCE = 4
_TABLE_BITS = 22


@dataclass
class Items:
    """Items of one block: their word hashes, and the sorted distinct seeds with where they stand."""

    ids: list[int | None]
    words: list[np.ndarray]
    seeds: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]  # by n: seeds; first place; item and place of each


def text_words(text: str) -> np.ndarray:
    b = lower_ascii(np.frombuffer(text.encode(), np.uint8))
    s, e, _ = words(b, np.array([0, len(b)]), ALNUM)
    return span_hash(prefix_hash(b), s, e)


def make_items(rows: list[tuple[int | None, str]], short_run: int = SHORT_RUN) -> Items:
    """Items without words match nothing. Seeds of short items are runs of `short_run` words, or (0) those of all items."""
    kept = [(i, w) for i, t in rows if len(w := text_words(t or ""))]
    found: dict[int, list] = {}
    for k, (_, w) in enumerate(kept):
        for n in (1, 2) if len(w) >= SHORT or not short_run else (min(short_run, len(w)),):
            g = ngram_hash(w, n)
            found.setdefault(n, []).append(np.stack([g, np.full(len(g), k, np.uint64), np.arange(len(g), dtype=np.uint64)], 1))
    seeds = {}
    for n, parts in found.items():
        a = np.concatenate(parts)
        a = a[np.argsort(a[:, 0], kind="stable")]
        distinct, first = np.unique(a[:, 0], return_index=True)
        seeds[n] = (distinct, np.append(first, len(a)), a[:, 1].astype(np.int64), a[:, 2].astype(np.int64))
    return Items([i for i, _ in kept], [w for _, w in kept], seeds)


def _finder(items: Items):
    """find(hashes, row of each word) -> for each n the places of seeds and their numbers; a table of bits goes first."""
    tables = {}
    for n, (distinct, *_rest) in items.seeds.items():
        table = np.zeros(1 << _TABLE_BITS, bool)
        table[distinct >> np.uint64(64 - _TABLE_BITS)] = True
        tables[n] = table

    def find(h: np.ndarray, row: np.ndarray):
        for n, (distinct, *_rest) in items.seeds.items():
            g = ngram_hash(h, n)
            at = np.flatnonzero(tables[n][g >> np.uint64(64 - _TABLE_BITS)])
            at = at[row[at] == row[at + n - 1]]
            i = np.minimum(np.searchsorted(distinct, g[at]), len(distinct) - 1)
            hit = distinct[i] == g[at]
            yield n, at[hit], i[hit]

    return find


def _words_of(b: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    low = lower_ascii(b)
    s, e, first = words(low, off, ALNUM)
    return span_hash(prefix_hash(low), s, e), np.repeat(np.arange(len(off) - 1), np.diff(first)), first


def seed_frequencies(docs: DataFrame, items: Items) -> dict[int, np.ndarray]:
    """For each seed the number of documents that hold it, over the whole corpus.

    Each task adds up its documents; what is shuffled is one row for each task, n and seed that it saw.
    """
    shared = docs.sparkSession.sparkContext.broadcast(items)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        find = _finder(own)
        df = {n: np.zeros(len(s[0]), np.int64) for n, s in own.seeds.items()}
        for batch in batches:
            for _, _, b, off in blocks(batch.column("text"), SCAN_BYTES):
                h, row, _ = _words_of(b, off)
                for n, at, i in find(h, row):
                    size = len(df[n])
                    df[n] += np.bincount(np.unique(row[at] * size + i) % size, minlength=size)
        ns, seed, count = [], [], []
        for n, c in df.items():
            at = np.flatnonzero(c)
            ns += [n] * len(at)
            seed += at.tolist()
            count += c[at].tolist()
        yield pa.RecordBatch.from_arrays([pa.array(ns, pa.int32()), pa.array(seed, pa.int64()), pa.array(count, pa.int64())], names=["n", "seed", "docs"])

    got = docs.select("text").mapInArrow(run, "n int, seed long, docs long").groupBy("n", "seed").agg(F.sum("docs").alias("docs")).toArrow()
    ns, seed, count = (got.column(c).to_numpy() for c in ("n", "seed", "docs"))
    out = {n: np.zeros(len(s[0]), np.int64) for n, s in items.seeds.items()}
    for n, c in out.items():
        c[seed[ns == n]] = count[ns == n]
    return out


def best_missed(lengths: np.ndarray, word: np.ndarray, pair: np.ndarray) -> np.ndarray:
    """The best score of each item's alignments, with any text, that hit no kept seed.

    Items lie end to end; `word` and `pair` say whether the seed that starts at a place is kept. A kept word can't be matched
    without a hit; words of a kept pair can't both be matched without one, unless a word stands between them (a gap).
    """
    by = np.argsort(-lengths, kind="stable")
    start, size = (np.cumsum(lengths) - lengths)[by], lengths[by]
    low = np.iinfo(np.int64).min // 2
    on, off, best = np.full(len(by), low), np.full(len(by), low), np.zeros(len(by), np.int64)
    for p in range(int(size[0]) if len(size) else 0):
        m = int(np.searchsorted(-size, -p, "left"))  # items with more than p words
        at = start[:m] + p
        before = np.maximum(off[:m], on[:m] - GAP * pair[at - 1] if p else low)
        new = np.where(word[at], low, MATCH + np.maximum(before, 0))
        off[:m] = np.maximum(np.maximum(off[:m], on[:m]) - min(MISMATCH, GAP), low)
        on[:m] = new
        best[:m] = np.maximum(best[:m], new)
    out = np.empty_like(best)
    out[by] = best
    return out


def keep_seeds(items: Items, df: dict[int, np.ndarray], least: float) -> Items:
    """The items with as few of their rarest seeds as every alignment of at least the score `least` must hit.

    Short items keep all. Rarity decides only which seeds are cheap: whatever stands in many documents, the item itself
    among it, the kept ones are always enough.
    """
    if not {1, 2} <= items.seeds.keys():
        return items
    size = np.array([len(w) for w in items.words], np.int64)
    first = np.cumsum(size) - size
    parts = []
    for n in (1, 2):
        distinct, cut, item, place = items.seeds[n]
        seed = np.repeat(np.arange(len(distinct)), np.diff(cut))
        parts.append(np.stack([item, df[n][seed], np.full(len(seed), n), place, np.arange(len(seed))], 1))
    a = np.concatenate(parts)
    a = a[np.lexsort((a[:, 3], a[:, 2], a[:, 1], a[:, 0]))]
    item, at = a[:, 0], first[a[:, 0]] + a[:, 3]
    number = np.bincount(item, minlength=len(size))
    rank = np.arange(len(a)) - (np.cumsum(number) - number)[item]
    low, high = np.zeros(len(size), np.int64), number.copy()  # the least number of seeds that is enough lies in [low, high]
    while (low < high).any():
        middle = (low + high) // 2
        use = rank < middle[item]
        flags = []
        for n in (1, 2):
            flag = np.zeros(int(size.sum()), bool)
            flag[at[use & (a[:, 2] == n)]] = True
            flags.append(flag)
        enough = best_missed(size, *flags) < least * MATCH * size
        high = np.where(enough, middle, high)
        low = np.where(enough, low, np.minimum(middle + 1, high))
    use, seeds = rank < high[item], dict(items.seeds)
    for n in (1, 2):
        distinct, cut, of, place = items.seeds[n]
        ok = np.zeros(len(of), bool)
        ok[a[use & (a[:, 2] == n), 4]] = True
        kept, begin = np.unique(np.repeat(np.arange(len(distinct)), np.diff(cut))[ok], return_index=True)
        seeds[n] = (distinct[kept], np.append(begin, ok.sum()), of[ok], place[ok])
    return Items(items.ids, items.words, {n: s for n, s in seeds.items() if len(s[0])})


def align(item: np.ndarray, region: np.ndarray) -> tuple[int, int]:
    """Smith-Waterman score of two word sequences, and where it ends in the region (word after the last)."""
    h, best, end = np.zeros(len(region) + 1, np.int64), 0, 0
    ramp = np.arange(len(region) + 1) * GAP
    for w in item:
        new = np.zeros_like(h)
        np.maximum(h[:-1] + np.where(region == w, MATCH, -MISMATCH), h[1:] - GAP, out=new[1:])
        np.maximum(new, 0, out=new)
        new = np.maximum.accumulate(new + ramp) - ramp
        h = new
        if (top := int(h.max())) > best:
            best, end = top, int(h.argmax())
    return best, end


def regions(item: np.ndarray, h: np.ndarray, start: int, stop: int, least: float) -> Iterator[tuple[int, int]]:
    """Parts of h[start:stop] that hold every alignment of at least the score `least`.

    An alignment of M matches over D words of a document scores at most 3 M - D (each other word costs one), so D is at most
    3 m - least, and a part is left out only if too few of its words are words of the item.
    """
    own = np.unique(item)
    x = h[start:stop]
    inside = own[np.minimum(np.searchsorted(own, x), len(own) - 1)] == x
    run = np.zeros(len(x) + 1, np.int64)
    np.cumsum(np.where(inside, MATCH, -1), out=run[1:])
    width = max(1, int((MATCH + 1) * len(item) - least))
    padded = np.concatenate([np.full(width, np.iinfo(np.int64).max), run])
    lowest = np.lib.stride_tricks.sliding_window_view(padded, width + 1).min(1) if (run - np.minimum.accumulate(run)).max() >= least else run
    ends = np.flatnonzero((run - lowest >= least) & (run > lowest))
    a = 0
    for z in range(1, len(ends) + 1):
        if z == len(ends) or ends[z] - ends[z - 1] > width:
            yield start + max(0, int(ends[a]) - width), start + int(ends[z - 1])
            a = z


def leak(item: np.ndarray, h: np.ndarray, offsets: np.ndarray, least: float) -> tuple[float, int, int] | None:
    """(share of the item's own score, first word, word after the last) of the item's best place, if that reaches `least`.

    offsets: places in the document less places in the item of its hits, ascending. With the score wanted an alignment has at
    most 2 m - score words between, so it lies within that of a hit's offset; places that touch are looked at together.
    """
    m, best = len(item), (0.0, 0, 0)
    need = least * MATCH * m
    spare = max(0, int(MATCH * m - need))
    a = 0
    for z in range(1, len(offsets) + 1):
        if z == len(offsets) or offsets[z] - offsets[z - 1] > m + 2 * spare:
            for start, stop in regions(item, h, max(0, int(offsets[a]) - spare), min(len(h), int(offsets[z - 1]) + m + spare), need):
                score, end = align(item, h[start:stop])
                if score / (MATCH * m) > best[0]:
                    best = (score / (MATCH * m), max(0, start + end - m), start + end)
            a = z
    return best if best[0] >= least and best[0] > 0 else None


PAIR_SCHEMA = "doc_id long, item_id long, score double, first_word long, end_word long"


def find_leaks(docs: DataFrame, items: Items, least: float = LEAST_SCORE) -> DataFrame:
    """A row for each document and item that stands in it; one scan."""
    shared = docs.sparkSession.sparkContext.broadcast(items)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        find = _finder(own)
        for batch in batches:
            rows = []
            for lo, _, b, off in blocks(batch.column("text"), SCAN_BYTES):
                for row, got in _block_leaks(own, find, b, off, least):
                    rows += [(batch.column("doc_id")[lo + row].as_py(), own.ids[k], s, a, z) for k, s, a, z in got]
            cols = list(zip(*rows)) or [[]] * 5
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.int64(), pa.float64(), pa.int64(), pa.int64()))], names=["doc_id", "item_id", "score", "first_word", "end_word"])

    return docs.select("doc_id", "text").mapInArrow(run, PAIR_SCHEMA)


def _block_leaks(items: Items, find, b: np.ndarray, off: np.ndarray, least: float):
    h, row, first = _words_of(b, off)
    parts = [np.zeros((0, 3), np.int64)]
    for n, at, i in find(h, row):
        _, cut, item, place = items.seeds[n]
        many = cut[i + 1] - cut[i]
        x = np.repeat(cut[i] - (np.cumsum(many) - many), many) + np.arange(many.sum())
        at = np.repeat(at, many)
        parts.append(np.stack([row[at], item[x], at - first[row[at]] - place[x]], 1))
    hits = np.concatenate(parts)
    hits = hits[np.lexsort((hits[:, 2], hits[:, 1], hits[:, 0]))]
    new = np.flatnonzero(np.append(True, (hits[1:, :2] != hits[:-1, :2]).any(1))) if len(hits) else np.zeros(0, np.int64)
    by_row: dict[int, list] = {}
    for lo, hi in zip(new.tolist(), np.append(new[1:], len(hits)).tolist()):
        r, k = int(hits[lo, 0]), int(hits[lo, 1])
        if got := leak(items.words[k], h[first[r] : first[r + 1]], hits[lo:hi, 2], least):
            by_row.setdefault(r, []).append((k, *got))
    yield from by_row.items()


def item_blocks(benchmark: DataFrame, block_words: int = BLOCK_WORDS, short_run: int = SHORT_RUN) -> Iterator[Items]:
    """The benchmark in blocks whose size is bounded; rows come to the driver a partition at a time."""
    rows, size = [], 0
    for r in benchmark.select("item_id", "text").where("text is not null").orderBy("item_id", "text").toLocalIterator():
        rows.append((r["item_id"], r["text"]))
        size += len(r["text"]) // 2 + 1
        if size >= 4 * block_words:
            yield make_items(rows, short_run)
            rows, size = [], 0
    if rows:
        yield make_items(rows, short_run)


def decontaminate(docs: DataFrame, benchmark: DataFrame, least: float = LEAST_SCORE, short_run: int = SHORT_RUN) -> DataFrame:
    """Pairs of contaminated documents and benchmark items, with the alignment's score (1: verbatim) and place in words.

    A scan of the documents for each block of the benchmark counts its seeds over the whole corpus, another searches it.
    With `short_run=0` the score alone decides for items of any length; else see SHORT_RUN.
    Null or empty texts, items without words and empty tables give no pairs; repeated rows are reported each, and so are
    documents and items with a null id.
    """
    out = None
    for items in item_blocks(benchmark, short_run=short_run):
        found = find_leaks(docs, keep_seeds(items, seed_frequencies(docs, items), least), least)
        out = found if out is None else out.unionByName(found)
    return docs.sparkSession.createDataFrame([], PAIR_SCHEMA) if out is None else out


def clean(docs: DataFrame, benchmark: DataFrame, least: float = LEAST_SCORE, short_run: int = SHORT_RUN) -> DataFrame:
    """The rows of `docs` in which no item stands, with their columns. An item needs no id to be found.

    Null and empty texts stay, and so does everything if the benchmark is empty; repeated rows stay or go alike. Seeds of each
    block of the benchmark are counted over all of `docs` in a scan of its own. A scan searches BLOCKS_AT_ONCE blocks, so what
    is broadcast at once is bounded; before the next what is left is written to shared storage.
    """
    left, held = docs, []
    for items in item_blocks(benchmark, short_run=short_run):
        if len(held) == BLOCKS_AT_ONCE:
            left = materialise(left, "clean")
            while held:
                held.pop().unpersist()
        held.append(docs.sparkSession.sparkContext.broadcast(keep_seeds(items, seed_frequencies(docs, items), least)))

        def run(batches: Iterator[pa.RecordBatch], shared=held[-1]) -> Iterator[pa.RecordBatch]:
            own = shared.value
            find = _finder(own)
            for batch in batches:
                keep = np.ones(batch.num_rows, bool)
                for lo, _, b, off in blocks(batch.column("text"), SCAN_BYTES):
                    for row, _found in _block_leaks(own, find, b, off, least):
                        keep[lo + row] = False
                yield batch.filter(pa.array(keep))

        left = left.mapInArrow(run, left.schema)
    return left
