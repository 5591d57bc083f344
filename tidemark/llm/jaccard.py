"""N-gram Jaccard join by vertical partitioning, and the components of its links.

Every distinct word shingle of every document goes to the fragment of the n-gram space that its hash falls in, where its
document frequency is counted. Frequencies give the order of prefixes, rarest first: two sets that reach the threshold share
an n-gram of both prefixes. Documents that share prefix n-grams form blocks, and blocks are dealt into cells of bounded size.

The n-grams of a cell's documents are cut into fragments of the global order (that of their hashes, which deals them evenly).
Each fragment of each cell is a unit of work of its own, which counts the partial overlaps of the cell's pairs; the counts of
all fragments are then summed per pair and held against the threshold.

Equal sets are one class from the start. Cells of a large block share some pivots, which unite what is alike. What is then not
with the main part of its block is put only to those cells that hold one of its prefix n-grams and sets of like size, so a block
that is long chains of documents without links costs what its shared n-grams cost, not the square of its size.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .kernels import SPACE, U64, blocks, lower_ascii, mix, ngram_hash, prefix_hash, span_hash, words
from .shared import Scratch, components, materialise

WORDS = 5
#: Links need 100 * intersection >= PERCENT * union.
PERCENT = 80
#: Fragments of the n-gram order, in which partial overlaps are counted apart.
FRAGMENTS = 4
#: Documents and n-grams of a cell, and pivots for each length band of a block that has several cells.
CELL, CELL_GRAMS, PIVOTS = 128, 2_000_000, 12
#: Leftover documents that are put to a cell at once.
ASKED = 512
#: N-grams of a fragment that are counted at once.
COLUMNS = 8192
_ROWS = 60_000
_DOC = np.dtype([("doc_id", "<i8"), ("n", "<u4"), ("s1", "<u8"), ("s2", "<u8"), ("null", "u1")])
_SHIFT = U64(16)


def _pack48(h: np.ndarray) -> bytes:
    return np.ascontiguousarray(h.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :6]).tobytes()


def _unpack48(b: bytes) -> np.ndarray:
    out = np.zeros((len(b) // 6, 8), np.uint8)
    out[:, :6] = np.frombuffer(b, np.uint8).reshape(-1, 6)
    return out.view("<u8").ravel().astype(U64)


def shingle_sets(b: np.ndarray, off: np.ndarray, width: int = WORDS) -> tuple[np.ndarray, np.ndarray]:
    """Row and 48-bit hash of each distinct shingle of each document of a block, sorted by row, then hash."""
    low = lower_ascii(b)
    s, e, first = words(low, off, SPACE)
    h, n_words = span_hash(prefix_hash(low), s, e), np.diff(first)
    grams = ngram_hash(h, width)
    row = np.repeat(np.arange(len(n_words)), n_words)
    ok = row[: len(grams)] == row[width - 1 :][: len(grams)] if len(grams) else np.zeros(0, bool)
    rows, hashes = [row[: len(grams)][ok]], [grams[ok] >> _SHIFT]
    for r in np.flatnonzero((n_words > 0) & (n_words < width)):
        rows.append(np.array([r]))
        hashes.append(ngram_hash(h[first[r] : first[r + 1]], int(n_words[r])) >> _SHIFT)
    rows, hashes = np.concatenate(rows), np.concatenate(hashes)
    order = np.lexsort((hashes, rows))
    rows, hashes = rows[order], hashes[order]
    new = np.ones(len(rows), bool)
    new[1:] = (rows[1:] != rows[:-1]) | (hashes[1:] != hashes[:-1])
    return rows[new], hashes[new]


def _fragments(buckets: int, width: int):
    """Documents to blobs: for each block and fragment the sorted (hash, row) entries, and one blob that describes the rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        task, seq = TaskContext.get().partitionId(), 0
        for whole in batches:
            for part in range(0, whole.num_rows, _ROWS):
                batch = whole.slice(part, _ROWS)
                ids = batch.column("doc_id")
                missing, ids = ids.is_null().to_numpy(False), ids.fill_null(0).to_numpy()
                for lo, hi, b, off in blocks(batch.column("text")):
                    chunk = (task << 32) | seq
                    seq += 1
                    row, h = shingle_sets(b, off, width)
                    docs = np.zeros(hi - lo, _DOC)
                    docs["doc_id"], docs["null"] = ids[lo:hi], missing[lo:hi]
                    docs["n"] = np.bincount(row, minlength=hi - lo)
                    # a set's signature: two sums of its mixed hashes, exact in 64 bits
                    at = np.searchsorted(row, np.arange(hi - lo + 1))
                    for name, salt in (("s1", 0x9E37), ("s2", 0xC2B2)):
                        run_sum = np.concatenate([np.zeros(1, U64), np.cumsum(mix(h + U64(salt << 48)))])
                        docs[name] = run_sum[at[1:]] - run_sum[at[:-1]]
                    order = np.argsort(h, kind="stable")
                    h, row = h[order], row[order].astype("<u2")
                    cut = np.searchsorted(h, (np.arange(1, buckets, dtype=object) * (1 << 48) // buckets).astype(U64))
                    cut = np.concatenate([[0], cut, [len(h)]])
                    full = np.flatnonzero(np.diff(cut))
                    blob = [_pack48(h[cut[i] : cut[i + 1]]) + row[cut[i] : cut[i + 1]].tobytes() for i in full]
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([*full.tolist(), chunk % buckets], pa.int32()), pa.array([chunk] * (len(full) + 1), pa.int64()), pa.array([False] * len(full) + [True]), pa.array([*blob, docs.tobytes()], pa.binary())],
                        names=["bucket", "chunk", "is_docs", "blob"],
                    )

    return run


def _frequencies(f: pd.DataFrame) -> pd.DataFrame:
    """One fragment: counts documents of each n-gram and sends those in two and more back to the blocks they came from."""
    is_docs = f["is_docs"].to_numpy(bool)
    passed = f[is_docs][["chunk", "is_docs", "blob"]]
    own = f[~is_docs]
    if not len(own):
        return passed
    sizes = np.array([len(x) // 8 for x in own["blob"]])
    h = np.concatenate([_unpack48(x[: 6 * n]) for x, n in zip(own["blob"], sizes)])
    row = np.concatenate([np.frombuffer(x, "<u2", offset=6 * n) for x, n in zip(own["blob"], sizes)])
    order = np.argsort(h)
    new = np.ones(len(h), bool)
    new[1:] = h[order][1:] != h[order][:-1]
    starts = np.flatnonzero(new)
    df = np.empty(len(h), "<u4")
    df[order] = np.repeat(np.diff(np.append(starts, len(h))), np.diff(np.append(starts, len(h))))
    chunks, blobs, at = [], [], 0
    for chunk, n in zip(own["chunk"], sizes):
        ok = df[at : at + n] > 1
        if ok.any():
            chunks.append(chunk)
            blobs.append(_pack48(h[at : at + n][ok]) + row[at : at + n][ok].tobytes() + df[at : at + n][ok].tobytes())
        at += n
    return pd.concat([passed, pd.DataFrame({"chunk": np.array(chunks, np.int64), "is_docs": False, "blob": blobs})])


def _prefixes(f: pd.DataFrame) -> pd.DataFrame:
    """One block of documents: sizes and signatures; for those whose prefix holds shared n-grams, these and all shared ones."""
    is_docs = f["is_docs"].to_numpy(bool)
    docs = np.frombuffer(f["blob"][is_docs].iloc[0], _DOC)
    own = [(x, len(x) // 12) for x in f["blob"][~is_docs]]
    h = np.concatenate([_unpack48(x[: 6 * n]) for x, n in own]) if own else np.zeros(0, U64)
    row = np.concatenate([np.frombuffer(x, "<u2", n, 6 * n) for x, n in own]).astype(np.int64) if own else np.zeros(0, np.int64)
    df = np.concatenate([np.frombuffer(x, "<u4", n, 8 * n) for x, n in own]) if own else np.zeros(0, np.uint32)
    order = np.lexsort((h, df, row))
    h, row = h[order], row[order]
    at = np.searchsorted(row, np.arange(len(docs) + 1))
    n = docs["n"].astype(np.int64)
    take = n - (PERCENT * n + 99) // 100 + 1 - (n - np.diff(at))  # prefix entries that other documents have too
    prefix, common = [None] * len(docs), [None] * len(docs)
    inner = np.array([i * (1 << 48) // FRAGMENTS for i in range(1, FRAGMENTS)], U64)
    for i in np.flatnonzero((take > 0) & (n > 0) & (docs["null"] == 0)):
        mine = h[at[i] : at[i + 1]]
        prefix[i] = mine[: take[i]].astype(np.int64)
        mine = np.sort(mine)
        cut = [0, *np.searchsorted(mine, inner).tolist(), len(mine)]
        common[i] = [_pack48(mine[a:z]) for a, z in zip(cut, cut[1:])]
    ids = pd.array(docs["doc_id"], "Int64")
    ids[docs["null"] == 1] = pd.NA
    return pd.DataFrame({"doc_id": ids, "n": n, "s1": docs["s1"].view("<i8"), "s2": docs["s2"].view("<i8"), "grams": np.diff(at), "prefix": prefix, "common": common})


_SET_SCHEMA = "doc_id long, n long, s1 long, s2 long, grams long, prefix array<long>, common array<binary>"


def sets(docs: DataFrame, width: int = WORDS) -> DataFrame:
    """Each document's number of shingles and set signature; for possible partners the shared n-grams of the prefix, and all by
    fragment."""
    buckets = 4 * int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    cut = docs.select("doc_id", "text").mapInArrow(_fragments(buckets, width), "bucket int, chunk long, is_docs boolean, blob binary")
    counted = cut.groupBy("bucket").applyInPandas(_frequencies, "chunk long, is_docs boolean, blob binary")
    return counted.groupBy("chunk").applyInPandas(_prefixes, _SET_SCHEMA)


def _forest(i: np.ndarray, j: np.ndarray, ids: np.ndarray) -> list[tuple[int, int]]:
    up, out = {}, []

    def root(x):
        while up.setdefault(x, x) != x:
            up[x] = x = up[up[x]]
        return x

    for a, b in zip(ids[i].tolist(), ids[j].tolist()):
        x, y = root(a), root(b)
        if x != y:
            up[max(x, y)] = min(x, y)
            out.append((a, b))
    return out


def overlaps(grams: list[np.ndarray], split: int) -> np.ndarray:
    """Numbers of n-grams that pairs of sets share: the first `split` with the others, or (0) all with all."""
    m = len(grams)
    a, b = (slice(0, split), slice(split, m)) if split else (slice(0, m), slice(0, m))
    row = np.repeat(np.arange(m), [len(g) for g in grams])
    vocabulary, col, times = np.unique(np.concatenate(grams), return_inverse=True, return_counts=True)
    ok = times[col] > 1
    row, col = row[ok], (np.cumsum(times > 1) - 1)[col[ok]]
    order = np.argsort(col, kind="stable")
    row, col = row[order], col[order]
    size = int(col[-1]) + 1 if len(col) else 0
    out = np.zeros((len(range(m)[a]), len(range(m)[b])), np.float32)
    for lo in range(0, size, COLUMNS):
        s, e = np.searchsorted(col, [lo, lo + COLUMNS])
        x = np.zeros((m, min(COLUMNS, size - lo)), np.float32)
        x[row[s:e], col[s:e] - lo] = 1
        out += x[a] @ x[b].T
    return np.rint(out).astype("<u4")


_PARTIAL = pa.schema([("deal", pa.int32()), ("cell", pa.int64()), ("members", pa.binary()), ("overlap", pa.binary())])
_MEMBER = np.dtype([("rep", "<i8"), ("n", "<i8"), ("side", "u1")])


def _by_cell(cell: np.ndarray) -> Iterator[np.ndarray]:
    order = np.argsort(cell, kind="stable")
    yield from np.split(order, np.flatnonzero(np.diff(cell[order])) + 1) if len(order) else ()


def count_partial(table: pa.Table) -> pa.Table:
    """One fragment of a deal's cells: each cell's members (in an order that is the same in all fragments) and the numbers of
    n-grams that its pairs share there."""
    cell, rep, side, n = (table.column(c).to_numpy() for c in ("cell", "rep", "side", "n"))
    out, deal = [], table.column("deal")[0].as_py()
    for own in _by_cell(cell):
        own = own[np.lexsort((rep[own], ~side[own]))]
        own = own[np.append(True, (np.diff(rep[own]) != 0) | (side[own[1:]] != side[own[:-1]]))]
        split = int(side[own].sum())
        if len(own) < 2 or split == len(own):
            continue
        members = np.zeros(len(own), _MEMBER)
        members["rep"], members["n"], members["side"] = rep[own], n[own], side[own]
        out.append((deal, int(cell[own[0]]), members.tobytes(), overlaps([_unpack48(x.as_py()) for x in table.column("grams").take(own)], split).tobytes()))
    cols = list(zip(*out)) or [[]] * 4
    return pa.Table.from_arrays([pa.array(c, f.type) for c, f in zip(cols, _PARTIAL)], schema=_PARTIAL)


def sum_partial(table: pa.Table) -> pa.Table:
    """Links of a deal's cells: partial overlaps are summed per pair over the fragments. Of each cell's pairs that reach the
    threshold a spanning forest is given. Members of `side` are compared with the others only, if there are any, else all with
    all; a document may be on both sides and isn't compared with itself."""
    links, members, counts = [], table.column("members"), table.column("overlap")
    for own in _by_cell(table.column("cell").to_numpy()):
        f = np.frombuffer(members[int(own[0])].as_py(), _MEMBER)
        m, split = len(f), int(f["side"].sum())
        a, b = (slice(0, split), slice(split, m)) if split else (slice(0, m), slice(0, m))
        ids, n = f["rep"], f["n"]
        o = sum(np.frombuffer(counts[int(i)].as_py(), "<u4").astype(np.int64) for i in own).reshape(len(ids[a]), len(ids[b]))
        i, j = np.nonzero((100 * o >= PERCENT * (n[a][:, None] + n[b][None, :] - o)) & (ids[a][:, None] != ids[b][None, :]))
        links += _forest(i, split + j, ids)
    return pa.table({"a": pa.array([x for x, _ in links], pa.int64()), "b": pa.array([y for _, y in links], pa.int64())})


def compare(cells: DataFrame, deals: int) -> DataFrame:
    """Spanning links (a, b) of cells: rows (cell, rep, n, side, common). Units of work are a fragment of a deal of cells, then a
    deal; there are as many deals as keep both small."""
    unit = cells.withColumn("deal", F.pmod(F.xxhash64("cell"), F.lit(deals)).cast("int")).select("deal", "cell", "rep", "n", "side", F.posexplode("common").alias("fragment", "grams"))
    partial = unit.groupBy("deal", "fragment").applyInArrow(count_partial, "deal int, cell long, members binary, overlap binary")
    return partial.groupBy("deal").applyInArrow(sum_partial, _LINKS)


_LINKS = "a long, b long"


def _deals(spark, grams: int | None) -> int:
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-(grams or 0) // CELL_GRAMS))


def _links(d: DataFrame, scratch: Scratch) -> DataFrame:
    """Spanning links of all classes that reach the threshold with another; `d` is the table of `sets`, read again."""
    spark = d.sparkSession
    first = d.where("prefix is not null").groupBy("s1", "s2").agg(F.min_by(F.struct("n", "grams", "prefix", "common"), "doc_id").alias("x"), F.min("doc_id").alias("rep"))
    c = scratch.keep(first.select("rep", "x.n", "x.grams", "x.prefix", "x.common"), "candidates")
    entry = c.select("rep", F.explode("prefix").alias("h"))
    least = entry.groupBy("h").agg(F.min("rep").alias("m"), F.max("rep").alias("x")).where("m <> x").select("h", "m")
    block = components(entry.join(least, "h").where("rep <> m").select(F.col("rep").alias("a"), F.col("m").alias("b")).distinct())
    # cells of at most so many documents and n-grams; large blocks are cut into bands of length first, as linked sets are at most one apart
    members = c.drop("prefix").join(block.withColumnsRenamed({"id": "rep", "component_id": "block"}), "rep")
    cells_of = lambda by: F.greatest(F.ceil(F.count("*") / CELL), F.ceil(F.sum("grams") / CELL_GRAMS)).cast("int").alias(by)
    members = members.join(members.groupBy("block").agg(cells_of("large")), "block").withColumn("large", F.col("large") > 1)
    members = members.withColumn("band", F.when(F.col("large"), F.floor(F.ln("n") / F.lit(math.log(100 / PERCENT)) + 1e-9)).otherwise(0).cast("int"))
    bands = members.where("large").groupBy("block", "band").agg(cells_of("cells"), F.ceil(F.count("*") / PIVOTS).alias("one_in"))
    members = members.join(bands, ["block", "band"], "left").fillna(1, ["cells", "one_in"])
    members = scratch.keep(members.withColumn("nth", F.pmod(F.xxhash64("rep"), "cells").cast("int")).drop("cells"), "members")
    cell = F.xxhash64("block", "band", "nth")
    own = members.select(cell.alias("cell"), "rep", "n", F.lit(False).alias("side"), "common")
    pivots = members.where("large").where(F.pmod(F.xxhash64("rep", F.lit(1)), "one_in") == 0).drop("nth", "large", "one_in").withColumn("band", F.explode(F.array(*[F.col("band") + k for k in (-1, 0, 1)])))
    pivots = pivots.join(bands.drop("one_in"), ["block", "band"]).withColumn("nth", F.explode(F.sequence(F.lit(0), F.col("cells") - 1)))
    pivots = pivots.select(cell.alias("cell"), "rep", "n", F.lit(False).alias("side"), "common")
    total = members.agg(F.sum("grams")).first()[0]
    found = scratch.keep(compare(own.unionByName(pivots), _deals(spark, total)), "links")
    return found.unionByName(_leftovers(members, c, found, scratch))


def _leftovers(members: DataFrame, c: DataFrame, found: DataFrame, scratch: Scratch) -> DataFrame:
    """Links of what isn't yet with the largest part of its large block.

    Each such document is put to the cells that hold one of its prefix n-grams and sets of its own band of length or a neighbour
    band, and is compared with all documents of these.
    """
    spark = members.sparkSession
    part = components(found).withColumnRenamed("id", "rep")
    large = members.where("large").drop("common").join(part, "rep", "left").withColumn("part", F.coalesce("component_id", "rep"))
    large = scratch.keep(large.select("rep", "n", "block", "band", "nth", "part"), "parts")
    main = large.groupBy("block", "part").agg(F.count("*").alias("k")).groupBy("block").agg(F.max_by("part", F.struct("k", "part")).alias("main"))
    rest = large.join(main, "block").where("part <> main").select("rep", "block", "band")
    entry = c.select("rep", F.explode("prefix").alias("h"))
    asking = entry.join(rest, "rep").select("h", "rep", "block", F.explode(F.array(*[F.col("band") + k for k in (-1, 0, 1)])).alias("band"))
    holding = entry.join(large, "rep").select("h", "block", "band", "nth").distinct()
    asked = scratch.keep(asking.join(holding, ["h", "block", "band"]).select("rep", "block", "band", "nth").distinct(), "asked")
    key = ["block", "band", "nth"]
    groups = asked.groupBy(key).agg(F.ceil(F.count("*") / ASKED).cast("int").alias("groups"))
    tile, sets_of = F.xxhash64(*key, "group"), members.where("large").select("rep", "n", "grams", "common")
    left = asked.join(groups, key).withColumn("group", F.pmod(F.xxhash64("rep", F.lit(2)), "groups").cast("int")).select(tile.alias("cell"), "rep", F.lit(True).alias("side"))
    right = large.join(groups, key).withColumn("group", F.explode(F.sequence(F.lit(0), F.col("groups") - 1))).select(tile.alias("cell"), "rep", F.lit(False).alias("side"))
    tiles = scratch.keep(left.unionByName(right), "tiles")
    total = tiles.join(sets_of.select("rep", "grams"), "rep").agg(F.sum("grams")).first()[0]
    return compare(tiles.join(sets_of.drop("grams"), "rep"), _deals(spark, total))


def join(docs: DataFrame, width: int = WORDS) -> DataFrame:
    """doc_id, n_shingles and component_id of every row (doc_id, text).

    Null and empty texts, and those without words, have no shingles and link with nothing; with fewer words than a shingle
    has, the whole sequence is one. Rows with a null doc_id keep a null component and link with nothing; rows with the same
    doc_id are one node. Hashes have 48 bits, signatures of sets 128.
    """
    d = materialise(sets(docs, width), "sets")
    scratch, known = Scratch(), d.where("n > 0 and doc_id is not null")
    # written first: adaptive execution splits a join on a set that very many rows share only if both sides come straight from a shuffle
    least = scratch.keep(known.groupBy("s1", "s2").agg(F.min("doc_id").alias("m"), F.max("doc_id").alias("x")).where("m <> x").drop("x"), "copies")
    same = known.select("doc_id", "s1", "s2").join(least, ["s1", "s2"]).where("doc_id <> m").select(F.col("doc_id").alias("a"), F.col("m").alias("b"))
    part = components(same.unionByName(_links(d, scratch)))
    scratch.drop()
    got = d.select("doc_id", F.col("n").alias("n_shingles")).join(part.withColumnRenamed("id", "doc_id"), "doc_id", "left")
    return got.select("doc_id", "n_shingles", F.coalesce("component_id", "doc_id").alias("component_id"))
