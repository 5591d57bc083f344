"""Exact dedup against what was kept before: a minimal perfect hash over the distinct digests of earlier documents.

The index is a table with one row for each shard of digests. A shard holds the hash (levels of bit arrays: a key settles on the
first level where no other key has its place; its slot is the number of settled places before its own) and, by slot, the full
digest, the locator of the winner (doc_id and row number) and the number of copies. A digest that was never indexed may fall on
a slot too, so every look-up compares all its bytes. Digests that aren't found are grouped on their own.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .kernels import U64, mix
from .shared import Scratch, materialise

#: Distinct digests of a shard, on average; their number sets the number of shards.
SHARD_KEYS = 1 << 15
#: Places of a level for each key that hasn't settled yet, and levels at most: distinct keys need about ten.
SPREAD, LEVELS = 1.5, 64
#: Share of the rows, by doc_id, that counts as earlier where a table is its own history.
HISTORY_SHARE = 0.5
_WIDTH = 32
_SLOTS = ("ids", "rows", "copies")
_INDEX = "shard long, level_sizes array<long>, bits binary, digests binary, ids binary, rows binary, copies binary"
_FOUND = "digest binary, old_id long, old_row long, old_copies long"


def normalised(text: Column | str) -> Column:
    """A text with each run of blanks as one space; null counts as empty."""
    return F.regexp_replace(F.coalesce(text, F.lit("")), r"[\x20\x09-\x0D]+", " ")


# -- the hash of one shard


def _places(digests: np.ndarray, level: int, size: int) -> np.ndarray:
    """A place below `size` for each digest; the first 8 bytes tell shards apart and aren't used."""
    wide = digests.view("<u8")
    with np.errstate(over="ignore"):
        return (mix(wide[:, 1] + wide[:, 2] * U64(2 * level + 1)) % U64(size)).astype(np.int64)


def build_hash(digests: np.ndarray) -> tuple[list[int], np.ndarray]:
    """(sizes of the levels, the settled places of all levels as booleans) for distinct digests, n x 32 bytes."""
    sizes, settled = [], [np.zeros(0, bool)]
    while len(digests):
        if len(sizes) == LEVELS:
            raise ValueError("digests must be distinct")
        sizes.append(max(8, int(SPREAD * len(digests))))
        at = _places(digests, len(sizes) - 1, sizes[-1])
        alone = np.bincount(at, minlength=sizes[-1]) == 1
        settled.append(alone)
        digests = digests[~alone[at]]
    return sizes, np.concatenate(settled)


def slots(digests: np.ndarray, sizes: list[int], settled: np.ndarray) -> np.ndarray:
    """The slot of each digest: of indexed ones a number of their own below n, of others any slot or -1."""
    rank = np.cumsum(settled) - settled
    out, todo, first = np.full(len(digests), -1, np.int64), np.arange(len(digests)), 0
    for level, size in enumerate(sizes):
        at = first + _places(digests[todo], level, size)
        here = settled[at]
        out[todo[here]] = rank[at[here]]
        todo, first = todo[~here], first + size
    return out


def _matrix(column: pa.ChunkedArray) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint8).reshape(-1, _WIDTH).copy()


def _build(table: pa.Table) -> pa.Table:
    digests = _matrix(table["digest"])
    sizes, settled = build_hash(digests)
    order = np.empty(len(digests), np.int64)
    order[slots(digests, sizes, settled)] = np.arange(len(digests))
    blobs = {"bits": np.packbits(settled), "digests": digests[order]} | {name: table[name].to_numpy().astype("<i8")[order] for name in _SLOTS}
    columns = {"shard": pa.array([table["shard"][0].as_py()], pa.int64()), "level_sizes": pa.array([sizes], pa.list_(pa.int64()))}
    return pa.table(columns | {name: pa.array([x.tobytes()], pa.binary()) for name, x in blobs.items()})


def _look_up(key, held: pa.Table, asked: pa.Table) -> pa.Table:
    digests = _matrix(asked["digest"])
    hit = np.zeros(len(digests), bool)
    values = {name: np.zeros(len(digests), np.int64) for name in _SLOTS}
    if held.num_rows and len(digests):
        one = {name: held[name][0].as_py() for name in held.column_names}
        settled = np.unpackbits(np.frombuffer(one["bits"], np.uint8), count=sum(one["level_sizes"])).astype(bool)
        at = slots(digests, one["level_sizes"], settled)
        hit = at >= 0
        hit[hit] = (np.frombuffer(one["digests"], np.uint8).reshape(-1, _WIDTH)[at[hit]] == digests[hit]).all(axis=1)
        for name in _SLOTS:
            values[name][hit] = np.frombuffer(one[name], "<i8")[at[hit]]
    columns = {"digest": pa.array(asked["digest"].to_pylist(), pa.binary())}
    return pa.table(columns | {f"old_{what}": pa.array(values[name], mask=~hit) for what, name in (("id", "ids"), ("row", "rows"), ("copies", "copies"))})


# -- the index as a table


@dataclass
class Index:
    shards: int
    table: DataFrame


def _shard(shards: int) -> Column:
    """The leading bits of a digest, which are even however often a text is repeated."""
    return F.shiftrightunsigned(F.conv(F.hex(F.substring("digest", 1, 4)), 16, 10).cast("long"), 32 - int(math.log2(shards)))


def shards_for(keys: int) -> int:
    return 1 << min(32, max(0, math.ceil(math.log2(max(1, keys) / SHARD_KEYS))))


def build(kept: DataFrame, keys: int) -> Index:
    """The index over `keys` distinct digests with their winners: columns digest, id, row, copies, none of them null."""
    shards = shards_for(keys)
    own = kept.select(_shard(shards).alias("shard"), "digest", F.col("id").alias("ids"), F.col("row").alias("rows"), "copies")
    return Index(shards, own.groupBy("shard").applyInArrow(_build, _INDEX))


def look_up(asked: DataFrame, index: Index, keys: int) -> DataFrame:
    """`keys` distinct digests with old_id, old_row and old_copies of their slots; null for those that aren't in the index.

    Each shard meets the digests that fall to it. Where many more are asked than indexed, shards are read several times, each
    time by a part of the digests, so that no group is much larger than a shard.
    """
    split = max(1, math.ceil(keys / (index.shards * SHARD_KEYS)))
    part = F.conv(F.hex(F.substring("digest", 29, 4)), 16, 10).cast("long") % split
    own = asked.select("digest", _shard(index.shards).alias("shard"), part.alias("part"))
    held = index.table.withColumn("part", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(split - 1).cast("long"))))
    return held.groupBy("shard", "part").cogroup(own.groupBy("shard", "part")).applyInArrow(_look_up, _FOUND)


# -- documents


def digests(docs: DataFrame) -> DataFrame:
    """(row, id, digest) of each row of `docs`: rows are numbered by partition and place, which files give alike again."""
    return docs.select(F.monotonically_increasing_id().alias("row"), F.col("doc_id").cast("long").alias("id"), F.unhex(F.sha2(normalised("text"), 256)).alias("digest"))


def _winner(condition: Column) -> Column:
    return F.min(F.when(condition, F.struct(F.col("id").isNull().alias("none"), "id", "row")))


def resolve(rows: DataFrame, earlier: Column) -> DataFrame:
    """Rows (row, id, digest) with keep_id, keep_row and group_size; `earlier` tells which of them are the history.

    The history's distinct digests with their winners and copies go into the index, in which all distinct digests are looked up.
    Found ones belong to the winner there (or to a new row of a smaller id); the others belong to the smallest id of their own
    group. A null id wins only where no row has one, and of equal ids the first row wins. Digests are counted before they are
    dealt, and their verdicts are written, so that adaptive execution can split the last join on a digest that very many rows share.
    """
    old = F.coalesce(earlier, F.lit(False)) & F.col("id").isNotNull()
    tables = Scratch()
    # one row a digest: partial sums are made before the shuffle, so a repeated text is no hot key
    each = rows.groupBy("digest").agg(_winner(old).alias("old"), F.count_if(old).alias("old_copies"), _winner(~old).alias("new"), F.count_if(~old).alias("new_copies"))
    each = tables.keep(each, "digests")
    sizes = each.agg(F.count("*").alias("every"), F.count_if(F.col("old_copies") > 0).alias("old")).first()
    kept = each.where("old_copies > 0").select("digest", "old.id", "old.row", F.col("old_copies").alias("copies"))
    index = build(kept, sizes["old"])
    index.table = tables.keep(index.table, "index")
    found = look_up(each, index, sizes["every"])
    # what isn't a member keeps its own group
    verdict = each.select("digest", "new", "new_copies").join(found, "digest", "left")
    member = F.when(F.col("old_row").isNotNull(), F.struct(F.lit(False).alias("none"), F.col("old_id").alias("id"), F.col("old_row").alias("row")))
    verdict = verdict.select("digest", F.least(member, "new").alias("keep"), (F.coalesce("old_copies", F.lit(0)) + F.col("new_copies")).alias("group_size"))
    verdict = materialise(verdict, "verdicts")
    tables.drop()
    return rows.join(verdict, "digest").select("row", "id", "digest", F.col("keep.id").alias("keep_id"), F.col("keep.row").alias("keep_row"), "group_size")


def deduplicate(docs: DataFrame, history_share: float = HISTORY_SHARE) -> DataFrame:
    """doc_id, keep_id, group_size, kept and text_sha256 of each row of `docs`, whose texts are equal but for runs of blanks.

    The table is its own history: rows up to the doc_id at `history_share` (an approximate quantile; the result is the same
    wherever it lies) are indexed, later ones are looked up in them. Null and empty texts are equal; of rows that repeat a
    doc_id the first stays; rows without one stay only where no equal text has one, and keep_id is then null.
    """
    rows = materialise(digests(docs), "rows")
    middle = rows.agg(F.percentile_approx("id", history_share, 10000).alias("id")).first()["id"]
    got = resolve(rows, F.col("id") <= F.lit(middle).cast("long"))
    return got.select(F.col("id").alias("doc_id"), "keep_id", "group_size", (F.col("row") == F.col("keep_row")).alias("kept"), F.lower(F.hex("digest")).alias("text_sha256"))
