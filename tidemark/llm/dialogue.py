"""Repair of conversations: the cheapest edits after which roles alternate, by Dijkstra on a lattice that is never written out.

A node is (rows consumed, grammar state); an edge keeps, reroles or deletes the next row, or inserts an empty one. The queue is
ordered by (cost, audit), audit being the edits' initials so far, and the first end node that is popped has the answer.

Conversations may be of any length. Rows are dealt in ranges of their order and cut into pieces of at most 256; a conversation in
one piece (nearly all) is solved whole. Of a longer one each piece is solved from every state to every state, and pieces are
joined, 64 at a time, by the cheapest way through the state between them. That is exact: of two ways between the same nodes
with equal costs neither audit can begin with the other (the rest would be insertions, which cost), so the smaller part stays
the smaller whatever follows.
"""

from __future__ import annotations

import hashlib
import heapq
from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .shared import Scratch, materialise

KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 2, 3, 2, 1
#: Rows of a piece (as bits), and pieces that are joined at a time.
PIECE_BITS, JOINED = 8, 64
#: States: nothing yet, after system, after user, after assistant. A conversation may end in the first or the last.
START, SYSTEM, USER, ASSISTANT = range(4)
ENDS = (START, ASSISTANT)
_NAME = {"u": "user", "a": "assistant"}
_BLANK = r"\x20\x09-\x0D"


# -- one conversation or piece. A row is one character: the role's initial (s, u, a, or o for any other), in capitals if the row
# is truncated, or - if it must go.


def _next(state: int) -> tuple[str, int]:
    """The role that must follow (but for a first system row) and the state after it."""
    return ("a", ASSISTANT) if state == USER else ("u", USER)


def cheapest(codes: str, entry: int = START, ends: tuple[int, ...] = ENDS, every: bool = False) -> dict[int, tuple[int, str]]:
    """{end state: (cost, audit)} from `entry`: the first of `ends` that is popped, or all that can be reached."""
    n, found, done = len(codes), {}, set()
    heap = [(0, "", 0, entry)]
    while heap:
        cost, audit, i, state = heapq.heappop(heap)
        if (i, state) in done:
            continue
        done.add((i, state))
        if i == n and state in ends:
            found[state] = (cost, audit)
            if not every or len(found) == len(ends):
                break
        role, after = _next(state)
        heapq.heappush(heap, (cost + INSERT, audit + "I", i, after))
        if i == n:
            continue
        code = codes[i]
        heapq.heappush(heap, (cost + DELETE, audit + "D", i + 1, state))
        if code == "-":
            continue
        own, extra = code.lower(), TRUNCATED if code.isupper() else 0
        if own == role:
            heapq.heappush(heap, (cost + KEEP + extra, audit + "K", i + 1, after))
        else:
            heapq.heappush(heap, (cost + REROLE + extra, audit + "R", i + 1, after))
            if own == "s" and state == START:
                heapq.heappush(heap, (cost + KEEP + extra, audit + "K", i + 1, SYSTEM))
    return found


def all_ways(codes: str) -> tuple[list[int], list[str]]:
    """Costs and audits from each state (rows) to each (columns); -1 where there is no way."""
    costs, audits = [], []
    for entry in range(4):
        found = cheapest(codes, entry, tuple(range(4)), True)
        for end in range(4):
            cost, audit = found.get(end, (-1, ""))
            costs.append(cost)
            audits.append(audit)
    return costs, audits


def joined(first, second) -> tuple[list[int], list[str]]:
    """The ways through two neighbours."""
    (c1, a1), (c2, a2) = first, second
    costs, audits = [], []
    for entry in range(4):
        for end in range(4):
            ways = [(c1[4 * entry + m] + c2[4 * m + end], a1[4 * entry + m] + a2[4 * m + end]) for m in range(4) if c1[4 * entry + m] >= 0 and c2[4 * m + end] >= 0]
            cost, audit = min(ways, default=(-1, ""))
            costs.append(cost)
            audits.append(audit)
    return costs, audits


def state_after(edit: str, code: str, state: int) -> int:
    if edit == "D":
        return state
    return SYSTEM if edit == "K" and code in "sS" else _next(state)[1]


def walk(codes: str, audit: str, state: int) -> Iterator[tuple[str, str | None, int | None]]:
    """(edit, new role, row or None) for each letter of an audit."""
    i = 0
    for edit in audit:
        own = None if edit == "I" else i
        yield edit, _NAME[_next(state)[0]] if edit in "RI" else None, own
        state = state_after(edit, "" if own is None else codes[i], state)
        i += own is not None


# -- inside tasks

_WAYS = "costs array<long>, audits array<string>"
_PLACES = "conv_id long, at long, seq long, edit string, new_role string"


def _solve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Adds cost and audit to whole conversations."""
    for batch in batches:
        best = [next(iter(cheapest(codes).values())) for codes in batch.column("codes").to_pylist()]
        yield batch.append_column("cost", pa.array([c for c, _ in best], pa.int64())).append_column("audit", pa.array([a for _, a in best], pa.string()))


def _all_ways(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Puts the costs and audits of a piece in the place of its codes."""
    for batch in batches:
        ways = [all_ways(codes) for codes in batch.column("codes").to_pylist()]
        columns = [batch.column("conv_id"), batch.column("block"), pa.array([c for c, _ in ways], pa.list_(pa.int64())), pa.array([a for _, a in ways], pa.list_(pa.string()))]
        yield pa.RecordBatch.from_arrays(columns, ["conv_id", "block", "costs", "audits"])


def _join_pieces(frame: pd.DataFrame) -> pd.DataFrame:
    """Pieces of one conversation that follow each other, joined in pairs."""
    frame = frame.sort_values("block")
    ways = list(zip(frame["costs"].map(list), frame["audits"].map(list)))
    while len(ways) > 1:
        ways = [joined(*ways[i : i + 2]) if i + 1 < len(ways) else ways[i] for i in range(0, len(ways), 2)]
    top = frame.iloc[:1].copy()
    top["costs"], top["audits"] = [ways[0][0]], [ways[0][1]]
    return top[["conv_id", "block", "costs", "audits"]]


def _spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The audit of each piece, of that of its conversation, and the state in which it is entered; insertions go to the piece
    of the row before which they stand."""
    schema = pa.schema([("conv_id", pa.int64()), ("block", pa.int64()), ("entry", pa.int32()), ("audit", pa.string())])
    for batch in batches:
        for row in batch.to_pylist():
            audit, at, state, out = row["audit"], 0, START, []
            for piece in row["blocks"]:
                start, entry, i, codes = at, state, 0, piece["codes"]
                last = piece is row["blocks"][-1]
                while i < len(codes) or (last and at < len(audit)):
                    edit = audit[at]
                    state = state_after(edit, "" if edit == "I" else codes[i], state)
                    i += edit != "I"
                    at += 1
                out.append({"conv_id": row["conv_id"], "block": piece["block"], "entry": entry, "audit": audit[start:at]})
            for i in range(0, len(out), 10_000):
                yield pa.RecordBatch.from_pylist(out[i : i + 10_000], schema)


def _places(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row for each edit of a piece: `at` is the row it is on, or the one it stands before (of a last one, after)."""
    schema = pa.schema([("conv_id", pa.int64()), ("at", pa.int64()), ("seq", pa.int64()), ("edit", pa.string()), ("new_role", pa.string())])
    for batch in batches:
        out = []
        for row in batch.to_pylist():
            ats, i = row["ats"], 0
            for seq, (edit, role, own) in enumerate(walk(row["codes"], row["audit"], row["entry"])):
                out.append((row["conv_id"], ats[min(i, len(ats) - 1)], seq, edit, role))
                i += own is not None
        yield pa.RecordBatch.from_arrays([pa.array(list(c), f.type) for c, f in zip(zip(*out) if out else [[]] * 5, schema)], schema=schema)


def _hashes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """SHA-256 of each conversation's lines, fed row by row in their order, so that no conversation is held."""
    schema = pa.schema([("conv_id", pa.int64()), ("repaired_sha256", pa.string())])
    current, running, started = None, None, False
    for batch in batches:
        out = []
        for conv, line in zip(batch.column("conv_id").to_pylist(), batch.column("line").to_pylist()):
            if not started or conv != current:
                if started:
                    out.append({"conv_id": current, "repaired_sha256": running.hexdigest()})
                current, running, started = conv, hashlib.sha256(), True
                running.update(line.encode())
            else:
                running.update(b"\n" + line.encode())
        yield pa.RecordBatch.from_pylist(out, schema)
    if started:
        yield pa.RecordBatch.from_pylist([{"conv_id": current, "repaired_sha256": running.hexdigest()}], schema)


# -- tables


def _plain(conversations: DataFrame) -> DataFrame:
    return conversations.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), F.coalesce("role", F.lit(" ")).alias("role"), F.coalesce("text", F.lit(" ")).alias("text"))


def damage(conversations: DataFrame) -> DataFrame:
    """Rows as a bad export might leave them: by a hash of `conv_id:turn` some are lost, emptied, robbed of their stops, repeated or
    given to the user. Nulls, in the hash too, count as one space."""
    key = F.concat(F.coalesce(F.col("conv_id").cast("string"), F.lit(" ")), F.lit(":"), F.coalesce(F.col("turn").cast("string"), F.lit(" ")))
    d = _plain(conversations).withColumn("_h", F.crc32(key) % 20).where("_h <> 0")
    h = F.col("_h")
    text = F.when(h == 1, "").when(h == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    return d.select("conv_id", "turn", F.when(h == 4, "user").otherwise(F.col("role")).alias("role"), text.alias("text"), F.explode(F.array_repeat(F.lit(0), F.when(h == 3, 2).otherwise(1))).alias("_copy")).drop("_copy")


@dataclass
class Repaired:
    #: conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit: of each conversation with rows.
    conversations: DataFrame
    #: conv_id, at, seq, edit, role, text: the rows after repair, in the order of (at, seq).
    rows: DataFrame


def repair(conversations: DataFrame, piece_bits: int = PIECE_BITS) -> Repaired:
    """The cheapest repair of rows (conv_id, turn, role, text); other columns are left out.

    Rows go by turn, nulls first, and within a turn by role and a hash of the text; a null role or text is one space, and null
    conv_ids are one conversation. A row's first fault counts: blank, duplicate (role and text stood earlier), truncated. Blank
    and duplicate rows are deleted. A role without a first letter, or with one other than s, u and a, can't be kept.
    """
    tables = Scratch()
    rows = _plain(conversations)
    last = F.regexp_extract("text", f"([^{_BLANK}])[{_BLANK}]*$", 1)
    rows = rows.select("*", F.sha2("text", 256).alias("digest"), F.when(last == "", "blank").when(~last.rlike("[.!?]"), "truncated").alias("fault"), F.when(F.substring("role", 1, 1).isin("s", "u", "a"), F.substring("role", 1, 1)).otherwise("o").alias("initial"), F.monotonically_increasing_id().alias("id"))
    # ranges, not conversations, are dealt: a long conversation is spread over tasks. `at` numbers rows in their order
    order = ["conv_id", F.asc_nulls_first("turn"), "role", "digest", "id"]
    ordered = rows.repartitionByRange(*order).sortWithinPartitions(*order).drop("id").withColumn("at", F.monotonically_increasing_id())
    ordered = materialise(ordered, "turns")
    # the place where a role and text first stood, where they stand twice; counted before the shuffle
    small = ordered.select("conv_id", "turn", "role", "digest", "fault", "initial", "at")
    first = small.groupBy("conv_id", "role", "digest").agg(F.min("at").alias("first"), F.count("*").alias("n")).where("n > 1")
    first = tables.keep(first.select(F.col("conv_id").alias("_c"), F.col("role").alias("_r"), F.col("digest").alias("_d"), "first"), "firsts")
    faulty = small.join(first, F.col("conv_id").eqNullSafe(F.col("_c")) & (F.col("role") == F.col("_r")) & (F.col("digest") == F.col("_d")), "left")
    fault = F.when(F.col("fault") == "blank", "blank").when(F.col("at") > F.col("first"), "duplicate").otherwise(F.col("fault"))
    faulty = faulty.select("conv_id", "turn", "at", "initial", fault.alias("fault"))
    # pieces: rows of one conversation in one block of the order
    one = F.struct("at", "turn", "initial", "fault")
    pieces = faulty.groupBy("conv_id", F.shiftright("at", piece_bits).alias("block")).agg(F.sort_array(F.collect_list(one)).alias("rows"))
    code = lambda r: F.when(r["fault"].isin("blank", "duplicate"), F.lit("-")).when(r["fault"] == "truncated", F.upper(r["initial"])).otherwise(r["initial"])
    count = lambda what: F.size(F.filter("rows", lambda r: r["fault"] == what)).cast("long")
    turns = F.filter(F.transform("rows", lambda r: r["turn"]), lambda t: t.isNotNull())
    initials = F.transform("rows", lambda r: r["initial"])
    pairs = F.zip_with(F.slice(initials, F.lit(1), F.size("rows") - 1), F.slice(initials, F.lit(2), F.size("rows") - 1), lambda a, b: F.concat(a, b))
    pieces = pieces.select(
        "conv_id", "block", F.transform("rows", lambda r: r["at"]).alias("ats"), F.array_join(F.transform("rows", code), "").alias("codes"),
        *[count(f).alias(f) for f in ("blank", "duplicate", "truncated")], F.size(F.filter(pairs, lambda p: ~_legal(p))).cast("long").alias("illegal"),
        F.array_min(turns).alias("low"), F.array_max(turns).alias("high"), F.size(F.array_distinct(turns)).cast("long").alias("turns"),
        F.get(initials, F.lit(0)).alias("head"), F.element_at(initials, -1).alias("tail"),
    )
    own = Window.partitionBy("conv_id").orderBy("block")
    before = F.lag(F.struct("tail", "high")).over(own)
    pieces = materialise(pieces.withColumn("before", before).withColumn("k", F.row_number().over(own)).withColumn("pieces", F.count("*").over(Window.partitionBy("conv_id"))), "pieces")
    tables.drop()
    # a pair of rows, or a turn, may lie on both sides of a cut
    seam = F.when(F.col("before").isNotNull() & ~_legal(F.concat("before.tail", "head")), 1).otherwise(0)
    again = F.when(F.col("before.high") == F.col("low"), 1).otherwise(0)
    total = lambda c: F.sum(c).cast("long")
    stats = pieces.groupBy("conv_id").agg(F.coalesce(F.max("high") - F.min("low") + 1 - total(F.col("turns") - again), F.lit(0)).cast("long").alias("gaps"), *[total(f).alias(f) for f in ("blank", "duplicate", "truncated")], total(F.col("illegal") + seam).alias("illegal"))
    whole = pieces.where("pieces = 1").select("conv_id", "ats", "codes").mapInArrow(_solve, "conv_id long, ats array<long>, codes string, cost long, audit string")
    whole = materialise(whole, "whole")
    # longer conversations: levels of JOINED pieces until one is left of each; nearly all are short, so this is little work
    ways = pieces.where("pieces > 1").select("conv_id", "block", "codes").mapInArrow(_all_ways, f"conv_id long, block long, {_WAYS}")
    level = tables.keep(ways, "ways")
    while (level.groupBy("conv_id").count().agg(F.max("count").alias("n")).first()["n"] or 0) > 1:
        numbered = level.withColumn("part", F.floor((F.row_number().over(own) - 1) / JOINED))
        joined_ways = numbered.groupBy("conv_id", "part").applyInPandas(lambda frame: _join_pieces(frame), f"conv_id long, block long, {_WAYS}")
        level = tables.keep(joined_ways, "ways")
    # ends that are allowed, from the start: states START and ASSISTANT of the first row
    end = lambda s: F.when(F.get("costs", F.lit(s)) >= 0, F.struct(F.get("costs", F.lit(s)).alias("cost"), F.get("audits", F.lit(s)).alias("audit")))
    long = materialise(level.select("conv_id", F.least(*[end(s) for s in ENDS]).alias("x")).select("conv_id", "x.*"), "long")
    tables.drop()
    costs = whole.select("conv_id", "cost", "audit").unionByName(long)
    got = stats.join(costs.withColumnRenamed("conv_id", "_c"), F.col("conv_id").eqNullSafe(F.col("_c"))).drop("_c")
    return Repaired(got, _repaired_rows(ordered, pieces, whole, long))


def _legal(pair: Column) -> Column:
    return pair.isin("su", "ua", "au")


def _repaired_rows(ordered: DataFrame, pieces: DataFrame, whole: DataFrame, long: DataFrame) -> DataFrame:
    """Rows after repair: every edit finds its row by the row's number, which no other has."""
    parts = pieces.where("pieces > 1").select(F.col("conv_id").alias("_c"), F.col("block").alias("_b"), "ats", "codes")
    blocks = parts.groupBy("_c").agg(F.sort_array(F.collect_list(F.struct(F.col("_b").alias("block"), "codes"))).alias("blocks"))
    spread = long.join(blocks, F.col("conv_id").eqNullSafe(F.col("_c"))).select("conv_id", "audit", "blocks").mapInArrow(_spread, "conv_id long, block long, entry int, audit string")
    parts = parts.join(spread, F.col("conv_id").eqNullSafe(F.col("_c")) & (F.col("_b") == F.col("block"))).select("conv_id", "ats", "codes", "entry", "audit")
    edits = whole.select("conv_id", "ats", "codes", F.lit(START).alias("entry"), "audit").unionByName(parts).mapInArrow(_places, _PLACES).where("edit <> 'D'")
    written = edits.where("edit <> 'I'").join(ordered.select("at", "role", "text"), "at").select("conv_id", "at", "seq", "edit", F.coalesce("new_role", "role").alias("role"), "text")
    return written.unionByName(edits.where("edit = 'I'").select("conv_id", "at", "seq", "edit", F.col("new_role").alias("role"), F.lit("").alias("text")))


def digest(originals: DataFrame, repaired: Repaired) -> DataFrame:
    """One row for each conv_id of `originals`, with a hash of its repaired lines; zeros and the hash of nothing where no rows are left.

    A hash of lines in order is one stream, so a conversation's rows are sorted to one task, which reads them without keeping any.
    """
    lines = repaired.rows.select("conv_id", "at", "seq", F.concat("role", F.lit(":"), "text").alias("line"))
    hashed = lines.repartition("conv_id").sortWithinPartitions("conv_id", "at", "seq").select("conv_id", "line").mapInArrow(_hashes, "conv_id long, repaired_sha256 string")
    # a grouping, unlike a join, takes null keys for equal
    parts = originals.select(F.col("conv_id").cast("long").alias("conv_id")).unionByName(repaired.conversations, True).unionByName(hashed, True)
    numbers = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")
    got = parts.groupBy("conv_id").agg(*[F.coalesce(F.max(c), F.lit(0)).cast("long").alias(c) for c in numbers], F.coalesce(F.max("audit"), F.lit("")).alias("audit"), F.coalesce(F.max("repaired_sha256"), F.lit(hashlib.sha256().hexdigest())).alias("repaired_sha256"))
    return got
