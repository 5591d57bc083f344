"""Fill-in-the-middle, conversation repair and exact dedup against brute force, with nulls, empty and long texts, ties and repeats."""

import gzip
import hashlib
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.llm import dialogue, exact, infill, secrets, warc

SCHEMA = "doc_id long, text string, n long, form string, output string, row long, digest string, old string, keep string, group_size string"


def frame(spark, rows):
    """Rows (doc_id, text) with other columns whose names clash with those used inside."""
    return spark.createDataFrame([(i, t, 7, "f", "o", 3, "d", "x", "y", "z") for i, t in rows], SCHEMA)


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(11)
    letters = "ab \n\tä😀 <"
    rows = [(i, "".join(rng.choice(letters) for _ in range(rng.choice([1, 2, 5, 40, 1023, 1024, 1025, 2048, 2049, 5000])))) for i in range(120)]
    rows += [(200, None), (201, ""), (202, " "), (203, "\n\n"), (204, "a<P>b"), (205, "<M>"), (206, "<P<S<M"), (None, "no id here"), (None, "no id here"), (None, None)]
    rows += [(207, "😀" * 3000), (208, "word " * 60000), (3, rows[3][1]), (3, "another text of the same id"), (-5, "a < b > c")]
    return rows


#: A unit of each kind, by one pattern over the whole text.
PATTERNS = {"char": r"[\s\S]", "word": r"[^\x20\x09-\x0D]*[\x20\x09-\x0D]+(?=[^\x20\x09-\x0D])|[\s\S]+", "line": r"[^\n]*\n|[^\n]+"}


def units(text, unit):
    return re.findall(PATTERNS[unit], text)


def fim(doc_id, text, unit="char"):
    t = text or ""
    h = sha("1:" + ("" if doc_id is None else str(doc_id)))
    h1, h2, h3, h4 = (int(h[8 * i : 8 * i + 8], 16) for i in range(4))
    parts = units(t, unit)
    n = len(parts)
    lo, hi = sorted((h1 % (n + 1), h2 % (n + 1)))
    if not t or any(m in t for m in ("<P>", "<S>", "<M>")) or h3 % 100 >= 90:
        return n, "plain", None, None, t
    pre, mid, suf = "".join(parts[:lo]), "".join(parts[lo:hi]), "".join(parts[hi:])
    if h4 % 100 < 20:
        return n, "spm", len(pre), len(mid), f"<S>{suf}<P>{pre}<M>{mid}"
    return n, "psm", len(pre), len(mid), f"<P>{pre}<S>{suf}<M>{mid}"


@pytest.mark.parametrize("unit", sorted(infill.UNITS))
def test_infill_equals_one_scan_of_the_whole_text(spark, texts, unit):
    got = infill.transform(frame(spark, texts).repartition(3), unit=unit).withColumn("back", infill.restore(F.col("output"), F.col("form")))
    assert {"row", "digest", "keep"} <= set(got.columns)
    rows = [(r.doc_id, r.text, r.n, r.form, r.prefix_chars, r.middle_chars, r.output, r.back) for r in got.collect()]
    want = [(i, t, *fim(i, t, unit), t or "") for i, t in texts]
    key = lambda r: (r[0] is None, r[0] or 0, r[1] or "")
    assert sorted(rows, key=key) == sorted(want, key=key)


def test_infill_cuts_at_any_chunk_size(spark):
    text = "".join(random.Random(2).choice("ab \né") for _ in range(97))
    for unit in infill.UNITS:
        parts = units(text, unit)
        for size in (1, 7, 97, 500):
            asked = [0, 1, len(parts) // 2, len(parts) - 1, len(parts)]
            got = infill.cut(spark.createDataFrame([(text,)], "text string"), lambda n: [F.lit(r).cast("long") for r in asked], unit, size).first()
            assert got._n == len(parts) and got._cuts == [len("".join(parts[:r])) for r in asked]


def test_infill_looks_through_a_text_few_times(spark):
    """Marks are put into the two chunks that own cuts, not into each chunk to count; an output is split once to put it back."""
    got = infill.digest(infill.transform(frame(spark, [(1, "ab c")])))
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count(f"$0{infill._MARK}") == 2 and plan.count("split(") == 1 and plan.count("substring_index(") <= 2 and "translate(" not in plan


def test_infill_counts_long_runs_of_boundaries(spark):
    text = "a\ue000\U0001f600\n" * 30_000
    for unit in infill.UNITS:
        parts = units(text, unit)
        got = infill.cut(spark.createDataFrame([(text,)], "text string"), lambda n: [n - 1], unit, 200_000).first()
        assert got._n == len(parts) and got._cuts == [len("".join(parts[:-1]))]


def test_infill_of_no_rows(spark):
    assert infill.digest(infill.transform(frame(spark, []))).collect() == []


def norm(text):
    return re.sub(r"[\x20\x09-\x0D]+", " ", text or "")


def copies(rows):
    groups = {}
    for i, t in rows:
        groups.setdefault(norm(t), []).append(i)
    return {t: (min((i for i in ids if i is not None), default=None), len(ids)) for t, ids in groups.items()}


@pytest.mark.parametrize("share", [0.0, 0.5, 1.0])
def test_exact_dedup_equals_groups_of_normalised_texts(spark, texts, share):
    more = texts + [(300 + i, f"a{' ' * (i + 1)}b\tc") for i in range(50)] + [(400 - i, "a\n\nb c") for i in range(30)] + [(500, "a b c"), (501, "a b c "), (502, " a b c")]
    random.Random(4).shuffle(more)
    got = exact.deduplicate(frame(spark, more).repartition(5), share).collect()
    want = copies(more)
    assert len(got) == len(more)
    by_text = {sha(t): v for t, v in want.items()}
    assert sorted((r.text_sha256, r.doc_id or -9) for r in got) == sorted((sha(norm(t)), i or -9) for i, t in more)
    assert all((r.keep_id, r.group_size) == by_text[r.text_sha256] for r in got)
    assert all(r.doc_id == r.keep_id for r in got if r.kept)
    # one row of each group stays, also where ids are null or repeated
    assert sorted(r.text_sha256 for r in got if r.kept) == sorted(by_text)


def test_exact_dedup_of_no_rows(spark):
    assert exact.deduplicate(frame(spark, [])).collect() == []


def test_hash_is_minimal_and_perfect():
    rng = np.random.default_rng(1)
    for n in (0, 1, 2, 3, 1000, 40000):
        keys = rng.integers(0, 256, (n, 32), np.uint8)
        sizes, settled = exact.build_hash(keys)
        assert sorted(exact.slots(keys, sizes, settled).tolist()) == list(range(n))
        assert settled.size <= 5 * n + 60
    with pytest.raises(ValueError):
        exact.build_hash(np.zeros((2, 32), np.uint8))


def test_look_ups_compare_whole_digests(spark, monkeypatch):
    """Strangers fall on slots of the index, but aren't taken for members; shards are split where more is asked than held."""
    monkeypatch.setattr(exact, "SHARD_KEYS", 16)
    digest = lambda x: F.unhex(F.sha2(F.concat(F.lit("k"), x.cast("string")), 256))
    held = spark.range(100).select(digest(F.col("id")).alias("digest"), F.col("id"), (F.col("id") + 1000).alias("row"), F.lit(2).cast("long").alias("copies"))
    index = exact.build(held, 100)
    assert index.shards == 8 and index.table.count() <= 8
    asked = spark.range(1000).select("id", digest(F.col("id")).alias("digest"))
    got = exact.look_up(asked.select("digest"), index, 1000).join(asked, "digest").collect()
    assert len(got) == 1000
    assert all((r.old_id, r.old_row, r.old_copies) == ((r.id, r.id + 1000, 2) if r.id < 100 else (None, None, None)) for r in got)


# -- conversations: plain code over whole conversations, every repair tried row by row

TURNS = "conv_id long, turn long, role string, text string, digest string, at long, block long, fault string, n long"


def ordered(rows, damaged=True):
    """Rows (conv, turn, role, text) of each conversation after damage, in their order."""
    out = {}
    for conv, turn, role, text in rows:
        role, text = (" " if x is None else x for x in (role, text))
        h = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20 if damaged else 9
        text = "" if h == 1 else re.sub("[.!?]", "", text) if h == 2 else text
        out.setdefault(conv, [])
        out[conv] += [(turn, "user" if h == 4 else role, text)] * (0 if h == 0 else 2 if h == 3 else 1)
    return {c: sorted(r, key=lambda x: (x[0] is not None, x[0] or 0, x[1].encode(), sha(x[2]))) for c, r in out.items()}


def best_repair(rows, faults):
    """Smallest (cost, audit, lines) by every sequence of edits that can still win, with all states tried at each row."""
    machine = {("", "s"): "s", ("", "u"): "u", ("s", "u"): "u", ("u", "a"): "a", ("a", "u"): "u"}
    best = {"": (0, "", ())}

    def better(table, state, value):
        if state not in table or value[:2] < table[state][:2]:
            table[state] = value

    def insert(table):
        for _ in range(3):
            for state, (cost, audit, lines) in list(table.items()):
                for role in ("user", "assistant"):
                    if (state, role[0]) in machine:
                        better(table, machine[state, role[0]], (cost + 2, audit + "I", lines + (f"{role}:",)))

    for (_, role, text), fault in zip(rows, faults):
        insert(best)
        new = {}
        for state, (cost, audit, lines) in best.items():
            better(new, state, (cost + 3, audit + "D", lines))
            if fault in ("blank", "duplicate"):
                continue
            extra = fault == "truncated"
            if (state, role[:1]) in machine:
                better(new, machine[state, role[:1]], (cost + extra, audit + "K", lines + (f"{role}:{text}",)))
            for other in ("user", "assistant"):
                if (state, other[0]) in machine:
                    better(new, machine[state, other[0]], (cost + 2 + extra, audit + "R", lines + (f"{other}:{text}",)))
        best = new
    insert(best)
    return min(best[s] for s in ("", "a") if s in best)


def repaired(rows):
    faults, seen = [], set()
    for _, role, text in rows:
        inside = re.sub(r"[\x20\x09-\x0D]", "", text)
        faults.append("blank" if not inside else "duplicate" if (role, text) in seen else "truncated" if inside[-1] not in ".!?" else None)
        seen.add((role, text))
    turns = [t for t, _, _ in rows if t is not None]
    initials = [r[:1] for _, r, _ in rows]
    illegal = sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:]))
    cost, audit, lines = best_repair(rows, faults)
    gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
    return gaps, *(faults.count(f) for f in ("blank", "duplicate", "truncated")), illegal, cost, audit, sha("\n".join(lines))


@pytest.fixture(scope="module")
def turns():
    rng = random.Random(3)
    texts = ["Yes.", "No!", "Why?", "So", "", " \n", "A long one. With two", "ä😀.", None, "x\ty?"]
    roles = ["user", "assistant", "system", "user", "assistant", "tool", None, "", "User", "agent"]
    rows = []
    for conv in range(150):
        for turn in range(rng.randrange(1, 9)):
            role = ("user", "assistant")[turn % 2] if rng.random() < 0.7 else rng.choice(roles)
            rows.append((conv, rng.choice([turn, turn, turn, None, 2 * turn]), role, rng.choice(texts) if rng.random() < 0.5 else f"Text {rng.randrange(5)}."))
    rows += [(900, t, rng.choice(roles), rng.choice(texts) if rng.random() < 0.3 else f"No {rng.randrange(200)}{rng.choice(['.', ''])}") for t in range(170)]
    rows += [(None, 1, "user", "Hi."), (None, None, "assistant", "Ho."), (901, None, None, None), (902, 5, "system", "z" * 200000 + "."), (903, 0, "user", "Hi."), (903, 0, "user", "Hi.")]
    rows += [(1000 + i, 0, "user", "same words?") for i in range(60)]
    rng.shuffle(rows)
    return rows


def talk(spark, rows):
    return spark.createDataFrame([(*r, "d", 1, 2, "blank", 5) for r in rows], TURNS)


COLUMNS = ("conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256")


@pytest.mark.parametrize("bits", [8, 2])
def test_conversations_equal_a_full_search(spark, turns, bits, monkeypatch):
    monkeypatch.setattr(dialogue, "JOINED", 3)
    source = talk(spark, turns).repartition(3)
    got = dialogue.digest(source, dialogue.repair(dialogue.damage(source), bits)).select(*COLUMNS).collect()
    want = [(c, *repaired(r)) for c, r in ordered(turns).items()]
    key = lambda r: (r[0] is None, r[0] or 0)
    assert sorted(map(tuple, got), key=key) == sorted(want, key=key)


def test_repaired_rows_stand_in_order(spark):
    rows = [(1, 0, "system", "Be kind."), (1, 1, "assistant", "Hello."), (1, 2, "assistant", "Still here."), (2, 0, "user", "")]
    got = dialogue.repair(talk(spark, rows)).rows.orderBy("conv_id", "at", "seq").collect()
    # the first assistant row becomes the user's; the blank row of the other conversation is deleted
    assert [(r.conv_id, r.edit, r.role, r.text) for r in got] == [(1, "K", "system", "Be kind."), (1, "R", "user", "Hello."), (1, "K", "assistant", "Still here.")]


def test_conversations_of_no_rows(spark):
    source = talk(spark, [])
    assert dialogue.digest(source, dialogue.repair(dialogue.damage(source))).collect() == []


@pytest.mark.parametrize("width", [20, 64])
def test_secrets_of_a_text_of_many_long_tokens(spark, width):
    """Tokens beside base spans of their text cost in proportion; those that overlap one add nothing, those that touch one do."""
    rng = random.Random(width)
    hexes = ["".join(rng.choice("0123456789abcdef") for _ in range(width)) for _ in range(4000)]
    free = ["".join(rng.choice("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789") for _ in range(40)) for _ in range(3000)]
    words = [f"password={x}" if i % 10 == 0 else x for i, x in enumerate(free)] + hexes
    rng.shuffle(words)
    text = " ".join(words)
    source = spark.createDataFrame([(1, text), (2, None), (3, "plain words only")], "doc_id long, text string")
    got = {r.doc_id: r for r in secrets.scan(source).collect()}
    base, found = got[1].base, got[1].found
    assert sum(x.kind == "hex" for x in base) >= 4000 and sum(x.kind == "assign" for x in base) == 300
    added = [x for x in found if x.kind == "random"]
    assert len(added) > 2000 and len(found) == len(base) + len(added)
    ends = sorted((x.s, x.e) for x in base)
    starts = np.array([s for s, _ in ends])
    for x in added:
        assert text[x.s : x.e] == x.v
        i = int(np.searchsorted(starts, x.e))
        assert all(e <= x.s for _, e in ends[max(0, i - 3) : i])


def record(kind, ident, block, **headers):
    lines = "".join(f"{k}: {v}\r\n" for k, v in headers.items())
    return f"WARC/1.1\r\nWARC-Type: {kind}\r\nWARC-Record-ID: <{ident}>\r\n{lines}Content-Length: {len(block)}\r\n\r\n".encode() + block + b"\r\n\r\n"


def test_archives_of_other_writers(spark, tmp_path):
    """One gzip member a record, no compression, names in other cases, bytes that are no UTF-8, broken ends, large payloads."""
    http = {"Content-Type": "application/http; msgtype=response"}
    six = [record("response", f"r{i}", b"HTTP/1.1 200 OK\r\nX: caf\xe9\r\n\r\nbody " + bytes([65 + i]), **http) for i in range(6)]
    foreign = b"WARC/1.0\r\nwarc-type:RESPONSE\r\nwarc-record-id:<f>\r\nx-note: one\r\n two\r\ncontent-type: application/http\r\ncontent-length:0005\r\n\r\nabcde\r\n\r\n"
    large = record("response", "large", b"HTTP/1.1 200 OK\r\n\r\n" + b"z" * (30 << 20), **http)
    files = {"members.warc.gz": b"".join(map(gzip.compress, six)), "plain.warc": b"".join(six[:2]) + foreign, "cut.warc.gz": gzip.compress(six[0] + six[1])[:-30], "short.warc": six[0] + six[1][:-20], "noise.warc": six[2] + b"noise", "empty.warc": b"", "large.warc.gz": gzip.compress(large)}
    for name, data in files.items():
        (tmp_path / name).write_bytes(data)
    rows = warc.read_records(spark, f"file://{tmp_path}").select("record_id", "record_type", "http_headers", F.octet_length("body").alias("n"), "headers").collect()
    count = lambda *ids: [sum(r.record_id == f"<{i}>" for r in rows) for i in ids]
    assert count("r2", "r3", "r4", "r5", "f", "large") == [2, 1, 1, 1, 1, 1]
    # a gzip file that is cut off may still hold whole records, but not all of them
    assert sum(r.record_type == "broken" for r in rows) in (2, 3)
    assert all("caf\xe9" in r.http_headers for r in rows if r.record_id == "<r3>")
    foreign_row = next(r for r in rows if r.record_id == "<f>")
    assert foreign_row.record_type == "response" and foreign_row.headers["x-note"] == "one two"
    assert next(r for r in rows if r.record_id == "<large>").n == 30 << 20
    # whole records before a broken end are kept, and captures are put together without it
    assert next(warc.parse_archive(files["short.warc"]))["record_id"] == "<r0>"
    assert warc.assemble(warc.read_records(spark, f"file://{tmp_path}"), bodies=False).count() == 8
