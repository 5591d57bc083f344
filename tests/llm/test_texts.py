"""The operators on texts against brute force, with nulls, empty and long texts, ties, repeated rows and clashing columns."""

import hashlib
import itertools
import random
import re
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.llm import decontaminate, jaccard, licenses, secrets, suffixes

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, component_id long, block long, rep long"


def frame(spark, rows):
    """Rows (doc_id, text) with other columns whose names clash with those used inside."""
    return spark.createDataFrame([(i, t, "en", "s", len(t or ""), 1, 2, 3) for i, t in rows], SCHEMA)


def prose(rng, n, vocabulary=400):
    return " ".join(f"w{rng.randrange(vocabulary)}" for _ in range(n))


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(5)
    base, rows = prose(rng, 120, 5000), []
    for i in range(40):
        words = base.split()
        for _ in range(rng.randrange(0, 6)):
            words[rng.randrange(len(words))] = f"edit{rng.randrange(10**6)}"
        rows.append((100 + i, " ".join(words)))
    passage = prose(rng, 40, 5000)
    rows += [(200 + i, prose(rng, 60, 5000) + " " + passage + " " + prose(rng, rng.randrange(5, 60), 5000)) for i in range(15)]
    rows += [(300, None), (301, ""), (302, "   \n\t"), (303, "One two"), (304, "ONE  two"), (305, "one two three"), (306, "é ü 😀 ß " * 80), (307, "é ü 😀 ß " * 80), (308, "ab" * 3000), (309, prose(rng, 30000, 50))]
    rows += [(310, "A B C D E F"), (311, "a b c d e f"), (150, rows[0][1]), (90, rows[0][1])]
    rng.shuffle(rows)
    return rows


def components(n, links):
    up = {i: i for i in n}

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in links:
        a, b = root(a), root(b)
        up[max(a, b)] = min(a, b)
    return {i: root(i) for i in n}


def shingles(text):
    t = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    w = re.findall(r"[^\x20\x09-\x0D]+", t)
    return {tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())


def test_jaccard_join(spark, texts, monkeypatch):
    monkeypatch.setattr(jaccard, "CELL", 8)  # so that blocks have several cells, pivots and a rest
    monkeypatch.setattr(jaccard, "PIVOTS", 2)
    monkeypatch.setattr(jaccard, "ASKED", 8)
    monkeypatch.setattr(jaccard, "COLUMNS", 64)
    got = {r.doc_id: r for r in jaccard.join(frame(spark, texts)).collect()}
    s = {i: shingles(t) for i, t in texts}
    ids = sorted(s)
    links = [(a, b) for a in ids for b in ids if a < b and s[a] and 100 * len(s[a] & s[b]) >= 80 * len(s[a] | s[b])]
    want = components(ids, links)
    assert {i: (r.n_shingles, r.component_id) for i, r in got.items()} == {i: (len(s[i]), want[i]) for i in ids}
    assert len(set(want.values())) < len(ids) - 20


def test_jaccard_join_of_a_chain(spark, monkeypatch):
    """A block that is one long chain of shared passages with few links: all links are found, and comparisons stay few."""
    monkeypatch.setattr(jaccard, "CELL", 8)
    monkeypatch.setattr(jaccard, "PIVOTS", 2)
    rng = random.Random(8)
    passages = [prose(rng, 30, 10**6).split() for _ in range(160)]
    rows = [(i, " ".join(passages[i] + passages[i + 1])) for i in range(159)]
    rows += [(1000 + i, " ".join(passages[i] + passages[i + 1][:-1] + ["end"])) for i in range(0, 159, 10)]
    d = jaccard.sets(frame(spark, rows))
    asked = []
    monkeypatch.setattr(jaccard.Scratch, "keep", lambda self, df, name, keep=jaccard.Scratch.keep: asked.append(df.count()) or keep(self, df, name) if name == "tiles" else keep(self, df, name))
    got = {r.doc_id: r.component_id for r in jaccard.join(frame(spark, rows)).collect()}
    s = {i: shingles(t) for i, t in rows}
    links = [(a, b) for a in s for b in s if a < b and 100 * len(s[a] & s[b]) >= 80 * len(s[a] | s[b])]
    assert got == components(sorted(s), links) and len(set(got.values())) == 159
    assert d.where("prefix is not null").count() > 150 and 0 < asked[0] < 175 * 175 / 4


def test_jaccard_join_empty_null_and_repeated(spark):
    assert jaccard.join(frame(spark, [])).collect() == []
    got = sorted((str(r.doc_id), r.n_shingles, r.component_id) for r in jaccard.join(frame(spark, [(None, "a b c"), (5, "a b c"), (5, "a b c"), (7, "a b c")])).collect())
    assert got == [("5", 1, 5), ("5", 1, 5), ("7", 1, 5), ("None", 1, None)]


def brute_suffixes(rows, width=100):
    seen, out = set(), {}
    for i, t in sorted(rows, key=lambda r: r[0]):
        b = (t or "").encode()
        gone = np.zeros(len(b), bool)
        for k in range(len(b) - width + 1):
            w = b[k : k + width]
            if w in seen:
                gone[k : k + width] = True
            seen.add(w)
        kept = np.frombuffer(b, np.uint8)[~gone].tobytes()
        starts = gone & ~np.concatenate([[False], gone[:-1]]) if len(b) else gone
        out[i] = (len(b), int(gone.sum()), int(starts.sum()), hashlib.sha256(kept).hexdigest())
    return out


@pytest.mark.parametrize("wide, hot, slice_size", [(suffixes.WIDE, suffixes.HOT, suffixes.SLICE), (2, suffixes.HOT, 50), (2, 8, 50), (suffixes.WIDE, 8, 1)])
def test_suffix_dedup(spark, texts, monkeypatch, wide, hot, slice_size):
    monkeypatch.setattr(suffixes, "BLOCK_BYTES", 5000)  # long documents are looked at in parts
    monkeypatch.setattr(suffixes, "WIDE", wide)  # minimisers of many chunks are merged in two steps
    monkeypatch.setattr(suffixes, "HOT", hot)  # those of many stretches are sampled at every window
    monkeypatch.setattr(suffixes, "SLICE", slice_size)
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in suffixes.deduplicate(frame(spark, texts)).collect()}
    assert got == brute_suffixes(texts)
    assert suffixes.deduplicate(frame(spark, [])).collect() == []
    twice = [(r.doc_id, r.n_removed) for r in suffixes.deduplicate(frame(spark, [(1, "x" + "ab" * 60), (1, "x" + "ab" * 60), (None, None)])).collect()]
    assert sorted(n for i, n in twice if i == 1) == [118, 121] or sorted(n for i, n in twice if i == 1) == [120, 121]


def test_repeats_are_read_off_shared_prefixes():
    """Against sets of windows, on texts over two letters whose minimiser is taken to be where they share 4 bytes."""
    rng = random.Random(2)
    width, gram = 10, 4
    for _ in range(40):
        entries = []
        for k in range(rng.randrange(2, 40)):
            left, suffix = "".join(rng.choice("ab") for _ in range(rng.randrange(0, 7))), "abba" + "".join(rng.choice("ab") for _ in range(rng.randrange(0, 9)))
            if len(left) + len(suffix) >= width:
                entries.append((suffix.encode(), left.encode(), k, 0, 5, k % 3))
        entries.sort()
        run = suffixes.Run([e[0] for e in entries], [0] + [suffixes.common(a[0], b[0], 0) for a, b in zip(entries, entries[1:])], [e[1] for e in entries], np.array([e[2:] for e in entries], np.int64).reshape(-1, 4))
        decoded = suffixes.Run.decode(run.encode())
        assert (decoded.suffixes, decoded.lcp, decoded.lefts, decoded.numbers.tolist()) == (run.suffixes, run.lcp, run.lefts, run.numbers.tolist())
        whole, again = suffixes.repeats(run, width, gram)
        seen = set()
        for i in sorted(range(len(entries)), key=lambda i: entries[i][2]):
            text, n = entries[i][1] + entries[i][0], len(entries[i][1])
            ds = [d for d in range(width - gram + 1) if n >= d and len(entries[i][0]) >= width - d]
            want = {d for d in ds if (text[n - d : n - d + width], d) in seen}
            seen |= {(text[n - d : n - d + width], d) for d in ds}
            assert want == (set(ds) if whole[i] else set(np.flatnonzero(again[i]).tolist()))


def test_loser_tree_orders_and_counts_prefixes():
    rng = random.Random(1)
    runs = []
    for _ in range(7):
        run = sorted(bytes(rng.choice(b"ab") for _ in range(rng.randrange(0, 9))) for _ in range(rng.randrange(0, 30)))
        runs.append((run, [0] + [suffixes.common(a, b, 0) for a, b in zip(run, run[1:])]))
    out, before = [], b""
    for r, i, shared in suffixes.LoserTree(runs):
        s = runs[r][0][i]
        assert shared == (suffixes.common(before, s, 0) if out else 0)
        out.append(s)
        before = s
    assert out == sorted(s for run, _ in runs for s in run)
    assert [s for s in suffixes.LoserTree([])] == []


ASSIGN = re.compile(r"""((?ai:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")


def brute_secrets(text):
    out = [(m.start(), 0, m.end(), "assign") for m in ASSIGN.finditer(text) if len(m[2]) >= 12]
    out += [(m.start(), 1, m.end(), "access") for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 18]
    out += [(m.start(), 2, m.end(), "hex") for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 16]
    return ",".join(f"{k}:{a}:{b}" for a, _, b, k in sorted(out))


def test_secrets(spark):
    rng = random.Random(3)
    key = lambda n, a: "".join(rng.choice(a) for _ in range(n))
    alphabet = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789"
    rows = [(i, f"é😀 w{i} the quick Token = '{key(20, '0123456789abcdef')}' AKIA{key(16, 'ABC123')} secret:short passwd=" + key(11, alphabet) + " x") for i in range(20)]
    rows += [(50, None), (51, ""), (52, " password=abcdefghijkl"), (53, "0123456789abcdef" * 2000), (54, "token=token=abcdefghijklmno api_key: \"ABCDEFGHIJKL.=-/+_\""), (55, "key " + key(44, alphabet) + " end")]
    rows += [(56, "donaudampfschifffahrtsgesellschaft unconstitutionalities")]
    got = {r.doc_id: r for r in secrets.digest(secrets.scan(frame(spark, rows))).collect()}
    for i, t in rows:
        want = brute_secrets(t or "")
        assert got[i].base_sha256 == hashlib.sha256(want.encode()).hexdigest(), (i, want)
        assert set(filter(None, want.split(","))) <= set(got[i].spans.split(","))
    assert "random:4:48" in got[55].spans
    assert got[56].spans == ""
    clean = {r.doc_id: r for r in secrets.redact(frame(spark, rows)).collect()}
    assert clean[50].text is None and clean[55].text == "key [secret] end" and clean[55].n_chars == len("key [secret] end")
    assert all(brute_secrets(r.text or "") == "" for r in clean.values())
    assert secrets.scan(frame(spark, [])).collect() == []


def test_secrets_in_very_many_places(spark):
    """Places add up without a fold over all matches, and odd rows are judged each."""
    rng = random.Random(4)
    many = " ".join("".join(rng.choice("0123456789abcdef") for _ in range(rng.randrange(1, 40))) + rng.choice(["", " é", " token=abcdefghijklmnop"]) for _ in range(3000))
    rows = [(1, many), (None, many), (1, many), (2, "0123456789abcdef"), (3, "x"), (4, "a b 0123456789abcdef0 c")]
    got = [(r.doc_id, r.base_sha256) for r in secrets.digest(secrets.scan(frame(spark, rows))).collect()]
    assert sorted(map(str, got)) == sorted(str((i, hashlib.sha256(brute_secrets(t).encode()).hexdigest())) for i, t in rows)
    began = time.time()
    assert secrets.scan(frame(spark, [(1, "0123456789abcdef " * 16000)])).select(F.size("base")).first()[0] == 16000
    assert time.time() - began < 20


def exact_battery(v):
    """The battery's p-values by exact tails, with numpy and math alone."""
    import math

    n, kind = len(v), lambda c: 0 if c.isdigit() else 1 if c.islower() else 2 if c.isupper() else 3
    size = 16 if re.fullmatch("[0-9a-f]+|[0-9A-F]+", v) else 26 if re.fullmatch("[a-z]+|[A-Z]+", v) else 32 if re.fullmatch("[A-Z2-7]+=*", v) else 36 if re.fullmatch("[a-z0-9]+|[A-Z0-9]+", v) else 62 if v.isalnum() else 64
    chi = sum(v.count(c) ** 2 for c in set(v)) * size / n - n
    tail = lambda z: math.erfc(abs(z) / math.sqrt(2))

    def chi_upper(x, df):  # by numerical integration of the density
        grid = np.linspace(x, x + 40 * math.sqrt(2 * df) + 200, 200001)
        density = np.exp((df / 2 - 1) * np.log(np.maximum(grid, 1e-300)) - grid / 2 - df / 2 * math.log(2) - math.lgamma(df / 2))
        return float(np.trapezoid(density, grid))

    c = np.array([ord(x) for x in v], float)
    d = c - c.mean()
    serial = (d[:-1] * d[1:]).sum() / (d * d).sum()
    if size == 26:
        kind = lambda c: c.lower() < "n"
    digit = {16: 10 / 16, 26: 0.5, 32: 6 / 32, 36: 10 / 36, 62: 10 / 62, 64: 10 / 64}[size]
    letter = (1 - digit) / (2 if size > 60 else 1)
    two = 1 - digit**2 - letter**2 * (2 if size > 60 else 1)
    changes = sum(kind(a) != kind(b) for a, b in zip(v, v[1:]))
    runs = tail((changes - (n - 1) * two) / math.sqrt((n - 1) * two * (1 - two)))
    ps = [chi_upper(chi, size - 1), runs, tail(serial * math.sqrt(n))]
    return ps, chi_upper(-2 * sum(math.log(max(p, 1e-300)) for p in ps), 6)


def test_battery_against_exact_tails(spark):
    rng = random.Random(7)
    alphabets = ["0123456789abcdef", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567", "abcdefghijklmnopqrstuvwxyz0123456789", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/"]
    tokens = ["".join(rng.choice(a) for _ in range(n)) for a in alphabets for n in (20, 33, 64, 200)] + ["unconstitutionalitiesofthings", "aaaaaaaaaabbbbbbbbbbcccccc1111"]
    got = {r.v: r for r in secrets.battery(spark.createDataFrame([(t,) for t in tokens], "v string")).collect()}
    for v in tokens:
        ps, combined = exact_battery(v)
        r = got[v]
        for p, q in zip([*ps, combined], [r.p_uniform, r.p_runs, r.p_serial, r.p_random]):
            assert abs(p - q) < 0.01 + 0.05 * p, (v, p, q)
        assert 0 <= r.p <= 1
    assert got[tokens[-1]].p == 1 and got[tokens[15]].p < 1e-6  # not random; 200 of base 62


def test_long_keys_of_one_kind(spark):
    """Random keys of small letters alone are found when long, by how uniform their letters are; written ones aren't."""
    rng = random.Random(9)
    key = "".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(160))
    prose_like = "".join(rng.choices("etaoinshrdlcumwfgypbvkjxqz", [127, 91, 82, 75, 70, 67, 63, 61, 60, 43, 40, 28, 28, 24, 24, 22, 20, 20, 19, 15, 10, 8, 2, 2, 1, 1], k=160))
    got = {r.doc_id: r.spans for r in secrets.digest(secrets.scan(frame(spark, [(1, f"key {key} end"), (2, f"the {prose_like} end"), (3, None)]))).collect()}
    assert "random:4:164" in got[1] and got[2] == "" and got[3] == ""


BASE = {"gnu general public license": "gpl", "apache license": "apache", "cc by": "cc-by", "mit license": "mit"}


def test_licenses(spark):
    rows = [(1, None), (2, ""), (3, "The MIT-License, CC BY 4.0 and\nGNU General Public License. mit license"), (4, "ümit license mitlicense"), (5, "word " * 20000 + "Apache License"), (6, "Redistribution and use in source and binary forms"), (7, "GNU Lesser General Public License version 2.1 or later")]
    got = {r.doc_id: r for r in licenses.scan(frame(spark, rows)).collect()}
    for i, t in rows:
        low = re.sub("[A-Z]", lambda m: m[0].lower(), t or "")
        w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)
        at = [(k, label) for p, label in BASE.items() for k in range(len(w)) if w[k : k + len(p.split())] == p.split()]
        r = got[i]
        assert (r.n_words, r.n_base, r.first_word, r.last_word) == (len(w), len(at), min(at)[0] if at else None, max(at)[0] if at else None)
        assert r.base_labels == ",".join(sorted({x for _, x in at}))
        assert set(filter(None, r.base_labels.split(","))) <= set(r.labels.split(",")) and 0 <= r.score <= 1
    assert got[6].labels == "bsd" and got[7].labels == "lgpl-2.1+"
    assert len(licenses._SINGLE) > 190 and len(licenses.rules()) > 600


def test_license_containment():
    scanner = licenses.Scanner()
    text = "gnu lesser general public license version 2.1 or later"
    found = scanner.detect(text, range(len(scanner.rules)))
    assert [r.label for _, _, r in found] == ["lgpl-2.1+"]


def test_license_containment_against_brute_force():
    """Suppression is that of comparing every detection with all kept ones, and fast on very many."""
    rng, scanner = random.Random(6), licenses.Scanner()
    for _ in range(30):
        text = " ".join(rng.choice(["gnu", "lesser", "general public license", "version 2.1", "or later", "mit license", "the", "copyright 20", "apache license"]) for _ in range(40))
        found = [(r, m.start(), m.end(), i) for i, (r, c) in enumerate(zip(scanner.rules, scanner.compiled)) for m in c.finditer(text)]
        found.sort(key=lambda x: (-x[0].priority, -(x[2] - x[1]), x[1], x[3]))
        kept = []
        for rule, a, b, _ in found:
            if not any(s <= a and b <= e for s, e, _ in kept):
                kept.append((a, b, rule))
        assert scanner.detect(text, range(len(scanner.rules))) == sorted(kept, key=lambda x: (x[0], x[1]))
    ids = [i for i, r in enumerate(scanner.rules) if r.keyword == "copyright"]
    began = time.process_time()
    assert len(scanner.detect("copyright " * 16000, ids)) == 16000
    assert time.process_time() - began < 3


def test_licenses_odd_rows(spark):
    """Empty tables, null ids and repeated rows."""
    assert licenses.scan(frame(spark, [])).collect() == []
    got = [(r.doc_id, r.labels) for r in licenses.scan(frame(spark, [(None, "MIT License"), (1, "MIT License"), (1, "MIT License")])).collect()]
    assert sorted(map(str, got)) == sorted(map(str, [(None, "mit"), (1, "mit"), (1, "mit")]))


def test_decontamination(spark, monkeypatch):
    rng = random.Random(11)
    items = [(i, prose(rng, 30, 3000)) for i in range(12)] + [(20, "two words"), (21, ""), (22, None)]
    edit = lambda t, n: " ".join(w if k % n else "changed" for k, w in enumerate(t.split()))
    rows = [(i, prose(rng, 200, 3000) + " " + (items[i % 12][1].upper() if i % 3 == 0 else edit(items[i % 12][1], 7)) + " " + prose(rng, 50, 3000)) for i in range(24)]
    rows += [(100 + i, prose(rng, 250, 3000)) for i in range(60)] + [(200, None), (201, ""), (202, "just Two, words here")]
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = {(r.doc_id, r.item_id): r.score for r in decontaminate.decontaminate(frame(spark, rows), bench).collect()}
    assert set(got) == {(i, i % 12) for i in range(24)} | {(202, 20)}
    assert all(got[i, i % 12] == 1 for i in range(0, 24, 3))
    kept = {r.doc_id for r in decontaminate.clean(frame(spark, rows), bench).collect()}
    assert kept == {i for i, _ in rows} - {i for i, _ in got}
    assert decontaminate.decontaminate(frame(spark, rows), bench.limit(0)).collect() == []
    # items and documents without an id are found like others, and several blocks of the benchmark find the same
    nameless = bench.withColumn("item_id", F.lit(None).cast("long"))
    assert {r.doc_id for r in decontaminate.decontaminate(frame(spark, rows), nameless).collect()} == {i for i, _ in got}
    assert {r.doc_id for r in decontaminate.clean(frame(spark, rows), nameless).collect()} == kept
    assert [r.item_id for r in decontaminate.decontaminate(frame(spark, [(None, items[3][1])] * 2), bench).collect()] == [3, 3]
    monkeypatch.setattr(decontaminate, "item_blocks", lambda b, blocks=decontaminate.item_blocks, **k: blocks(b, 20, **k))
    monkeypatch.setattr(decontaminate, "BLOCKS_AT_ONCE", 2)
    assert {r.doc_id for r in decontaminate.clean(frame(spark, rows), bench).collect()} == kept
    assert {(r.doc_id, r.item_id): r.score for r in decontaminate.decontaminate(frame(spark, rows), bench).collect()} == got
    assert decontaminate.decontaminate(frame(spark, []), bench).collect() == []


def brute_alignment(a, b):
    h = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    best = 0
    for i in range(1, len(a) + 1):
        for j in range(1, len(b) + 1):
            h[i][j] = max(0, h[i - 1][j - 1] + (2 if a[i - 1] == b[j - 1] else -1), h[i - 1][j] - 1, h[i][j - 1] - 1)
            best = max(best, h[i][j])
    return best


def test_alignment():
    rng = np.random.default_rng(2)
    for _ in range(50):
        a, b = rng.integers(0, 5, rng.integers(1, 12)).astype(np.uint64), rng.integers(0, 5, rng.integers(1, 20)).astype(np.uint64)
        assert decontaminate.align(a, b)[0] == brute_alignment(a.tolist(), b.tolist())


def test_decontamination_finds_what_alignment_finds(spark):
    """However often an item is leaked whole, edited copies are found as by Smith-Waterman on every document."""
    rng = random.Random(13)
    items = [(i, prose(rng, 40, 3000)) for i in range(8)] + [(8, " ".join(f"w{k % 7}" for k in range(24)))]
    third = lambda w: [x if k % 3 else f"new{rng.randrange(10**6)}" for k, x in enumerate(w)]
    rows = []
    for i, t in items:
        w = t.split()
        m = len(w) // 2
        copies = [third(w[:m]) + w[m:], w[:m] + third(w[m:]), [x for k in w for x in (k, "between")], [x for k, x in enumerate(w) if k % 4], third(w), w[:m]]
        copies += [w] * (30 if i < 4 else 0)
        rows += [(100 * i + k, prose(rng, 60, 3000) + " " + " ".join(c) + " " + prose(rng, 20, 3000)) for k, c in enumerate(copies)]
    rows += [(5000 + i, prose(rng, 300, 3000)) for i in range(200)]
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = {(r.doc_id, r.item_id): r.score for r in decontaminate.decontaminate(frame(spark, rows), bench).collect()}
    words = {i: decontaminate.text_words(t) for i, t in items}
    want = {(d, i): decontaminate.align(w, decontaminate.text_words(t))[0] / (2 * len(w)) for d, t in rows for i, w in words.items()}
    assert got == {k: s for k, s in want.items() if s >= 0.5}
    assert {(100 * i + k, i) for i in range(8) for k in range(4)} <= set(got)


def test_short_items_by_their_score_alone(spark):
    """Without the rule of words in a row, items of any length are found as by Smith-Waterman on every document."""
    rng = random.Random(17)
    items = [(i, prose(rng, n, 40)) for i, n in enumerate((1, 2, 3, 4, 5, 6, 7, 7, 7, 9, 12))] + [(50, "a b c d e f g")]
    rows = [(i, prose(rng, 25, 40)) for i in range(150)] + [(900, "x a b y d e x g z"), (901, ""), (902, None)]
    bench = spark.createDataFrame(items, "item_id long, text string")
    words = {i: decontaminate.text_words(t) for i, t in items}
    want = {(d, i): brute_alignment(w.tolist(), decontaminate.text_words(t or "").tolist()) / (2 * len(w)) for d, t in rows for i, w in words.items()}
    want = {k: s for k, s in want.items() if s >= 0.5}
    got = {(r.doc_id, r.item_id): r.score for r in decontaminate.decontaminate(frame(spark, rows), bench, short_run=0).collect()}
    assert got == want and (900, 50) in want
    assert {r.doc_id for r in decontaminate.clean(frame(spark, rows), bench, short_run=0).collect()} == {d for d, _ in rows} - {d for d, _ in want}
    by_run = {(r.doc_id, r.item_id) for r in decontaminate.decontaminate(frame(spark, rows), bench).collect()}
    assert by_run < set(want) and (900, 50) not in by_run


def matches_of(pattern):
    """Texts that a rule's pattern matches, one for each choice of alternatives, with `|` for a run of separators."""
    pattern = pattern.removeprefix(licenses._NOT_IN_WORD).removesuffix(licenses._WORD_ENDS).replace(licenses._EXPRESSION, " or ")
    pattern = pattern.replace(licenses._SEP, "\x00").replace(licenses._NO_MINOR, "").replace(licenses._NO_MORE, "").replace(licenses._BESIDE, " ").replace("\\+", "+").replace("\\.", ".")
    parts = [[p] if not p.startswith("(?:") else ([p[3:-2], ""] if p.endswith("?") else p[3:-1].split("|")) for p in re.split(r"(\(\?:[^()]*\)\??)", pattern)]
    for choice in itertools.product(*parts):
        yield "".join(choice)


def test_license_prefilter_loses_nothing():
    """What every rule matches gets through the prefilter, however its words are separated."""
    scanner = licenses.Scanner()
    tried = 0
    for i, (rule, compiled) in enumerate(zip(scanner.rules, scanner.compiled)):
        for t in matches_of(rule.pattern):
            for separator in (" ", "\n", "\n * ", "-"):
                text = t.replace("\x00", separator)
                assert compiled.search(text), (rule, text)
                low = np.frombuffer(b"x " + text.encode() + b"license", np.uint8)
                cut = np.array([0, 2, 2 + len(text.encode()), len(low)])
                assert i in scanner.prefilter(*scanner.spaced(low, cut)).get(1, []), (rule, text)
                tried += 1
    assert tried > 1000


def test_wrapped_license_headers(spark):
    rows = [(1, "GNU Lesser\n * General  Public License"), (2, "Permission is hereby\n# granted, free of charge, to any person obtaining a copy"), (3, "This software is provided 'as is', without any express or implied warranty"), (4, "Non Profit Open Software License"), (5, "under the terms of the GNU Lesser General Public License"), (6, "redistribution"), (7, "and use in source and binary forms")]
    got = {r.doc_id: r.labels for r in licenses.scan(frame(spark, rows)).collect()}
    assert got == {1: "lgpl", 2: "mit", 3: "zlib", 4: "nposl", 5: "lgpl", 6: "", 7: ""}


def test_license_versions_as_they_are_written():
    scanner = licenses.Scanner()
    labels = lambda t: [r.label for _, _, r in scanner.detect(t.lower(), range(len(scanner.rules)))]
    for stem, _, names, _, versions in licenses._VERSIONED:
        name = names[0].replace("{license|licence}", "License").replace("?", "")
        for v in versions:
            said = [f"version {v}", f"v{v}", f"v {v}", f"Version\n{v}."] + ([f"version {v[:-2]}", f"v{v[:-2]}", f"version {v[:-2]}."] if v.endswith(".0") else [])
            for s in said:
                assert f"{stem}-{v}" in labels(f"{name}, {s}"), (name, s)
                assert f"{stem}-{v}+" in labels(f"{name}, {s} or later"), (name, s)
    assert labels("GNU General Public License, version 3.") == ["gpl-3.0"] == labels("GNU General Public License v3.0")
    assert labels("Academic Free License version 2.1") == ["afl-2.1"] and labels("PHP License, version 3.01") == ["php-3.01"]
    assert labels("GNU General Public License version 2.1") == ["gpl"] == labels("GNU General Public License version 30")
    assert labels("Mozilla Public License\n1. Definitions\n1.1. Contributor") == ["mpl"] == labels("Mozilla Public License 2.0.1")


def test_license_names_as_they_are_written():
    """The more exact of labels at a place is kept; tags, abbreviations and both spellings are known."""
    scanner = licenses.Scanner()
    want = {
        "Licensed under the Apache License, Version 2.0": ["apache-2.0"], "http://www.apache.org/licenses/LICENSE-2.0": ["apache-2.0"], "Apache License 2.0": ["apache-2.0"],
        "Mozilla\nPublic License 2.0": ["mpl-2.0"], "MPL-1.1": ["mpl-1.1"], "LGPL 2.1": ["lgpl-2.1"], "GPL 3": ["gpl-3.0"],
        "GPL-2.0-or-later": ["gpl-2.0+"], "GPL-2.0-only": ["gpl-2.0"], "GPLv2+": ["gpl-2.0+"], "GPLv3": ["gpl-3.0"], "GNU GPL v3 or any later version": ["gpl-3.0+"],
        "GNU Lesser General Public License, version 2.1 (or, at your option, any later version)": ["lgpl-2.1+"],
        "MIT Licence": ["mit"], "the ISC licence": ["isc"], "PHP Licence, version 3.01": ["php-3.01"], "Q Public Licence version 1.0": ["qpl-1.0"],
        "BSD-3-Clause": ["bsd-3-clause"], "BSD 2-Clause License": ["bsd-2-clause"], "3-clause BSD": ["bsd-3-clause"],
        "SPDX-License-Identifier: MIT": ["mit"], "SPDX-License-Identifier: MIT-0": ["mit-0"], "SPDX-License-Identifier: CC-BY-SA-4.0": ["cc-by-sa-4.0"], "SPDX-License-Identifier: GPL-2.0+": ["gpl-2.0+"],
        "SPDX-License-Identifier: GPL-2.0-or-later OR MIT OR Apache-2.0": ["gpl-2.0+", "mit", "apache-2.0"], "SPDX-License-Identifier: (MIT AND BSD-3-Clause)\nand ISC": ["mit", "bsd-3-clause"],
        "SPDX-License-Identifier: Nobody-1.0": ["unknown-license"],
    }
    assert {t: [r.label for _, _, r in scanner.detect(t.lower(), range(len(scanner.rules)))] for t in want} == want
    began = time.process_time()
    marks = "spdx-license-identifier: mit or isc " * 3000
    ids = [i for i, r in enumerate(scanner.rules) if r.keyword.startswith("spdx") and r.label in ("mit", "isc", "zlib")]
    assert len(scanner.detect(marks, ids)) == 6000 and len(scanner.detect("spdx-license-identifier: mit " + "word " * 200000 + "or isc", ids)) == 2
    assert time.process_time() - began < 3
