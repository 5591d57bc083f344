"""Classifiers, packing, archives, embeddings and the pipeline."""

import hashlib
import re
import tracemalloc
import zlib
from types import SimpleNamespace

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tidemark.llm import embeddings, features, packing, quality, toxicity, warc
from tidemark.llm.queries import table
from tidemark.llm.shared import components, new_path

SF = "/root/testdata/sf0.01"


def test_factorisation_identity():
    rng = np.random.default_rng(0)
    m = quality.Machine(0.3, rng.normal(size=20), rng.normal(size=(20, 4)))
    index, x = np.array([1, 5, 7, 2, 2]), np.array([0.5, 1.0, -2.0, 1.0, 3.0])
    got = m.margin(np.array([0, 3, 5]), index, x)
    pairs = lambda ids, v: sum(m.v[ids[a]] @ m.v[ids[b]] * v[a] * v[b] for a in range(len(ids)) for b in range(a + 1, len(ids)))
    assert np.allclose(got, [0.3 + m.w[index[:3]] @ x[:3] + pairs(index[:3], x[:3]), 0.3 + m.w[index[3:]] @ x[3:] + pairs(index[3:], x[3:])])


def test_quality_on_held_out_rows(spark):
    docs, labels = table(spark, SF, "documents"), table(spark, SF, "labels")
    machine = quality.train(docs, labels, allowed=~quality.held_out(F.col("doc_id")))
    got = quality.score(docs, machine).join(labels, "doc_id").toPandas()
    own = got[got["held_out"]]
    assert (own["held_out"] == [zlib.crc32(str(i).encode()) % 5 == 0 for i in own["doc_id"]]).all()
    assert ((own["score"] >= 0.3) == own["predicted"]).all() and got["score"].between(0, 1).all()
    assert (own["predicted"] == own["quality"]).mean() > 0.93
    odd = spark.createDataFrame([(1, None, 9), (2, "", 9), (None, "x " * 50000, 9)], "doc_id long, text string, score long")
    assert [r.score is not None for r in quality.score(odd, machine).collect()] == [True] * 3
    assert quality.filter_documents(odd, machine).columns == odd.columns
    constant = quality.train(docs, labels.where("quality = 1"))
    assert quality.score(odd, constant).where("score > 0.9").count() == 3
    assert quality.score(docs.limit(0), machine).count() == 0


def test_toxicity(spark):
    docs, labels = table(spark, SF, "documents"), table(spark, SF, "labels")
    model = toxicity.train(docs, labels)
    assert (np.diff(model.theta) > 0).all()
    got = toxicity.score(docs, model).join(labels, "doc_id").toPandas()
    assert (got["is_toxic"] == (got["toxic"] == 1)).mean() > 0.97
    assert got["expected_severity"].between(0, toxicity.GRADES - 1).all()
    odd = spark.createDataFrame([(1, None), (2, "")], "doc_id long, text string")
    assert [r.is_toxic for r in toxicity.score(odd, model).collect()] == [False, False]
    assert toxicity.score(odd, toxicity.train(docs, labels.limit(0))).count() == 2


def test_toxicity_on_held_out_rows(spark):
    """Fitted without a fifth of the labelled rows, it ranks and tells them; odd rows are scored."""
    docs, labels = table(spark, "/root/testdata/sf0.1", "documents"), table(spark, "/root/testdata/sf0.1", "labels")
    model = toxicity.train(docs, labels, allowed=~quality.held_out(F.col("doc_id")))
    got = toxicity.score(docs, model).join(labels.where(quality.held_out(F.col("doc_id"))), "doc_id").toPandas()
    toxic, clean = got[got["toxic"] == 1]["expected_severity"], got[got["toxic"] == 0]["expected_severity"]
    assert len(toxic) > 20 and len(clean) > 500
    assert np.mean([(x > clean).mean() + (x == clean).mean() / 2 for x in toxic]) > 0.95  # some labels are wrong
    assert (got["is_toxic"] == (got["toxic"] == 1)).mean() > 0.97
    odd = spark.createDataFrame([(None, "x", 1, 2.0), (3, "y " * 200000, 1, 2.0), (3, None, 1, 2.0)], "doc_id long, text string, severity int, p_toxic double")
    assert sorted(str(r.doc_id) for r in toxicity.score(odd, model).collect()) == ["3", "3", "None"]
    assert toxicity.score(odd.limit(0), model).collect() == []


def test_training_rows_are_bounded(spark):
    """Rows that repeat a labelled doc_id count once."""
    docs = spark.createDataFrame([(1, f"text {k % 7}") for k in range(3000)] + [(2, None), (3, "c"), (None, "d")], "doc_id long, text string")
    labels = spark.createDataFrame([(1, 1), (1, 0), (2, 0), (3, None), (None, 1)] * 3, "doc_id long, quality int")
    got = features.training_rows(docs, labels, "quality", 10).collect()
    assert sorted((r.doc_id, r.text, r.y) for r in got if r.text) == [(1, "text 0", 1)] and {(r.doc_id, r.y) for r in got} == {(1, 1), (2, 0)}
    machine = quality.train(docs, labels)
    assert quality.score(docs, machine).count() == 3003


def test_ordinal_gradient_orders_grades():
    rng = np.random.default_rng(1)
    grade = rng.integers(0, 4, 400)
    row = np.repeat(np.arange(400), 2)
    word = np.stack([grade * 3 + 1, rng.integers(20, 40, 400)], 1).ravel()
    model = toxicity.fit(grade, row, word, np.ones(800))
    z = np.bincount(row, np.array([model.w[np.searchsorted(model.buckets, w)] if w in model.buckets else 0 for w in word]), 400)
    p, expected = model.expected(z)
    assert np.allclose(p.sum(1), 1) and (np.diff([expected[grade == g].mean() for g in range(4)]) > 0.3).all()


def ordinal_loss(w, theta, x, grade):
    """Mean negative log likelihood of grades, a row at a time."""
    total = 0.0
    for row, g in zip(x, grade):
        below = [0.0] + [1 / (1 + np.exp(-(t - row @ w))) for t in theta] + [1.0]
        total -= np.log(max(below[g + 1] - below[g], 1e-9))
    return total / len(grade)


def test_ordinal_fit_against_plain_likelihood():
    """A step goes down every slope that differences of the likelihood show, and the whole fit gets as low as plain descent."""
    rng = np.random.default_rng(8)
    x = rng.integers(0, 3, (60, 5)).astype(float)
    grade = np.clip(np.round(x @ [1.0, 0.5, 0, 0, -0.7] + rng.normal(0, 0.7, 60)), 0, 3).astype(int)
    row, word = np.nonzero(x)
    share = np.cumsum(np.bincount(grade, minlength=4) + 0.5)[:3] / 62
    par = np.concatenate([np.zeros(5), np.log(share / (1 - share))])
    loss = lambda p: ordinal_loss(p[:5], p[5:], x, grade)
    slope = lambda p: np.array([(loss(p + e) - loss(p - e)) / 2e-5 for e in np.eye(8) * 1e-5])
    step = toxicity.fit(grade, row, word, x[row, word], l1=0, steps=1, rate=1e-3)
    g = slope(par)
    assert step.buckets.tolist() == list(range(5)) and (np.sign(step.w) == -np.sign(g[:5])).all()
    assert np.sign(step.theta[0] - par[5]) == -np.sign(g[5:].sum())  # the first threshold carries the others
    for _ in range(400):
        par = par - 0.3 * slope(par)
    model = toxicity.fit(grade, row, word, x[row, word], l1=0)
    assert ordinal_loss(model.w, model.theta, x, grade) < loss(par) + 0.01 < ordinal_loss(np.zeros(5), np.log(share / (1 - share)), x, grade)


def machine_loss(m, x, y):
    """Mean logistic loss of a factorisation machine, all pairs of features one by one."""
    total = 0.0
    for row, label in zip(x, y):
        pairs = sum(m.v[i].astype(float) @ m.v[j] * row[i] * row[j] for i in range(len(row)) for j in range(i))
        p = 1 / (1 + np.exp(-(m.w0 + m.w.astype(float) @ row + pairs)))
        total -= np.log(p if label else 1 - p)
    return total / len(y)


def test_machine_fit_against_plain_likelihood():
    """A step goes down every slope that differences of the loss show; what only pairs of features tell is learnt."""
    rng = np.random.default_rng(9)
    x = rng.integers(0, 2, (60, 4)) * rng.uniform(0.5, 2, (60, 4))
    x[:, 0] = 1
    y = rng.integers(0, 2, 60).astype(float)
    row, index = np.nonzero(x)
    fit = lambda rate: quality.fit(y, np.searchsorted(row, np.arange(61)), index, x[row, index], 4, rank=2, epochs=1, least_steps=1, rate=rate, decay=0)
    before, after = fit(0.0), fit(1e-2)
    before = quality.Machine(before.w0, before.w.astype(float), before.v.astype(float))

    def slope(part, at):
        values = []
        for e in (1e-4, -1e-4):
            moved = quality.Machine(before.w0, before.w.copy(), before.v.copy())
            getattr(moved, part)[at] += e
            values.append(machine_loss(moved, x, y))
        return (values[0] - values[1]) / 2e-4

    for i in range(4):
        assert np.sign(after.w[i] - before.w[i]) == -np.sign(slope("w", i))
        for f in range(2):
            assert np.sign(after.v[i, f] - before.v[i, f]) == -np.sign(slope("v", (i, f)))
    up, down = quality.Machine(before.w0 + 1e-4, before.w, before.v), quality.Machine(before.w0 - 1e-4, before.w, before.v)
    assert np.isclose((before.w0 - after.w0) / 1e-2, (machine_loss(up, x, y) - machine_loss(down, x, y)) / 2e-4, atol=1e-6)
    a, b = rng.integers(0, 2, 400), rng.integers(0, 2, 400)
    index = np.stack([a, 2 + b], 1).ravel()  # the label is whether a and b differ: no single feature tells
    machine = quality.fit((a != b).astype(float), np.arange(0, 801, 2), index, np.ones(800), 4)
    assert ((machine.margin(np.arange(0, 801, 2), index, np.ones(800)) > 0) == (a != b)).all()


@pytest.fixture(scope="module")
def tokenizer():
    return packing.WordTokenizer(packing.tokenizer_path())


def test_word_tokenizer_is_the_tokenizer(spark, tokenizer):
    odd = ["it's  'SS ''t <|endoftext|> hi", "x\x1cy\x85z\xa0 ²³½ ªµº «ñ» İstanbul ÀÉ 'LL don''t", "", "emoji 😀 é é", "a_b-c…", "\x00\x1f\x7f", "$$$%%% 12345"]
    for t in odd + [r.text for r in table(spark, SF, "documents").select("text").limit(150).collect()]:
        assert tokenizer.ids(t).tolist() == tokenizer.tokenizer.encode(t, add_special_tokens=False).ids


def test_plan_holds_every_piece():
    rng = np.random.default_rng(4)
    for capacity, lengths in ((10, [1, 3, 4, 10]), (100, sorted(rng.choice(np.arange(1, 101), 40, replace=False)))):
        counts = rng.integers(1, 60, len(lengths))
        bins, _ = packing.plan_bins(np.array(lengths), counts, capacity)
        used = np.zeros(len(lengths), int)
        for times, config in bins:
            assert sum(lengths[i] * n for i, n in config.items()) <= capacity
            for i, n in config.items():
                used[i] += times * n
        assert (used == counts).all()
        volume = (np.array(lengths) * counts).sum()
        best_fit = sum(n for n, _ in packing.best_fit(np.array(lengths), counts, capacity))
        assert -(-volume // capacity) <= sum(n for n, _ in bins) <= 1.02 * best_fit


def test_knapsack_and_program_against_brute_force():
    rng = np.random.default_rng(5)
    fillings = lambda lengths, room, i=0: [()] if i == len(lengths) else [(n, *rest) for n in range(room // lengths[i] + 1) for rest in fillings(lengths, room - n * lengths[i], i + 1)]
    for _ in range(30):
        capacity = int(rng.integers(8, 30))
        lengths = np.sort(rng.choice(np.arange(2, capacity + 1), int(rng.integers(2, 5)), replace=False))
        value = rng.random(len(lengths))
        every = np.array(fillings(lengths.tolist(), capacity))
        best, take = packing._knapsack(lengths, value, capacity)
        assert np.isclose(best[capacity], (every @ value).max())
        config = packing._trace(take, lengths, capacity)
        assert np.isclose(sum(value[i] * n for i, n in config.items()), best[capacity])
        # nothing is covered more than once, and where everything can be filled to the brim nearly all is covered
        counts = rng.integers(50, 500, len(lengths))
        solution = packing.solve(lengths, counts, capacity)
        covered = np.zeros(len(lengths))
        for x, config in solution:
            assert x > 0 and sum(lengths[i] * n for i, n in config.items()) <= capacity
            for i, n in config.items():
                covered[i] += x * n
        assert (covered <= counts * (1 + 1e-6)).all()
    lengths, counts = np.array([3, 4, 5, 6, 7]), np.array([100, 200, 300, 200, 100])
    solution = packing.solve(lengths, counts, 10)  # 3 + 7, 4 + 6 and 5 + 5 fill all
    assert 0.9 * 450 <= sum(x for x, _ in solution) <= 450 * (1 + 1e-6)


def test_program_places_most_tokens(spark):
    """At 10,000 documents most tokens are placed by the rounded program, in no more sequences than by best fit alone."""
    found = packing.pieces(table(spark, "/root/testdata/sf0.1", "documents"), packing.tokenizer_path()).groupBy("length").count().toPandas().sort_values("length")
    lengths, counts = found["length"].to_numpy(), found["count"].to_numpy()
    bins, by_program = packing.plan_bins(lengths, counts)
    assert by_program > 0.6
    assert sum(n for n, _ in bins) <= sum(n for n, _ in packing.best_fit(lengths, counts, 4096))


def test_latin_words_are_the_regular_expression():
    rng = np.random.default_rng(9)
    letter, number, space = r"a-zA-Z\xaa\xb5\xba\xc0-\xd6\xd8-\xf6\xf8-\xff", r"0-9\xb2\xb3\xb9\xbc-\xbe", r"\t-\r \x85\xa0"
    word = re.compile(rf"'s|'t|'re|'ve|'m|'ll|'d|[{letter}]+|[{number}]|[^{space}{letter}{number}]+")
    for alphabet in ("'stmdrevlx 1.", "'l ", "".join(map(chr, range(256))), "'re\n"):
        texts = ["".join(rng.choice(list(alphabet), rng.integers(0, 40))).lower().encode("latin-1") for _ in range(300)]
        off = np.concatenate([[0], np.cumsum([len(t) for t in texts])])
        raw = b"".join(texts)
        s, e = packing.latin_words(np.frombuffer(raw, np.uint8), off)
        assert [raw[a:z].decode("latin-1") for a, z in zip(s, e)] == [w for t in texts for w in word.findall(t.decode("latin-1"))]


def test_packing(spark, tokenizer):
    rows = [(1, None), (2, ""), (3, "word " * 9000), (None, "a b"), (5, "same text"), (5, "same text")] + [(10 + i, "tok " * (i * 37 % 4000)) for i in range(60)]
    docs = spark.createDataFrame([(i, t, 1) for i, t in rows], "doc_id long, text string, length int")
    got = packing.pack(docs).toPandas()
    want = sorted((-1 if i is None else i, k, 4096 * k, len(p) // 4, zlib.crc32(p)) for i, t in rows for ids in [np.append(tokenizer.ids(t or ""), np.uint32(1)).astype("<u4").tobytes()] for k in range(-(-len(ids) // 16384)) for p in [ids[16384 * k : 16384 * (k + 1)]])
    assert sorted(zip(got["doc_id"].fillna(-1).astype(int), got["piece"], got["start"], got["length"], got["ids_crc32"])) == want
    for _, s in got.sort_values("offset").groupby("sequence_id"):
        assert s["offset"].tolist() == [0, *s["length"].cumsum().tolist()][:-1] and s["length"].sum() <= 4096
    assert got["sequence_id"].nunique() <= -(-got["length"].sum() // 4096) + 1
    assert packing.pack(docs.limit(0)).count() == 0


def test_archives_round_trip(spark):
    big = "<p>ü \r\n\r\nWARC/1.1\r\nContent-Length: 5</p>" * 40
    rows = [(1, "http://a/?x=1", big), (2, None, big), (7, "http://b\r\nX: y", big), (3, "u", "small"), (4, "u", "small"), (5, "u", None), (6, "u", ""), (-8, "u", big + "x")]
    pages = spark.createDataFrame([(*r, "z") for r in rows], "page_id long, url string, html string, payload_digest string")
    got = {r.page_id: r for r in warc.round_trip(spark, pages).collect()}
    for i, _, t in rows:
        data = (t or "").encode()
        again = t == big and i != 7
        assert (got[i].payload_bytes, got[i].payload_digest, got[i].record_type, got[i].refers_to) == (len(data), hashlib.sha1(data).hexdigest(), "revisit" if again else "response", 7 if again else None)
        assert got[i].has_metadata and got[i].request_line.startswith("GET ")
    assert warc.round_trip(spark, pages.limit(0)).count() == 0


def test_archives_keep_every_row(spark, tmp_path):
    """Rows with a repeated or null page_id are captures of their own, by the query's SQL."""
    import duckdb

    from tidemark.llm.queries import ORACLE_SQL

    big, other = "<p>big</p>" * 200, "<p>other</p>" * 200
    rows = [(1, "a", big), (1, "a", big), (1, "b", big), (5, "c", big), (5, "c", big), (2, "d", "x"), (2, "d", "y"), (3, "e", other), (3, "e", big), (None, "f", big), (None, "f", "z"), (None, "g", None), (None, None, None)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    key = lambda r: tuple(str(x) for x in r)
    got = [(r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in warc.round_trip(spark, pages).collect()]
    con = duckdb.connect()
    con.execute("CREATE TABLE pages (page_id BIGINT, url VARCHAR, html VARCHAR)")
    con.executemany("INSERT INTO pages VALUES (?, ?, ?)", rows)
    assert sorted(got, key=key) == sorted(con.execute(ORACLE_SQL["op7_warc"]).fetchall(), key=key)
    warc.write_archives(pages, f"file://{tmp_path}/w")
    records = warc.read_records(spark, f"file://{tmp_path}/w").collect()
    assert len({r.record_id for r in records}) == 3 * len(rows)
    whole = {r.record_id: r.payload_digest for r in records if r.record_type == "response"}
    revisits = [r for r in records if r.record_type == "revisit"]
    assert len(revisits) == 4 and all(whole[r.refers_to] == r.payload_digest for r in revisits)


def test_broken_archives_are_reported():
    with pytest.raises(ValueError):
        list(warc.parse_archive(b"not a record\r\n\r\n"))
    with pytest.raises(ValueError):
        list(warc.parse_archive(b"WARC/1.1\r\nWARC-Type: metadata\r\nWARC-Record-ID: <a>\r\nContent-Length: 9\r\n\r\nabc"))


def test_embeddings_against_brute_force(spark, monkeypatch):
    rng = np.random.default_rng(8)
    centres = rng.normal(size=(60, 16))
    x = np.concatenate([centres[i % 60] + rng.normal(scale=0.12, size=16) for i in range(500)]).reshape(500, 16).astype(np.float32)
    x[40:70] = x[40]
    label = rng.integers(0, 3, 500)
    label[40:70] = 1
    rows = [(i, x[i].tolist(), int(label[i])) for i in range(500)]
    rows += [(600, None, 1), (601, [0.0] * 16, 1), (602, [float("nan")] * 16, 1), (603, [None] + [1.0] * 15, 1), (604, x[0].tolist(), None), (605, [], 1), (606, [1.0, 2.0], 1), (607, [2.0, 4.0], 1)]
    got = {r.vec_id: r for r in embeddings.near_duplicates(spark.createDataFrame([(*r, 0) for r in rows], "vec_id long, embedding array<float>, label int, n long")).collect()}
    u = x.astype(float) / np.linalg.norm(x.astype(float), axis=1, keepdims=True)
    link = (u @ u.T >= 0.93) & (label[:, None] == label[None])
    np.fill_diagonal(link, False)
    found = sum(got[i].n_links for i in range(500))
    assert 0.95 * link.sum() <= found <= link.sum()
    assert all(got[i].n_links <= link[i].sum() for i in range(500)) and all(got[i].n_links >= 29 for i in range(40, 70))
    assert all((got[i].n_links, got[i].component_id, got[i].kept) == (0, i, True) for i in (600, 601, 602, 603, 604, 605))
    assert (got[607].n_links, got[607].component_id, got[607].kept) == (1, 606, False)
    assert all(r.kept == (r.vec_id == r.component_id) for r in got.values())
    # small blocks and shares of queries find the same
    monkeypatch.setattr(embeddings, "BLOCK", 8)
    monkeypatch.setattr(embeddings, "ASKED", 32)
    again = embeddings.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")).collect()
    assert {r.vec_id: r for r in again} == got
    empty = spark.createDataFrame([], "vec_id long, embedding array<float>, label int")
    assert embeddings.near_duplicates(empty).collect() == []


def test_components(spark):
    edges = [(i, i + 1) for i in range(0, 30)] + [(100, 90), (90, 95), (7, 7), (200, 3)]
    got = {r.id: r.component_id for r in components(spark.createDataFrame(edges, "a long, b long").repartition(4)).collect()}
    assert got == {**{i: 0 for i in range(31)}, 90: 90, 95: 90, 100: 90, 200: 0}
    assert components(spark.createDataFrame([], "a long, b long")).collect() == []


def test_components_take_few_jobs(spark):
    """The driver keeps account of each task of each shuffle of a round (67 jobs on such a chain before)."""
    spark.sparkContext.setJobGroup("components", "")
    try:
        got = components(spark.createDataFrame([(k + 1, k) for k in range(40)] + [(100, 90), (95, 100)], "a long, b long").repartition(4))
        jobs = len(spark.sparkContext.statusTracker().getJobIdsForGroup("components"))
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert {r.id: r.component_id for r in got.collect()} == {**{k: 0 for k in range(41)}, 90: 90, 95: 90, 100: 90}
    assert jobs < 60


def test_fit_holds_little_beside_its_sample(monkeypatch):
    """A driver of bounded memory fits the model: some 20 bytes at the peak for each word of the sample, beside the model itself."""
    rng, n = np.random.default_rng(3), 4000
    cut = np.concatenate([[0], np.cumsum(rng.integers(0, 600, n))])
    sample = rng.integers(0, 2, n).astype(np.int32), cut, rng.integers(0, 2000, cut[-1]).astype(np.int32), rng.integers(1, 9, cut[-1]).astype(np.int32), rng.random((n, 12))
    monkeypatch.setattr(quality, "training_rows", lambda *a: None)
    monkeypatch.setattr(quality, "sample_features", lambda *a: sample)
    tracemalloc.start()
    try:
        quality.train(None, None)
        most = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    assert most < 24 * cut[-1] + (16 << 20)


def test_near_duplicates_with_repeated_ids(spark):
    """One row of each group of texts stays, whatever rows share a doc_id."""
    import corpus_pipeline as p

    a, b, c, d, e = (" ".join(f"{x}{k}" for k in range(60)) for x in "abcde")
    rows = [(9, a), (9, b), (5, a + " end"), (7, c), (7, c), (3, d), (3, e), (4, e), (2, d + " end"), (None, c), (None, c), (8, None), (8, "")]
    docs = spark.createDataFrame([(i, t, "s") for i, t in rows], "doc_id long, text string, source string").repartition(3)
    path = f"{new_path(spark, 'repeated')}"
    docs.write.parquet(path)
    out = p.drop_near_duplicates(spark, spark.read.parquet(path), "")
    assert out.columns == ["doc_id", "text", "source"]
    want = [(9, b), (5, a + " end"), (7, c), (3, e), (2, d + " end"), (None, c), (None, c), (8, None), (8, "")]
    assert sorted(str((r.doc_id, r.text)) for r in out.collect()) == sorted(map(str, want))


def test_pipeline(spark):
    import corpus_pipeline as p

    docs = table(spark, "/root/testdata/sf0.001", "documents")
    seen = docs
    for name, stage in p.STAGES[:-1]:
        out = stage(spark, seen, "/root/testdata/sf0.001")
        assert out.columns == docs.columns, name
        out = spark.createDataFrame(out.collect(), docs.schema)
        assert {r.doc_id for r in out.collect()} <= {r.doc_id for r in seen.collect()}
        seen = out
    assert 0 < seen.count() < docs.count()
    packed = p.run(spark, "/root/testdata/sf0.001").toPandas()
    assert set(packed["doc_id"]) == {r.doc_id for r in seen.collect()}


def test_pipeline_hands_workers_bounded_batches(spark):
    """A partition of long texts doesn't stand whole in a task and its worker."""
    import corpus_pipeline as p

    for name, stage in p.STAGES:
        own = spark.newSession()
        docs = own.range(600).select(F.col("id").alias("doc_id"), F.repeat(F.lit("some words "), 2000).alias("text"), F.lit("s").alias("source")).coalesce(1)
        stage(own, docs, "/root/testdata/sf0.001")
        sizes = docs.mapInArrow(lambda batches: (pa.RecordBatch.from_pydict({"n": [b.nbytes]}) for b in batches), "n long").toPandas()["n"]
        assert sizes.sum() > 12 << 20 and sizes.max() < 5 << 20, name
    own = spark.newSession()
    own.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", "9m")
    p.redact_secrets(own, own.createDataFrame([(1, "a")], "doc_id long, text string"), "")
    assert own.conf.get("spark.sql.execution.arrow.maxBytesPerBatch") == "9m"


def test_quality_scan_holds_little(spark):
    """Beside a batch and the model a scan holds the temporaries of a small block."""
    machine = quality.Machine(0.0, np.zeros((1 << quality.BITS) + 120, np.float32), np.zeros(((1 << quality.BITS) + 120, quality.RANK), np.float32))
    rng = np.random.default_rng(5)
    texts = [" ".join(rng.choice([f"word{i}" for i in range(3000)], 300)) for _ in range(1500)]
    batch = pa.RecordBatch.from_pydict({"text": texts})
    context = SimpleNamespace(broadcast=lambda x: SimpleNamespace(value=x))
    run = quality.filter_documents(SimpleNamespace(schema=None, sparkSession=SimpleNamespace(sparkContext=context), mapInArrow=lambda f, schema: f), machine)
    list(run(iter([batch.slice(0, 10)])))  # tables that are made once
    tracemalloc.start()
    try:
        assert sum(b.num_rows for b in run(iter([batch]))) == len(texts)
        most = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    assert most < 20 << 20, most


def test_embeddings_with_repeated_and_null_ids(spark):
    """Rows are told apart by their vectors, whatever their ids."""
    a, near, b = [1.0, 0.0, 0.0, 0.0], [1.0, 0.1, 0.0, 0.0], [0.0, 0.0, 1.0, 0.0]
    c, nearer = [0.0, 0.0, 0.0, 1.0], [0.0, 0.1, 0.0, 1.0]
    rows = [(5, a), (5, b), (6, near), (9, near), (None, b), (4, c), (4, nearer), (None, [0.0] * 4), (None, [1.0, 1.0, 1.0, 1.0])]
    got = embeddings.near_duplicates(spark.createDataFrame([(i, v, 1, "x") for i, v in rows], "vec_id long, embedding array<float>, label int, rep string")).collect()
    want = [(5, 3 - 1, 5, True), (5, 1, 5, True), (6, 2, 5, False), (9, 2, 5, False), (None, 1, 5, False), (4, 1, 4, True), (4, 1, 4, True), (None, 0, None, True), (None, 0, None, True)]
    assert sorted(map(str, map(tuple, got))) == sorted(map(str, want))
