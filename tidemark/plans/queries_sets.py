"""Queries: briefs, stop rule, notes and logs of sets; seeds and windows of clusters; neighbours, skip card, profiles."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators import brief, clusters, listening, planner, ranks, similarity, warehouse
from ..sources import files
from ..sources.adapters import table
from . import report
from .queries_listening import plays, tracks
from .queries_models import _CRATE, _PRINTS, HASH, crate, prints
from .queries_plans import _CENTRES, full_crate, scratch
from .registry import PLAYS, TRACKS, query

_ASSIGNED = f"""{_PRINTS}, c(cluster, centre) AS (VALUES (0, {_CENTRES[0]}), (1, {_CENTRES[1]})), far AS (SELECT vec_id, cluster, 1 - len(list_intersect(kc, centre)) / {HASH}.0 AS distance FROM prints, c),
near AS (SELECT vec_id, arg_min(cluster, (distance, cluster)) AS cluster FROM far GROUP BY 1)"""


def _assigned(s, d):
    return clusters.assign(prints(s, d), _CENTRES).select("vec_id", "cluster")


@query("top10_neighbours", f"WITH {_PRINTS}, others AS (SELECT vec_id, label, vec_id % 13 AS plays, 2 * {HASH} - 2 * len(list_intersect(kc, (SELECT kc FROM prints WHERE vec_id = 7))) AS distance FROM prints JOIN embeddings USING (vec_id) WHERE vec_id <> 7) SELECT vec_id, distance, label, plays FROM others ORDER BY distance, label DESC, plays DESC, vec_id LIMIT 25", longs="distance label plays")
def _(s, d):
    tags = prints(s, d).join(table(s, d, "embeddings").select("vec_id", "label"), "vec_id").withColumn("plays", F.col("vec_id") % 13)
    return similarity.nearest(tags, "vec_id", 7, 25, F.desc("label"), F.desc("plays")).select("vec_id", "distance", "label", "plays")


@query("cl1_seeds")
def _(s, d):
    cells = clusters.sample(prints(s, d), "vec_id")
    return s.createDataFrame([(i, cells[j]) for i, j in enumerate(clusters.seeds(clusters.distances(cells), 6))], "seed long, kc array<long>")


@query("cl4_fit_then_assign")
def _(s, d):
    p = prints(s, d)
    centres, _ = clusters.fit(p, "vec_id", range(6, 13))
    return clusters.assign(p, centres).groupBy("cluster").agg(F.count("*").alias("rows"), F.count_distinct("kc").alias("prints"), F.max("distance").alias("farthest"))


_IN_WINDOW = f"{PLAYS}, {_ASSIGNED}, w AS (SELECT p.track_id, p.reason_end, near.cluster FROM plays p JOIN near ON near.vec_id = CAST(p.artist_name AS BIGINT) % 500 WHERE p.ts >= TIMESTAMP '2024-01-10' AND p.ts < TIMESTAMP '2024-01-20')"


def _in_window(s, d):
    tag = F.col("artist_name").cast("long") % 500
    return warehouse.between(plays(s, d), "2024-01-10", "2024-01-20").withColumn("vec_id", tag).join(_assigned(s, d), "vec_id")


@query("cl5_window_clusters", f"WITH {_IN_WINDOW}, t AS (SELECT track_id, cluster, COUNT(*) AS n, AVG(CASE WHEN reason_end = 'fwdbtn' THEN 1.0 ELSE 0.0 END) AS r FROM w GROUP BY 1, 2) SELECT cluster, COUNT(*) AS tracks, CAST(SUM(n) AS BIGINT) AS plays, SUM(n) / SUM(SUM(n)) OVER () AS share, COUNT(*) FILTER (n <= 2 AND r = 0) AS gems FROM t GROUP BY 1", "share", "cluster")
def _(s, d):
    per = warehouse_rates(_in_window(s, d))
    got = per.groupBy("cluster").agg(F.count("*").alias("tracks"), F.sum("n").alias("plays"), F.count_if((F.col("n") <= 2) & (F.col("r") == 0)).alias("gems"))
    total = F.broadcast(got.agg(F.sum("plays").alias("t")))
    return got.crossJoin(total).select("cluster", "tracks", "plays", (F.col("plays") / F.col("t")).alias("share"), "gems")


def warehouse_rates(own):
    """Plays and share of skips of each track and cluster."""
    return own.groupBy("track_id", "cluster").agg(F.count("*").alias("n"), F.avg((F.col("reason_end") == "fwdbtn").cast("int")).alias("r"))


@query("rpt10_cluster_card", f"WITH {_IN_WINDOW}, g AS (SELECT cluster, COUNT(*) AS plays FROM w GROUP BY 1) SELECT cluster, plays, ROW_NUMBER() OVER (ORDER BY plays DESC, cluster) AS place FROM g", longs="cluster")
def _(s, d):
    g = _in_window(s, d).groupBy("cluster").agg(F.count("*").alias("plays"))
    return g.withColumn("place", F.row_number().over(Window.orderBy(F.desc("plays"), "cluster")))  # a row for each cluster, of which a model has at most twelve


@query("rpt8_skip_offenders", f"WITH {TRACKS} SELECT track_id, name, artist, play_count, ROUND(skip_rate, 3) AS skip_rate FROM tracks WHERE play_count >= 5 AND skip_rate >= 0.3", "skip_rate")
def _(s, d):
    return listening.skip_offenders(tracks(s, d)).withColumn("skip_rate", F.round("skip_rate", 3))


_SLOTS = f"{_CRATE}, own AS (SELECT artist, track_id, ROW_NUMBER() OVER (PARTITION BY artist ORDER BY energy, track_id) AS k, COUNT(*) OVER (PARTITION BY artist) AS n FROM crate), mids AS (SELECT artist, k - 1 AS slot, (k - 0.5) / n AS t FROM own), goal AS (SELECT artist, slot, ROUND(0.3 + 0.5 * CASE WHEN t < 0.15 THEN 0.2 WHEN t < 0.55 THEN 0.2 + 0.7 * (t - 0.15) / 0.4 WHEN t < 0.8 THEN 0.95 ELSE 0.95 - 0.7 * (t - 0.8) / 0.2 END, 9) AS target FROM mids)"


@query("dj9_sort_match", f"WITH {_SLOTS}, g AS (SELECT artist, slot, target, ROW_NUMBER() OVER (PARTITION BY artist ORDER BY target, slot) AS k FROM goal) SELECT artist, slot, track_id, target FROM g JOIN own USING (artist, k)", "target")
def _(s, d):
    return brief.sorted_to_arc(crate(s, d), "artist", 0.3, 0.8)


@query("dj6_stop_rule", f"WITH {_CRATE}, o AS (SELECT artist, CAST(SUM(duration_ms) OVER (PARTITION BY artist ORDER BY track_id) - duration_ms AS DOUBLE) AS before, MEDIAN(duration_ms) OVER (PARTITION BY artist) AS mid FROM crate) SELECT artist, COUNT(*) AS tracks FROM o WHERE 2700000 - before > mid / 2 GROUP BY 1")
def _(s, d):
    return brief.fill(crate(s, d), "artist", "track_id", 45).groupBy("artist").agg(F.count("*").alias("tracks"))


@query("dj4_brief", f"WITH {_CRATE}, w(track_id) AS (VALUES (3), (5), (30), (999999999), (3)), asked AS (SELECT DISTINCT track_id FROM w), seeds AS (SELECT track_id FROM crate JOIN asked USING (track_id)), x AS (SELECT COUNT(*) AS n FROM seeds), y AS (SELECT COUNT(*) AS n FROM asked) SELECT 'night drive' AS theme, 45 AS minutes, (SELECT list_sort(list(track_id)) FROM seeds)::VARCHAR AS seeds, 'night drive at 22:00; ' || x.n || ' of ' || y.n || ' requested seeds are in the crate' AS rationale FROM x, y", longs="minutes")
def _(s, d):
    asked = s.createDataFrame([(i,) for i in (3, 5, 30, 999999999, 3)], "track_id long")
    return brief.build(crate(s, d), asked, hour=22, minutes=45)


def _sets(s, d):
    """The sets of five listeners with what notes and critiques need."""
    c = full_crate(s, d)
    return planner.select(c, "listener").join(c.select("listener", "track_id", "name", "artist", "tempo", "duration_ms"), ["listener", "track_id"])


@query("dj12_notes")
def _(s, d):
    picks = _sets(s, d)
    return brief.notes(picks, planner.critique(picks, "listener", planner.Rules().minutes), "listener", "night drive")


@query("dj13_run_log")
def _(s, d):
    picks = _sets(s, d)
    issues = planner.critique(picks, "listener", planner.Rules().minutes)
    return brief.run_log(picks, issues, "listener", planner.Rules())


@query("src13_guarded_load", "SELECT TRUE AS refused, '2024-01-30' AS as_of, COUNT(*) AS n FROM part")
def _(s, d):
    c = full_crate(s, d).select("track_id", "name", "artist", "tempo", "energy", "duration_ms", "familiar", F.array(F.lit("chill")).alias("mood_tags"), F.lit(0.0).alias("fly_valence"), "taste", "kc")
    good, bad = scratch(s), scratch(s)
    files.save_crate(c, good, as_of="2024-01-30")
    c.withColumn("last_played", F.lit("2024-01-30 12:00:17")).write.parquet(bad)
    try:
        files.load_crate(s, bad)
        refused = False
    except ValueError:
        refused = True
    own, about = files.load_crate(s, good)
    return own.agg(F.lit(refused).alias("refused"), F.lit(about["as_of"]).alias("as_of"), F.count("*").alias("n"))


@query("gov5_profiles", "SELECT name, private, reads, publishes, COUNT(*) AS n FROM customer JOIN (VALUES ('private', TRUE, 'private/warehouse', FALSE), ('synthetic', FALSE, 'synthetic/warehouse', TRUE)) AS t(name, private, reads, publishes) ON private = (c_custkey % 3 = 0) GROUP BY ALL")
def _(s, d):
    """Customers by the profile that they belong to, and what each profile reads and may publish."""
    profiles = s.createDataFrame([(p.name, p.private, p.warehouse(""), p.may_publish()) for p in report.PROFILES], "name string, private boolean, reads string, publishes boolean")
    own = table(s, d, "customer").select((F.col("c_custkey") % 3 == 0).alias("private"))
    return own.join(F.broadcast(profiles), "private").groupBy("name", "private", "reads", "publishes").agg(F.count("*").alias("n"))


@query("api2_set_tools")
def _(s, d):
    """Neighbours, valence order and an ordered set as the tools answer them: text, errors included."""
    near = similarity.nearest(prints(s, d), "vec_id", 7, 5).select("vec_id", "distance")
    ordered = planner.order(ranks.top_per(crate(s, d), 5, ["artist"], ["track_id"], "k"), "artist").orderBy("artist", "slot").limit(10)
    answers = [("more_like_this", report.markdown_table(near)), ("order_tracks", report.markdown_table(ordered)), ("no_such_tool", report.call("no_such_tool", plays(s, d)))]
    return s.createDataFrame(answers, "tool string, markdown string")
