"""Queries: planner, clusters, file sources, reports and streams."""

from __future__ import annotations

import json
import os
import tempfile
import uuid
from functools import reduce

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import music
from ..operators import brief, clusters, evaluation, ingest, planner, ranks, warehouse
from ..sources import files
from ..sources.adapters import table
from ..sources.stored import scratch
from ..streaming import live
from . import report
from .queries_listening import plays
from .queries_models import _CRATE, _PRINTS, HASH, crate, prints
from .registry import PLAYS, query


# --- planner --------------------------------------------------------------------------------------------------------


def full_crate(s, d):
    """One crate for each of five listeners, with what selection needs."""
    k = F.col("track_id")
    return crate(s, d).withColumns({"listener": k % 5, "taste": k % 17 / 16, "theme_fit": k % 3 / 2, "sim": k % 7 / 6, "kc": F.array(k % 40, 40 + k % 31)})


@query("dj1_crate", f"WITH {_CRATE} SELECT * FROM crate", "tempo energy", "duration_ms")
def _(s, d):
    return crate(s, d).drop("name")


@query("dj5_select")
def _(s, d):
    return planner.select(full_crate(s, d), "listener")


@query("dj7_critique")
def _(s, d):
    c = full_crate(s, d)
    picks = planner.select(c, "listener").join(c.select("listener", "track_id", "artist", "tempo", "duration_ms"), ["listener", "track_id"])
    return planner.critique(picks, "listener", planner.Rules().minutes)


@query("dj11_order_tracks")
def _(s, d):
    return planner.order(planner.in_sets(full_crate(s, d), "artist"), "artist", "set_no")


_ASKED = "asked AS (SELECT p_size AS request, CASE WHEN p_partkey % 3 = 0 THEN -p_partkey ELSE p_partkey END AS track_id, p_partkey AS place FROM part)"


@query("dj11_requests", f"WITH {_CRATE}, {_ASKED}, n AS (SELECT request, COUNT(*) AS n, COUNT(c.track_id) AS m FROM asked LEFT JOIN crate c USING (track_id) GROUP BY 1), r AS (SELECT *, CASE WHEN n NOT BETWEEN 2 AND 100 THEN 'pass 2 to 100 distinct tracks, not ' || n WHEN m < 2 THEN 'only ' || m || ' of ' || n || ' tracks are in the crate' END AS refused FROM n), z AS (SELECT request, MAX(place) AS place FROM asked WHERE track_id < 0 GROUP BY 1) SELECT request, CASE WHEN refused IS NULL THEN m ELSE 0 END AS placed, CASE WHEN refused IS NULL THEN n - m ELSE 0 END AS unplaced, CASE WHEN refused IS NULL AND n > m THEN -z.place END AS last_track, refused FROM r LEFT JOIN z USING (request)", longs="request placed unplaced last_track")
def _(s, d):
    """Sizes as requests; a third of the tracks isn't in the crate and comes last, as it was asked for."""
    k = F.col("p_partkey")
    asked = table(s, d, "part").select(F.col("p_size").alias("request"), F.when(k % 3 == 0, -k).otherwise(k).alias("track_id"), k.alias("place"))
    got = planner.order_requests(asked, full_crate(s, d), "request")
    last = F.max_by("track_id", F.when(~F.col("placed"), F.col("slot")))
    return got.groupBy("request").agg(F.count_if("placed").alias("placed"), F.count_if(~F.col("placed") & F.col("refused").isNull()).alias("unplaced"), last.alias("last_track"), F.max("refused").alias("refused"))


MOODS = "['" + "', '".join(brief.MOODS) + "']"
_MOODY = f"{_CRATE}, moody AS (SELECT *, [{MOODS}[track_id % 10 + 1], {MOODS}[(track_id * 7 + 3) % 10 + 1]] AS mood_tags, track_id % 17 / 16 AS taste FROM crate), recent AS (SELECT l_partkey AS track_id, MAX(l_shipdate) AS ts FROM lineitem WHERE l_shipdate >= TIMESTAMP '1998-06-01' GROUP BY 1)"


def moody(s, d):
    """The crate with two moods and a taste for each track, and its latest plays."""
    k = F.col("track_id")
    mood = lambda i: F.element_at(F.array(*map(F.lit, brief.MOODS)), (i % 10 + 1).cast("int"))
    own = crate(s, d).withColumns({"mood_tags": F.array(mood(k), mood(k * 7 + 3)), "taste": k % 17 / 16})
    recent = table(s, d, "lineitem").where(F.col("l_shipdate") >= F.lit("1998-06-01").cast("timestamp_ntz"))
    return own, recent.groupBy(F.col("l_partkey").alias("track_id")).agg(F.max("l_shipdate").alias("ts"))


_THEME_ROWS = ", ".join(f"('{n}', {list(m)}, {list(h) or 'CAST([] AS INTEGER[])'}, {b})" for n, m, _, _, h, b in brief.THEMES)


@query("dj2_theme_scores", f"WITH {_MOODY}, m AS (SELECT mood, COUNT(*) AS n FROM (SELECT unnest(list_distinct(mood_tags)) AS mood FROM recent JOIN moody USING (track_id)) GROUP BY 1), p AS (SELECT mood, n / SUM(n) OVER () AS weight FROM m), t(theme, moods, hours, bonus) AS (VALUES {_THEME_ROWS}), f AS (SELECT theme, moods, hours, bonus, COALESCE((SELECT SUM(weight) FROM p WHERE list_contains(moods, mood)) / (SQRT(len(moods)) * (SELECT SQRT(SUM(weight * weight)) FROM p)), 0) AS fit FROM t), h AS (SELECT range AS hour, range % 2 = 1 AS is_weekend FROM range(24)) SELECT hour, is_weekend, theme, ROUND(CAST(list_contains(hours, hour) AS DOUBLE) + CASE WHEN is_weekend THEN bonus ELSE 0 END + fit, 3) AS score FROM h, f", "score", "hour")
def _(s, d):
    own, recent = moody(s, d)
    hours = s.range(24).select(F.col("id").alias("hour"), (F.col("id") % 2 == 1).alias("is_weekend"))
    return brief.score_themes(brief.mood_profile(recent, own), hours)


@query("dj2_theme_by_hour", f"WITH {PLAYS}, t(theme, moods, hours, bonus) AS (VALUES {_THEME_ROWS}), s AS (SELECT hour_utc, theme, CAST(list_contains(hours, hour_utc) AS INTEGER) AS fit FROM (SELECT DISTINCT hour_utc FROM plays), t) SELECT hour_utc, arg_min(theme, (-fit, theme)) AS theme FROM s GROUP BY 1", longs="hour_utc")
def _(s, d):
    """Without recent moods a theme goes by its hours alone."""
    hours = plays(s, d).select(F.col("hour_utc").alias("hour"), F.lit(False).alias("is_weekend")).distinct()
    nothing = s.createDataFrame([], "mood string, weight double")
    return brief.score_themes(nothing, hours).groupBy(F.col("hour").alias("hour_utc")).agg(F.min_by("theme", F.struct(-F.col("score"), F.col("theme"))).alias("theme"))


@query("dj3_seeds", f"WITH {_MOODY} SELECT track_id, ROW_NUMBER() OVER (ORDER BY ts DESC NULLS LAST, CASE WHEN ts IS NULL THEN taste END DESC NULLS LAST, track_id) AS place FROM moody LEFT JOIN recent USING (track_id) WHERE list_has_any(mood_tags, {list(brief.THEMES[3][1])}) ORDER BY place LIMIT 5")
def _(s, d):
    return brief.pick_seeds(*moody(s, d), brief.THEMES[3][1])


@query("dj3_seeds_by_taste", f"WITH {_MOODY} SELECT track_id, ROW_NUMBER() OVER (ORDER BY taste DESC, track_id) AS place FROM moody WHERE list_has_any(mood_tags, {list(brief.THEMES[6][1])}) AND track_id % 2 = 0 ORDER BY place LIMIT 5")
def _(s, d):
    """Without recent plays the tracks of the highest taste, odd ones being excluded."""
    own, recent = moody(s, d)
    return brief.pick_seeds(own, recent.limit(0), brief.THEMES[6][1], without=own.where("track_id % 2 = 1"))


# what the given requests say: (text, theme, moods, least and most energy)
_SAID = "said(requested, theme, moods, floor, ceiling) AS (VALUES ('Night Drive, please', 'night drive', ['melancholic', 'anxious', 'somber', 'nostalgic'], 0.3, 0.75), ('sad, happy rainy day', 'sad, happy rainy day', ['melancholic', 'euphoric'], 0.3, 0.8), ('peak', 'peak time', ['euphoric', 'triumphant', 'aggressive', 'playful'], 0.4, 0.95))"
_RANGES = ", ".join(f"('{n}', {list(m)}, {lo}, {hi})" for n, m, lo, hi, _, _ in brief.THEMES)
_TEXTS = ("Night Drive, please", "sad, happy rainy day", None, "qwerty", "peak")


@query("dj4_briefs", f"""WITH {_MOODY}, {_SAID}, m AS (SELECT mood, COUNT(*) AS n FROM (SELECT unnest(list_distinct(mood_tags)) AS mood FROM recent JOIN moody USING (track_id)) GROUP BY 1), p AS (SELECT mood, n / SUM(n) OVER () AS weight FROM m), t(theme, moods, hours, bonus) AS (VALUES {_THEME_ROWS}), r(theme, moods, floor, ceiling) AS (VALUES {_RANGES}),
    f AS (SELECT theme, hours, bonus, COALESCE((SELECT SUM(weight) FROM p WHERE list_contains(moods, mood)) / (SQRT(len(moods)) * (SELECT SQRT(SUM(weight * weight)) FROM p)), 0) AS fit FROM t),
    q AS (SELECT event_id AS request_id, HOUR(ts) AS hour, ISODOW(ts) >= 6 AS is_weekend, 30 + event_id % 60 AS minutes, CASE event_id % 5 WHEN 0 THEN 'Night Drive, please' WHEN 1 THEN 'sad, happy rainy day' WHEN 3 THEN 'qwerty' WHEN 4 THEN 'peak' END AS requested FROM events),
    s AS (SELECT hour, is_weekend, theme, ROUND(CAST(list_contains(hours, hour) AS DOUBLE) + CASE WHEN is_weekend THEN bonus ELSE 0 END + fit, 3) AS score, ROW_NUMBER() OVER (PARTITION BY hour, is_weekend ORDER BY score DESC, theme) AS k FROM (SELECT DISTINCT hour, is_weekend FROM q), f),
    w AS (SELECT a.hour, a.is_weekend, a.theme, printf('scored %.3f at %d:00, ahead of %s (%.3f)', a.score, a.hour, b.theme, b.score) AS why FROM s a JOIN s b ON a.hour = b.hour AND a.is_weekend = b.is_weekend AND a.k = 1 AND b.k = 2),
    g AS (SELECT request_id, minutes, CASE WHEN q.requested IS NULL THEN w.theme ELSE said.theme END AS theme, CASE WHEN q.requested IS NULL THEN r.moods ELSE said.moods END AS moods, CASE WHEN q.requested IS NULL THEN r.floor ELSE said.floor END AS floor, CASE WHEN q.requested IS NULL THEN r.ceiling ELSE said.ceiling END AS ceiling,
        CASE WHEN q.requested IS NULL THEN why WHEN said.theme IS NULL THEN 'no mood in: ' || q.requested ELSE 'asked for' END AS rationale FROM q LEFT JOIN said USING (requested) JOIN w ON w.hour = q.hour AND w.is_weekend = q.is_weekend JOIN r ON r.theme = w.theme),
    k AS (SELECT moods, string_agg(CAST(track_id AS VARCHAR), ',' ORDER BY place) AS seeds FROM (SELECT x.moods, track_id, ROW_NUMBER() OVER (PARTITION BY x.moods ORDER BY ts DESC NULLS LAST, CASE WHEN ts IS NULL THEN taste END DESC NULLS LAST, track_id) AS place FROM (SELECT DISTINCT moods FROM g) x JOIN moody ON list_has_any(mood_tags, x.moods) LEFT JOIN recent USING (track_id)) WHERE place <= 5 GROUP BY 1)
    SELECT request_id, theme, floor, ceiling, minutes, COALESCE(seeds, '') AS seeds, rationale FROM g LEFT JOIN k USING (moods)""", "floor ceiling", "minutes")
def _(s, d):
    """A brief for every event: a theme that is asked for, or the one that scores highest by hour, day and recent moods."""
    k = F.col("event_id")
    text = reduce(lambda c, x: c.when(k % 5 == x[0], F.lit(x[1])), enumerate(_TEXTS), F.when(F.lit(False), F.lit("")))
    requests = table(s, d, "events").select(k.alias("request_id"), F.hour("ts").alias("hour"), (F.weekday("ts") >= 5).alias("is_weekend"), text.alias("requested"), (30 + k % 60).alias("minutes"))
    got = brief.compose(requests, *moody(s, d))
    return got.withColumn("seeds", F.array_join(F.transform("seeds", lambda x: x.cast("string")), ","))


@query("dj_jarring_share", f"WITH {_CRATE}, p AS (SELECT artist, ABS(LEAD(energy) OVER (PARTITION BY artist ORDER BY track_id) - energy) AS step FROM crate) SELECT artist, AVG(CASE WHEN step > 0.25 THEN 1.0 ELSE 0.0 END) AS share FROM p WHERE step IS NOT NULL GROUP BY 1", "share")
def _(s, d):
    step = F.abs(F.lead("energy").over(Window.partitionBy("artist").orderBy("track_id")) - F.col("energy"))
    return crate(s, d).select("artist", step.alias("step")).where("step is not null").groupBy("artist").agg(F.avg(music.jarring(F.lit(None).cast("double"), "step").cast("int")).alias("share"))


# --- clusters -------------------------------------------------------------------------------------------------------

_CENTRES = [[0, 9, 17, 25, 31, 44, 52, 60, 77, 85, 93, 110], [3, 5, 11, 29, 38, 41, 58, 66, 71, 88, 97, 119]]


@query("jn10_nearest_medoid", f"WITH {_PRINTS}, c(cluster, centre) AS (VALUES (0, {_CENTRES[0]}), (1, {_CENTRES[1]})), x AS (SELECT vec_id, cluster, 1 - len(list_intersect(kc, centre)) / {HASH}.0 AS distance FROM prints, c) SELECT vec_id, arg_min(cluster, (distance, cluster)) AS cluster, MIN(distance) AS distance FROM x GROUP BY 1", "distance", "cluster")
def _(s, d):
    return clusters.assign(prints(s, d), _CENTRES).select("vec_id", "cluster", "distance")


@query("cl2_k_medoids")
def _(s, d):
    p = prints(s, d)
    centres, _ = clusters.fit(p, "vec_id")
    return clusters.assign(p, centres).select("vec_id", "cluster", "distance")


@query("agg23_cluster_summary", f"WITH {_PRINTS}, c(cluster, centre) AS (VALUES (0, {_CENTRES[0]}), (1, {_CENTRES[1]})), x AS (SELECT vec_id, cluster, 1 - len(list_intersect(kc, centre)) / {HASH}.0 AS distance FROM prints, c), a AS (SELECT vec_id, arg_min(cluster, (distance, cluster)) AS cluster FROM x GROUP BY 1) SELECT cluster, COUNT(*) AS tracks, CAST(SUM(label) AS BIGINT) AS plays, SUM(label) / SUM(SUM(label)) OVER () AS share FROM a JOIN embeddings USING (vec_id) GROUP BY 1", "share", "cluster")
def _(s, d):
    own = clusters.assign(prints(s, d), _CENTRES).join(table(s, d, "embeddings").select("vec_id", "label"), "vec_id")
    return clusters.summary(own, "label")


_PLAYED = f"{_PRINTS}, c(cluster, centre) AS (VALUES (0, {_CENTRES[0]}), (1, {_CENTRES[1]})), x AS (SELECT vec_id, cluster, 1 - len(list_intersect(kc, centre)) / {HASH}.0 AS distance FROM prints, c), a AS (SELECT vec_id, arg_min(cluster, (distance, cluster)) AS cluster, MIN(distance) AS distance FROM x GROUP BY 1), o AS (SELECT cluster, vec_id, distance, 'a' || vec_id % 23 AS artist, vec_id * 7 % 31 AS plays FROM a)"


@query("agg23_cluster_cards", f"WITH {_PLAYED}, g AS (SELECT cluster, artist, SUM(plays) AS n FROM o GROUP BY 1, 2), ar AS (SELECT cluster, string_agg(artist, ',' ORDER BY n DESC, artist) AS top_artists FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY cluster ORDER BY n DESC, artist) AS r FROM g) WHERE r <= 3 GROUP BY 1), ex AS (SELECT cluster, string_agg(vec_id::VARCHAR, ',' ORDER BY plays DESC, vec_id) AS exemplars FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY cluster ORDER BY plays DESC, vec_id) AS r FROM o) WHERE r <= 10 GROUP BY 1) SELECT cluster, top_artists, exemplars, (SELECT arg_min(vec_id, (distance, vec_id)) FROM o WHERE o.cluster = ar.cluster) AS medoid FROM ar JOIN ex USING (cluster)", longs="cluster")
def _(s, d):
    k = F.col("vec_id")
    own = clusters.assign(prints(s, d), _CENTRES).select("vec_id", "cluster", "distance", F.concat(F.lit("a"), k % 23).alias("artist"), (k * 7 % 31).alias("plays"))
    got = clusters.cards(own, "vec_id", "artist", "plays")
    return got.select("cluster", F.array_join("top_artists", ",").alias("top_artists"), F.array_join(F.transform("exemplars", lambda e: e.cast("string")), ",").alias("exemplars"), "medoid")


@query("lsh10_knn_euclid", "SELECT vec_id, list_distance(CAST(embedding AS DOUBLE[]), CAST((SELECT embedding FROM embeddings WHERE vec_id = 3) AS DOUBLE[])) AS distance FROM embeddings WHERE vec_id <> 3 ORDER BY 2, 1 LIMIT 10", "distance")
def _(s, d):
    e = table(s, d, "embeddings").select("vec_id", F.transform("embedding", lambda v: v.cast("double")).alias("x"))
    one = F.broadcast(e.where("vec_id = 3").select(F.col("x").alias("q")))
    far = F.sqrt(F.aggregate(F.zip_with("x", "q", lambda a, b: (a - b) * (a - b)), F.lit(0.0), lambda t, v: t + v))
    return ranks.top(e.where("vec_id <> 3").crossJoin(one).select("vec_id", far.alias("distance")), 10, "distance", "vec_id")


# --- files ----------------------------------------------------------------------------------------------------------


@query("src1_zip_history", f"WITH kept AS (SELECT * FROM events WHERE event_id % 7 <> 0), {PLAYS.replace('FROM events', 'FROM kept')} SELECT track_id, hour_utc, COUNT(*) AS n, CAST(SUM(ms_played) AS BIGINT) AS ms, CAST(SUM(verdict) AS BIGINT) AS net, MAX(album_name) AS album FROM plays GROUP BY 1, 2", longs="hour_utc")
def _(s, d):
    """All plays written as zipped exports, one record in seven without a track, and read back as plays."""
    stamp = F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("ts")
    uri = F.when(F.col("event_id") % 7 != 0, F.concat(F.lit("spotify:track:"), "track_id")).alias("spotify_track_uri")
    records = plays(s, d).select(stamp, "ms_played", uri, "reason_end", F.col("track_name").alias("master_metadata_track_name"), F.col("album_name").alias("master_metadata_album_album_name"), F.lit("198.51.100.7").alias("ip_addr"))
    own = ingest.to_plays(files.history_records(files.pack_history(records)))
    return own.groupBy("track_id", "hour_utc").agg(F.count("*").alias("n"), F.sum("ms_played").alias("ms"), F.sum("verdict").alias("net"), F.max("album_name").alias("album"))


@query("src3_parquet_scan", "SELECT COUNT(*) AS n FROM lineitem")
def _(s, d):
    return table(s, d, "lineitem").agg(F.count("*").alias("n"))


@query("src4_column_pruned", "SELECT o_orderkey, o_totalprice FROM orders WHERE o_totalprice > 400000", "o_totalprice")
def _(s, d):
    return table(s, d, "orders").where("o_totalprice > 400000").select("o_orderkey", "o_totalprice")


@query("src6_registered_relation", "SELECT n_regionkey, COUNT(*) AS n FROM nation GROUP BY 1", longs="n_regionkey")
def _(s, d):
    table(s, d, "nation").createOrReplaceTempView("tidemark_saved")
    return s.sql("SELECT n_regionkey, COUNT(*) AS n FROM tidemark_saved GROUP BY 1")


@query("src7_tsv", "SELECT n_nationkey, n_name FROM nation", longs="n_nationkey")
def _(s, d):
    path = scratch(s)
    table(s, d, "nation").write.csv(path, sep="\t", header=True)
    return files.read_tsv(s, path, ["n_nationkey", "n_name"])


@query("src9_last_wins", "SELECT user_id, arg_max(value, event_id) AS value FROM events GROUP BY 1", "value")
def _(s, d):
    path = scratch(s)
    table(s, d, "events").select("user_id", "event_id", "value").coalesce(1).sortWithinPartitions("event_id").write.json(path)
    return files.read_last_wins(s, path, "user_id long, event_id long, value double", "user_id").select("user_id", "value")


@query("src10_append_lines", "SELECT r_regionkey, 2 AS n FROM region", longs="r_regionkey n")
def _(s, d):
    path = scratch(s)
    for _ in range(2):
        files.append_lines(table(s, d, "region"), path)
    return s.read.json(path).groupBy("r_regionkey").agg(F.count("*").alias("n"))


@query("src12_guarded_crate", "SELECT COUNT(*) AS n FROM part")
def _(s, d):
    c = full_crate(s, d).select("track_id", "name", "artist", "tempo", "energy", "duration_ms", "familiar", F.array(F.lit("chill")).alias("mood_tags"), F.lit(0.0).alias("fly_valence"), "taste", "kc")
    path = scratch(s)
    files.save_crate(c, path, as_of="2024-01-30")
    return files.load_crate(s, path)[0].agg(F.count("*").alias("n"))


@query("src14_sparse_store", f"WITH {_PRINTS} SELECT vec_id, len(kc) AS n FROM prints", longs="n")
def _(s, d):
    path = scratch(s)
    prints(s, d).write.parquet(path)
    return s.read.parquet(path).select("vec_id", F.size("kc").alias("n"))


_DRAW = "CAST('0x' || substr(md5('{}/' || {}), 1, 8) AS BIGINT)"
_PLAY = "track_id || '/' || play"


@query("src18_sample_history", f"WITH c AS (SELECT CAST(p_partkey AS VARCHAR) AS track_id, p_brand AS artist_name FROM part), p AS (SELECT *, unnest(range(1, 2 + CAST(floor(pow({_DRAW.format('n', 'track_id')} / 4294967296.0, 3) * 20) AS BIGINT))) AS play FROM c) SELECT track_id, CAST(play AS BIGINT) AS play, artist_name, CAST(1672531200 + {_DRAW.format('ts', _PLAY)} % 31536000 AS BIGINT) AS second, CAST(30000 + {_DRAW.format('ms', _PLAY)} % 200000 AS BIGINT) AS ms_played, CASE WHEN {_DRAW.format('reason', _PLAY)} % 5 = 0 THEN 'fwdbtn' ELSE 'trackdone' END AS reason_end FROM p")
def _(s, d):
    """A made-up history of every part as a track."""
    catalogue = table(s, d, "part").select(F.col("p_partkey").cast("string").alias("track_id"), F.col("p_brand").alias("artist_name"))
    return files.history_of(catalogue).withColumn("second", F.unix_seconds("ts")).drop("ts")


# --- reports --------------------------------------------------------------------------------------------------------


@query("rpt12_archetype_metrics", f"WITH {PLAYS}, f AS (SELECT *, ROW_NUMBER() OVER (PARTITION BY track_id ORDER BY ts, event_id) = 1 AS first FROM plays), c AS (SELECT track_id, COUNT(*) AS n FROM plays GROUP BY 1), r AS (SELECT n, ROW_NUMBER() OVER (ORDER BY n DESC) AS k, GREATEST(1, COUNT(*) OVER () // 100) AS m, SUM(n) OVER () AS t FROM c) SELECT (SELECT AVG(CAST(first AS INTEGER)) FROM f) AS discovery_ratio, (SELECT AVG(CAST(verdict < 0 AS INTEGER)) FROM f) AS skip_rate, (SELECT SUM(n) / MAX(t) FROM r WHERE k <= m) AS top1_share", "discovery_ratio skip_rate top1_share")
def _(s, d):
    return report.archetype_metrics(plays(s, d)).select("discovery_ratio", "skip_rate", "top1_share")


@query("rpt12_archetype_window", f"WITH {PLAYS}, f AS (SELECT *, ROW_NUMBER() OVER (PARTITION BY track_id ORDER BY ts, event_id) = 1 AS first FROM plays), w AS (SELECT * FROM f WHERE ts >= TIMESTAMP '2024-01-10 05:00:00' AND ts < TIMESTAMP '2024-01-20 05:00:00'), y AS (SELECT event_id % 10 AS k, CASE WHEN event_id % 10 < 8 THEN 1990 + 4 * (event_id % 10) END AS year, event_id % 3 AS cluster FROM w), g AS (SELECT COUNT(*) / SUM(COUNT(*)) OVER () AS p FROM y GROUP BY cluster) SELECT (SELECT AVG(CAST(first AS INTEGER)) FROM w) AS discovery_ratio, (SELECT AVG(CAST(verdict < 0 AS INTEGER)) FROM w) AS skip_rate, (SELECT COUNT(*) FILTER (year < 2024 - 20) / COUNT(year) FROM y) AS old_share, (SELECT -SUM(p * LN(p)) / LN(COUNT(*)) FROM g) AS cluster_evenness", "discovery_ratio skip_rate old_share cluster_evenness")
def _(s, d):
    """A closed window in a zone, with years of release and clusters of tracks."""
    own = plays(s, d)
    of = own.select("track_id", F.element_at(F.split("track_id", "-"), 2).cast("long").alias("k")).distinct()
    years = of.select("track_id", F.when(F.col("k") < 8, 1990 + 4 * F.col("k")).alias("year"))
    m = report.archetype_metrics(own, "2024-01-10", "2024-01-20", "America/New_York", years, None)
    w = warehouse.in_window(own, "2024-01-10", "2024-01-20", "America/New_York")
    shares = w.groupBy((F.col("event_id") % 3).alias("cluster")).agg(F.count("*").alias("n"))
    return m.select("discovery_ratio", "skip_rate", "old_share").crossJoin(evaluation.shannon_evenness(shares, "n").select(F.col("evenness").alias("cluster_evenness")))


@query("rpt3_report_cards")
def _(s, d):
    r = report.build(plays(s, d))
    return s.createDataFrame([(c["id"], json.dumps(c, default=str)) for c in r["cards"]], "card string, body string")


@query("rpt4_total_hours", f"WITH {PLAYS} SELECT SUM(ms_played) / 3.6e6 AS hours, COUNT(*) AS plays, COUNT(DISTINCT track_id) AS tracks, COUNT(DISTINCT artist_name) AS artists FROM plays", "hours")
def _(s, d):
    return plays(s, d).agg((F.sum("ms_played") / 3.6e6).alias("hours"), F.count("*").alias("plays"), F.count_distinct("track_id").alias("tracks"), F.count_distinct("artist_name").alias("artists"))


@query("api1_tool_markdown")
def _(s, d):
    return s.createDataFrame([(t, report.call(t, plays(s, d))) for t in ("top_artists", "summary", "no_such_tool")], "tool string, markdown string")


# --- streams --------------------------------------------------------------------------------------------------------


def _streamed(s, d, name, build, mode):
    """Run a stream over the events in four files, and give its last state."""
    path = scratch(s)
    table(s, d, "events").repartitionByRange(4, "ts").write.parquet(path)
    return live.run_to_end(build(live.event_stream(s, path)), s, f"{name}_{uuid.uuid4().hex[:8]}", mode, scratch(s))


@query("src21_progressive_dashboard", "SELECT event_type, COUNT(*) AS n, SUM(value) AS total FROM events GROUP BY 1", "total")
def _(s, d):
    return _streamed(s, d, "dashboard", live.dashboard, "complete")


@query("stream_taste_state", "SELECT user_id, COUNT(*) AS n, pow(0.95, COUNT(*) FILTER (event_type = 'error')) AS weight FROM events GROUP BY 1", "weight")
def _(s, d):
    got = _streamed(s, d, "taste", live.taste_state, "update")
    return got.groupBy("user_id").agg(F.max("n").alias("n"), F.min("weight").alias("weight"))


def arrivals(s, d, late: bool = False) -> tuple[str, int]:
    """(folder, files a batch): the events in four arrivals in the order of time; each is written after the one before.

    With `late`, every fiftieth event of the first half comes in a fifth one, and every twentieth is delivered twice at once. A batch
    drops what is older than the watermark that the batch before it had, so in the fourth one the last hour of the half would still pass.
    """
    path, files = scratch(s), 2
    own = table(s, d, "events")
    ends = own.agg(F.min("ts").alias("a"), F.max("ts").alias("b"))
    quarter = F.least(F.lit(3), F.floor(4 * F.expr("timestampdiff(SECOND, a, ts)") / F.greatest(F.lit(1), F.expr("timestampdiff(SECOND, a, b)"))))
    own = own.crossJoin(F.broadcast(ends)).withColumn("quarter", quarter).drop("a", "b")
    if late:
        own = own.withColumn("quarter", F.when((F.col("event_id") % 50 == 0) & (F.col("quarter") < 2), 4).otherwise(F.col("quarter")))
        own = own.withColumn("copy", F.explode(F.when(F.col("event_id") % 20 == 0, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0))))).drop("copy")
    for i in range(5 if late else 4):
        own.where(F.col("quarter") == i).drop("quarter").repartition(files).write.mode("append").parquet(path)
    return path, files


_QUARTERS = "q AS (SELECT e.*, a, b, LEAST(3, FLOOR(4.0 * FLOOR(epoch(ts - a)) / GREATEST(1, FLOOR(epoch(b - a))))) AS quarter FROM events e, (SELECT MIN(ts) AS a, MAX(ts) AS b FROM events))"


@query("stream_sliding_windows", f"""WITH {_QUARTERS}, kept AS (SELECT * FROM q WHERE NOT (event_id % 50 = 0 AND quarter < 2)), w AS (SELECT date_trunc('hour', ts) - INTERVAL 1 HOUR * i.range AS started_at, event_type, value FROM kept, range(2) i)
    SELECT started_at, event_type, COUNT(*) AS n, SUM(value) AS total FROM w WHERE started_at + INTERVAL 2 HOURS <= (SELECT MAX(ts) FROM kept) - INTERVAL 1 HOUR GROUP BY 1, 2""", "total")
def _(s, d):
    """Windows of two hours every hour over arrivals of which some are repeated and some far too late: those whose end has passed."""
    path, files = arrivals(s, d, late=True)
    done = live.run_to_end(live.sliding(live.event_stream(s, path, files)), s, f"sliding_{uuid.uuid4().hex[:8]}", "append", scratch(s))
    return done.withColumn("started_at", F.col("started_at").cast("timestamp_ntz"))


@query("stream_late_rows", f"WITH {_QUARTERS} SELECT COUNT(*) AS late FROM q, range(2) r WHERE event_id % 50 = 0 AND quarter < 2 AND (r.range = 0 OR event_id % 20 = 0)")
def _(s, d):
    """How many rows of those arrivals came too late, repeated ones among them."""
    path, files = arrivals(s, d, late=True)
    ended = live.start(live.sliding(live.event_stream(s, path, files)), f"late_{uuid.uuid4().hex[:8]}", "append", scratch(s))
    return table(s, d, "events").limit(1).select(F.lit(live.late_rows(ended)).cast("long").alias("late"))


@query("stream_interval_join", "SELECT a.user_id, a.event_id AS first_id, b.event_id AS then_id FROM events a JOIN events b ON a.user_id = b.user_id AND a.event_type = 'click' AND b.event_type = 'purchase' AND b.ts > a.ts AND b.ts <= a.ts + INTERVAL 6 HOURS")
def _(s, d):
    """Purchases within six hours of a click, joined as streams."""
    path, files = arrivals(s, d)
    return live.run_to_end(live.followed(live.event_stream(s, path, files), "click", "purchase", "6 hours"), s, f"followed_{uuid.uuid4().hex[:8]}", "append", scratch(s))


@query("stream_sessions", """WITH g AS (SELECT *, ts - LAG(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS gap FROM events), n AS (SELECT *, SUM(CASE WHEN gap IS NULL OR gap >= INTERVAL 30 MINUTES THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS k FROM g)
    SELECT user_id, MIN(ts) AS started_at, COUNT(*) AS n FROM n GROUP BY user_id, k HAVING MAX(ts) + INTERVAL 30 MINUTES <= (SELECT MAX(ts) FROM events) - INTERVAL 1 HOUR""")
def _(s, d):
    """Sessions that are over: those whose gap the watermark has passed."""
    path, files = arrivals(s, d)
    done = live.run_to_end(live.sessions(live.event_stream(s, path, files)), s, f"sessions_{uuid.uuid4().hex[:8]}", "append", scratch(s))
    return done.withColumn("started_at", F.col("started_at").cast("timestamp_ntz"))
