"""Queries: ingest, warehouse tables, named questions, windows and text."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import text
from ..operators import ingest, listening, ranks, warehouse
from ..sources.adapters import event_plays, line_plays, order_plays, table
from .registry import ORDERS, PLAYS, TRACKS, query

ZONE = "America/New_York"


def plays(s: SparkSession, d: str) -> DataFrame:
    return event_plays(table(s, d, "events"))


def long_plays(s: SparkSession, d: str) -> DataFrame:
    return order_plays(table(s, d, "orders"))


def tracks(s: SparkSession, d: str) -> DataFrame:
    return warehouse.tracks(plays(s, d))


def months(s: SparkSession, d: str) -> DataFrame:
    return warehouse.artist_months(long_plays(s, d))


# --- ingest ---------------------------------------------------------------------------------------------------------


@query("prj1_drop_columns", "SELECT event_id, user_id FROM events")
def _(s, d):
    return table(s, d, "events").drop("ts", "event_type", "value", "props", "not_there")


@query("prj2_rename", "SELECT event_id AS play_id, user_id AS listener FROM events")
def _(s, d):
    return table(s, d, "events").select("event_id", "user_id").withColumnsRenamed({"event_id": "play_id", "user_id": "listener"})


@query("prj3_calendar_parts", "SELECT event_id, YEAR(ts) AS year, MONTH(ts) AS month, HOUR(ts) AS hour_utc, ISODOW(ts) - 1 AS dow FROM events", longs="year month hour_utc dow")
def _(s, d):
    return ingest.with_calendar(table(s, d, "events").select("event_id", "ts")).drop("ts")


@query("prj4_prefix_strip", "SELECT c_custkey, regexp_replace(c_name, '^Customer#', '') AS short FROM customer")
def _(s, d):
    return table(s, d, "customer").select("c_custkey", F.regexp_replace("c_name", "^Customer#", "").alias("short"))


@query("prj5_day_grain", f"WITH {TRACKS} SELECT track_id, CAST(first_played AS DATE) AS first_played, CAST(last_played AS DATE) AS last_played FROM tracks", dates="first_played last_played")
def _(s, d):
    return warehouse.day_grain(tracks(s, d), "first_played", "last_played").select("track_id", "first_played", "last_played")


@query("prj6_play_rows", f"WITH {PLAYS} SELECT ts AS t, hour_utc, dow, artist_name AS artist, track_id, CAST(1 AS BIGINT) AS play_count, ms_played FROM plays", longs="hour_utc dow")
def _(s, d):
    return warehouse.play_rows(plays(s, d))


@query("src2_ingest_summary", f"WITH {PLAYS} SELECT COUNT(*) AS row_count, COUNT(DISTINCT track_id) AS unique_tracks, COUNT(*) FILTER (verdict = 1) AS rewards, COUNT(*) FILTER (verdict = -1) AS punishments, COUNT(*) FILTER (verdict = 0) AS neutral FROM plays")
def _(s, d):
    return ingest.ingest_summary(plays(s, d))


@query("ingest_completion_verdict", f"WITH {PLAYS} SELECT event_id, completion, verdict FROM plays", "completion", "verdict")
def _(s, d):
    return plays(s, d).select("event_id", "completion", "verdict")


@query("agg32_verdict_totals", f"WITH {PLAYS} SELECT verdict, COUNT(*) AS n FROM plays GROUP BY 1", longs="verdict")
def _(s, d):
    return plays(s, d).groupBy("verdict").agg(F.count("*").alias("n"))


@query("win9_max_over_partition", f"WITH {PLAYS} SELECT event_id, MAX(ms_played) OVER (PARTITION BY track_id) AS longest FROM plays")
def _(s, d):
    return plays(s, d).select("event_id", F.max("ms_played").over(Window.partitionBy("track_id")).alias("longest"))


# --- warehouse ------------------------------------------------------------------------------------------------------


@query("agg1_tracks", f"WITH {TRACKS} SELECT * FROM tracks", "skip_rate mean_completion")
def _(s, d):
    return tracks(s, d)


@query("agg2_artists", f"WITH {PLAYS} SELECT artist_name AS artist, COUNT(DISTINCT track_id) AS track_count, COUNT(*) AS play_count, SUM(ms_played) / 3.6e6 AS total_hours, MIN(ts) AS first_played, MAX(ts) AS last_played, AVG(CASE WHEN reason_end = 'fwdbtn' THEN 1.0 ELSE 0.0 END) AS skip_rate FROM plays GROUP BY 1", "total_hours skip_rate")
def _(s, d):
    return warehouse.artists(plays(s, d))


@query("agg3_artist_months", f"WITH {ORDERS} SELECT * FROM months")
def _(s, d):
    return months(s, d)


HOURLY = f"{PLAYS}, hourly AS (SELECT CAST(ts AS DATE) AS date, hour_utc, dow, artist_name AS artist, track_id, COUNT(*) AS play_count, CAST(SUM(ms_played) AS BIGINT) AS ms_played, CAST(SUM(CASE WHEN reason_end = 'fwdbtn' THEN 1 ELSE 0 END) AS BIGINT) AS skips FROM plays GROUP BY ALL)"


@query("agg4_plays_hourly", f"WITH {HOURLY} SELECT * FROM hourly", longs="hour_utc dow", dates="date")
def _(s, d):
    return warehouse.plays_hourly(plays(s, d))


@query("win1_gap", "SELECT event_id, epoch(ts - LAG(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id)) AS gap FROM events", "gap")
def _(s, d):
    gap = warehouse.with_gap(table(s, d, "events"), ("user_id",), ("ts", "event_id"))
    return gap.select("event_id", (F.expr("timestampdiff(MICROSECOND, ts - gap, ts)") / 1e6).alias("gap"))


_SESSION = f"{PLAYS}, g AS (SELECT *, CASE WHEN LAG(ts) OVER w IS NULL OR ts - LAG(ts) OVER w > INTERVAL 30 MINUTES THEN 1 ELSE 0 END AS f FROM plays WINDOW w AS (PARTITION BY artist_name ORDER BY ts, event_id)), s AS (SELECT *, CAST(SUM(f) OVER (PARTITION BY artist_name ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS BIGINT) AS session FROM g)"


@query("win2_sessions", f"WITH {_SESSION} SELECT artist_name, session, MIN(ts) AS started_at, MAX(ts) AS ended_at, COUNT(*) AS n_tracks, CAST(SUM(CASE WHEN reason_end = 'fwdbtn' THEN 1 ELSE 0 END) AS BIGINT) AS n_skips, CAST(SUM(ms_played) AS BIGINT) AS total_ms, MIN(artist_name) AS dominant_artist FROM s GROUP BY 1, 2")
def _(s, d):
    return warehouse.sessions(plays(s, d), ("artist_name",), ("ts", "event_id"))


@query("agg20_dominant_type", """WITH c AS (SELECT user_id, event_type, COUNT(*) AS n FROM events GROUP BY 1, 2), r AS (SELECT *, ROW_NUMBER() OVER (PARTITION BY user_id ORDER BY n DESC, event_type) AS k, SUM(n) OVER (PARTITION BY user_id) AS t FROM c)
    SELECT user_id, event_type AS mode, CAST(n AS DOUBLE) / t AS dominance FROM r WHERE k = 1""", "dominance")
def _(s, d):
    c = table(s, d, "events").groupBy("user_id", "event_type").agg(F.count("*").alias("n"))
    return c.groupBy("user_id").agg(F.min_by("event_type", F.struct(-F.col("n"), F.col("event_type"))).alias("mode"), (F.max("n") / F.sum("n")).alias("dominance"))


@query("flt1_not_blank", "SELECT doc_id FROM documents WHERE text IS NOT NULL AND text <> ''")
def _(s, d):
    return table(s, d, "documents").where(F.col("text").isNotNull() & (F.col("text") != "")).select("doc_id")


@query("flt2_half_open_range", "SELECT o_orderkey FROM orders WHERE o_orderdate >= TIMESTAMP '1996-01-01' AND o_orderdate < TIMESTAMP '1997-01-01'")
def _(s, d):
    return warehouse.between(table(s, d, "orders"), "1996-01-01", "1997-01-01", "o_orderdate").select("o_orderkey")


@query("flt3_local_window", f"SELECT event_id FROM events WHERE CAST(timezone('{ZONE}', timezone('UTC', ts)) AS DATE) >= DATE '2024-01-05' AND CAST(timezone('{ZONE}', timezone('UTC', ts)) AS DATE) < DATE '2024-01-12'")
def _(s, d):
    return warehouse.in_window(table(s, d, "events"), "2024-01-05", "2024-01-12", ZONE).select("event_id")


@query("flt4_substring", "SELECT p_partkey FROM part WHERE lower(p_name) LIKE '%' || lower('RE') || '%'")
def _(s, d):
    return table(s, d, "part").where(F.lower("p_name").like("%" + "RE".lower() + "%")).select("p_partkey")


@query("flt5_in_list", "SELECT p_partkey, p_name FROM part WHERE p_partkey IN (1, 5, 7, 99)")
def _(s, d):
    return table(s, d, "part").where(F.col("p_partkey").isin(1, 5, 7, 99)).select("p_partkey", "p_name")


@query("flt6_threshold", f"WITH {TRACKS} SELECT track_id FROM tracks WHERE play_count >= 5 AND skip_rate >= 0.3")
def _(s, d):
    return tracks(s, d).where("play_count >= 5 and skip_rate >= 0.3").select("track_id")


@query("flt7_between", "SELECT p_partkey FROM part WHERE p_size BETWEEN 10 AND 20")
def _(s, d):
    return table(s, d, "part").where(F.col("p_size").between(10, 20)).select("p_partkey")


@query("flt8_exclusions", """WITH x(name) AS (VALUES ('src1'), ('SRC2'), ('nobody')) SELECT 'kept' AS kind, source AS name, COUNT(*) AS n FROM documents WHERE lower(source) NOT IN (SELECT lower(name) FROM x) GROUP BY source
    UNION ALL SELECT 'unmatched', name, 0 FROM x WHERE lower(name) NOT IN (SELECT lower(source) FROM documents)""", longs="n")
def _(s, d):
    docs, x = table(s, d, "documents"), s.createDataFrame([("src1",), ("SRC2",), ("nobody",)], "name string")
    kept = docs.join(F.broadcast(x), F.lower("source") == F.lower("name"), "left_anti").groupBy(F.col("source").alias("name")).agg(F.count("*").alias("n"))
    missed = x.join(docs.select(F.lower("source").alias("s")).distinct(), F.lower("name") == F.col("s"), "left_anti")
    return kept.select(F.lit("kept").alias("kind"), "name", "n").unionByName(missed.select(F.lit("unmatched").alias("kind"), "name", F.lit(0).cast("long").alias("n")))


@query("flt9_grain_guard", f"WITH {ORDERS} SELECT date_trunc('year', month) AS period, CAST(SUM(play_count) AS BIGINT) AS play_count FROM months GROUP BY 1")
def _(s, d):
    grain = "year"
    if grain not in listening.GRAINS:
        raise ValueError(grain)
    return months(s, d).groupBy(F.date_trunc(grain, "month").alias("period")).agg(F.sum("play_count").alias("play_count"))


@query("flt10_literal_contains", "SELECT doc_id FROM documents WHERE contains(text, '***')")
def _(s, d):
    return table(s, d, "documents").where(F.col("text").contains("***")).select("doc_id")


# --- named questions ------------------------------------------------------------------------------------------------


@query("agg5_top_artists", f"WITH {PLAYS} SELECT artist_name AS artist, COUNT(*) AS play_count, SUM(ms_played) / 3.6e6 AS total_hours FROM plays WHERE ts >= TIMESTAMP '2024-01-03' AND ts < TIMESTAMP '2024-01-25' GROUP BY 1 ORDER BY play_count DESC, artist LIMIT 20", "total_hours")
def _(s, d):
    return listening.top_artists(plays(s, d), "2024-01-03", "2024-01-25")


@query("agg5_top_artists_hourly", f"WITH {HOURLY} SELECT artist, CAST(SUM(play_count) AS BIGINT) AS play_count, SUM(ms_played) / 3.6e6 AS total_hours FROM hourly GROUP BY 1 ORDER BY play_count DESC, artist LIMIT 20", "total_hours")
def _(s, d):
    return listening.top_artists(warehouse.plays_hourly(plays(s, d)))


@query("top1_top_tracks", f"WITH {TRACKS} SELECT track_id, name, artist, album, play_count FROM tracks ORDER BY play_count DESC, track_id LIMIT 20")
def _(s, d):
    return listening.top_tracks(tracks(s, d))


_KEY = r"trim(regexp_replace(regexp_replace(lower(trim(coalesce({a}, '')) || '|' || trim(coalesce({b}, ''))), '\s*[\(\[](deluxe|remaster(ed)?|expanded|bonus track|anniversary|special)[^\)\]]*[\)\]]\s*', ' ', 'gi'), '\s+', ' ', 'g'))"


@query("agg9_top_albums", f"WITH {TRACKS}, k AS (SELECT *, {_KEY.format(a='artist', b='album')} AS key FROM tracks WHERE album <> '') SELECT arg_min(artist, track_id) AS artist, arg_min(album, track_id) AS album, CAST(SUM(play_count) AS BIGINT) AS play_count, SUM(total_ms) / 3.6e6 AS total_hours FROM k GROUP BY key ORDER BY play_count DESC, key LIMIT 20", "total_hours")
def _(s, d):
    return listening.top_albums(tracks(s, d))


@query("str1_album_key", f"WITH {PLAYS} SELECT DISTINCT artist_name, album_name, {_KEY.format(a='artist_name', b='album_name')} AS key FROM plays")
def _(s, d):
    return plays(s, d).select("artist_name", "album_name", text.album_key("artist_name", "album_name").alias("key")).distinct()


@query("agg6_summary", f"WITH {PLAYS} SELECT MIN(ts) AS earliest_play, MAX(ts) AS latest_play, COUNT(*) AS total_plays, COUNT(DISTINCT track_id) AS unique_tracks, COUNT(DISTINCT artist_name) AS unique_artists, SUM(ms_played) / 3.6e6 AS total_hours FROM plays", "total_hours")
def _(s, d):
    return listening.summary(plays(s, d))


@query("agg7_clock", f"WITH {PLAYS} SELECT hour_utc, dow, COUNT(*) AS play_count FROM plays GROUP BY 1, 2", longs="hour_utc dow")
def _(s, d):
    return listening.clock(plays(s, d))


_LOCAL = f"timezone('{ZONE}', timezone('UTC', ts))"


@query("agg7b_dense_clock", f"WITH {PLAYS}, own AS (SELECT ISODOW({_LOCAL}) - 1 AS dow, HOUR({_LOCAL}) AS hour, COUNT(*) AS n FROM plays GROUP BY 1, 2) SELECT w.dow, h.hour, COALESCE(n, 0) AS play_count FROM range(7) AS w(dow) CROSS JOIN range(24) AS h(hour) LEFT JOIN own USING (dow, hour)", longs="dow hour")
def _(s, d):
    return listening.dense_clock(plays(s, d), ZONE)


@query("agg8_time_of_day", f"WITH {PLAYS}, own AS (SELECT HOUR({_LOCAL}) AS hour, COUNT(*) AS n FROM plays GROUP BY 1), f AS (SELECT h.hour, COALESCE(n, 0) AS play_count FROM range(24) AS h(hour) LEFT JOIN own USING (hour)) SELECT *, ROW_NUMBER() OVER (ORDER BY play_count DESC, hour) = 1 AS is_peak FROM f", longs="hour play_count")
def _(s, d):
    return listening.time_of_day(plays(s, d), ZONE)


@query("top2_skip_offenders", f"WITH {TRACKS} SELECT track_id, name, artist, play_count, skip_rate FROM tracks WHERE play_count >= 5 AND skip_rate >= 0.3", "skip_rate")
def _(s, d):
    return listening.skip_offenders(tracks(s, d))


_LONG_TRACKS = f"{ORDERS}, tracks AS (SELECT artist_name AS track_id, artist_name AS name, artist_name AS artist, COUNT(*) AS play_count, MAX(ts) AS last_played FROM long_plays GROUP BY artist_name)"


def long_tracks(s: SparkSession, d: str) -> DataFrame:
    a = F.col("artist_name")
    return long_plays(s, d).groupBy(a.alias("track_id")).agg(F.min(a).alias("name"), F.min(a).alias("artist"), F.count("*").alias("play_count"), F.max("ts").alias("last_played"))


@query("top3_rediscovery", f"WITH {_LONG_TRACKS} SELECT * FROM tracks WHERE play_count >= 10 AND last_played < (SELECT MAX(last_played) FROM tracks) - INTERVAL 6 MONTHS")
def _(s, d):
    return listening.rediscovery(long_tracks(s, d))


@query("top4_search", f"WITH {TRACKS} SELECT track_id, name, artist, album, play_count FROM tracks WHERE lower(name) LIKE '%song 1%' OR lower(artist) LIKE '%song 1%' ORDER BY play_count DESC, track_id LIMIT 20")
def _(s, d):
    return listening.search(tracks(s, d), "Song 1")


@query("top5_track_detail", f"WITH {TRACKS} SELECT * FROM tracks WHERE track_id = '7-3' OR lower(name) LIKE '%7-3%' ORDER BY track_id = '7-3' DESC, play_count DESC, track_id LIMIT 1", "skip_rate mean_completion")
def _(s, d):
    return listening.track_detail(tracks(s, d), "7-3")


@query("top6_tracks_by_ids", f"WITH {TRACKS} SELECT track_id, play_count FROM tracks WHERE track_id IN ('7-3', '12-1', '99-9')")
def _(s, d):
    return listening.tracks_by_ids(tracks(s, d), ["7-3", "12-1", "99-9"]).select("track_id", "play_count")


@query("top7_recent_plays", f"WITH {PLAYS} SELECT ts, track_id, track_name, artist_name FROM plays ORDER BY ts DESC, track_id LIMIT 50")
def _(s, d):
    return listening.recent_plays(plays(s, d))


@query("top8_hourly_recent", f"WITH {HOURLY} SELECT * FROM hourly ORDER BY date DESC, hour_utc DESC, track_id LIMIT 50", longs="hour_utc dow", dates="date")
def _(s, d):
    return listening.hourly_recent(warehouse.plays_hourly(plays(s, d)))


@query("top12_most_common", "SELECT event_type, COUNT(*) AS n FROM events GROUP BY 1 ORDER BY n DESC, event_type LIMIT 3")
def _(s, d):
    return ranks.top(table(s, d, "events").groupBy("event_type").agg(F.count("*").alias("n")), 3, F.desc("n"), "event_type")


@query("top15_truncated", "SELECT c_custkey, (SELECT COUNT(*) FROM customer) - 40 AS more FROM customer ORDER BY c_custkey LIMIT 40")
def _(s, d):
    c = table(s, d, "customer")
    return c.orderBy("c_custkey").limit(40).select("c_custkey").crossJoin(F.broadcast(c.agg((F.count("*") - 40).alias("more"))))


_SPRINT = f"{ORDERS}, r AS (SELECT *, ROW_NUMBER() OVER (PARTITION BY month ORDER BY play_count DESC, artist) AS k FROM months), who AS (SELECT DISTINCT artist FROM r WHERE k <= 5), sprint AS (SELECT artist, month, play_count, CAST(SUM(play_count) OVER (PARTITION BY artist ORDER BY month ROWS UNBOUNDED PRECEDING) AS BIGINT) AS cumulative_plays FROM months WHERE artist IN (SELECT artist FROM who))"
_MATRIX = f"{_SPRINT}, spine AS (SELECT unnest(generate_series((SELECT MIN(month) FROM months), (SELECT MAX(month) FROM months), INTERVAL 1 MONTH)) AS month), full_grid AS (SELECT w.artist, spine.month, cumulative_plays AS c FROM spine CROSS JOIN who w LEFT JOIN sprint s ON s.artist = w.artist AND s.month = spine.month), matrix AS (SELECT artist, month, COALESCE(last_value(c IGNORE NULLS) OVER (PARTITION BY artist ORDER BY month ROWS UNBOUNDED PRECEDING), 0) AS cumulative_plays FROM full_grid)"


@query("rpt6_artist_sprint", f"WITH {_SPRINT} SELECT * FROM sprint")
def _(s, d):
    return listening.artist_sprint(months(s, d))


@query("win12_sprint_matrix", f"WITH {_MATRIX} SELECT * FROM matrix", longs="cumulative_plays")
def _(s, d):
    return listening.sprint_matrix(months(s, d))


@query("vis3_chart_frame", f"WITH {_MATRIX}, p AS (SELECT artist, ROW_NUMBER() OVER w - 1 AS i, cumulative_plays AS a, LEAD(cumulative_plays) OVER w AS b FROM matrix WINDOW w AS (PARTITION BY artist ORDER BY month)) SELECT artist, a + (COALESCE(b, a) - a) * 0.25 AS value FROM p WHERE i = 20 AND a + (COALESCE(b, a) - a) * 0.25 > 0 ORDER BY value DESC, artist LIMIT 10", "value")
def _(s, d):
    return listening.chart_frame(listening.sprint_matrix(months(s, d)), 20.25, 10)


@query("rpt13_binged_then_abandoned", f"WITH {ORDERS}, m AS (SELECT *, YEAR(month) * 12 + MONTH(month) AS i FROM months), f AS (SELECT artist, month, play_count, COALESCE(SUM(play_count) OVER (PARTITION BY artist ORDER BY i RANGE BETWEEN 1 FOLLOWING AND 3 FOLLOWING), 0) AS n FROM m) SELECT artist, month AS spike_month, play_count AS spike_plays, CAST(n AS BIGINT) AS followup_plays FROM f WHERE play_count >= 2 AND n <= 1")
def _(s, d):
    return listening.binged_then_abandoned(months(s, d), min_plays=2)


@query("jn9_following_months", f"WITH {ORDERS} SELECT a.artist, a.month, CAST(COALESCE(SUM(b.play_count), 0) AS BIGINT) AS after FROM months a LEFT JOIN months b ON b.artist = a.artist AND b.month > a.month AND b.month <= a.month + INTERVAL 3 MONTHS GROUP BY 1, 2")
def _(s, d):
    m = months(s, d).withColumn("i", F.year("month") * 12 + F.month("month"))
    return m.select("artist", "month", F.coalesce(F.sum("play_count").over(Window.partitionBy("artist").orderBy("i").rangeBetween(1, 3)), F.lit(0)).alias("after"))


@query("rpt14_taste_drift", f"WITH {ORDERS}, p AS (SELECT date_trunc('quarter', ts) AS period, artist_name AS artist, COUNT(*) AS play_count FROM long_plays GROUP BY 1, 2), r AS (SELECT *, ROW_NUMBER() OVER (PARTITION BY period ORDER BY play_count DESC, artist) AS rank FROM p) SELECT period, rank, artist, play_count FROM r WHERE rank <= 5")
def _(s, d):
    return listening.taste_drift(long_plays(s, d).withColumn("hour_utc", F.hour("ts")).withColumn("dow", F.weekday("ts")))


@query("rpt15_drift_shares", f"""WITH {ORDERS}, p AS (SELECT date_trunc('year', ts) AS period, artist_name AS artist, COUNT(*) AS n FROM long_plays GROUP BY 1, 2), l AS (SELECT DISTINCT artist FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY period ORDER BY n DESC, artist) AS k FROM p) WHERE k = 1),
    c AS (SELECT artist FROM (SELECT artist, SUM(n) AS n FROM p GROUP BY 1) LEFT JOIN (SELECT artist, 1 AS lead FROM l) USING (artist) ORDER BY COALESCE(lead, 0) DESC, n DESC, artist LIMIT 5),
    q AS (SELECT period, CASE WHEN artist IN (SELECT artist FROM c) THEN artist ELSE 'other' END AS series, SUM(n) AS n FROM p GROUP BY 1, 2) SELECT period, series, n / SUM(n) OVER (PARTITION BY period) AS share FROM q""", "share")
def _(s, d):
    return listening.drift_shares(long_plays(s, d).withColumn("hour_utc", F.hour("ts")).withColumn("dow", F.weekday("ts")), "year")


# --- windows, sets --------------------------------------------------------------------------------------------------


@query("win3_row_number", "SELECT * FROM (SELECT o_custkey, o_orderkey, ROW_NUMBER() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS rank FROM orders) WHERE rank <= 2")
def _(s, d):
    return ranks.top_per(table(s, d, "orders"), 2, ["o_custkey"], [F.desc("o_totalprice"), "o_orderkey"]).select("o_custkey", "o_orderkey", "rank")


@query("win4_rank_per_month", f"WITH {ORDERS} SELECT artist, month, ROW_NUMBER() OVER (PARTITION BY month ORDER BY play_count DESC, artist) AS rank FROM months")
def _(s, d):
    return months(s, d).select("artist", "month", F.row_number().over(Window.partitionBy("month").orderBy(F.desc("play_count"), "artist")).alias("rank"))


@query("win5_percent_rank", "SELECT p_partkey, (RANK() OVER (ORDER BY p_size) + (COUNT(*) OVER (PARTITION BY p_size) - 1) / 2.0) / COUNT(*) OVER () AS pct FROM part", "pct")
def _(s, d):
    return ranks.percent_rank(table(s, d, "part"), "p_size", "pct").select("p_partkey", "pct")


@query("win6_min_rank", "SELECT p_partkey, RANK() OVER (ORDER BY p_size DESC) AS rank FROM part")
def _(s, d):
    return ranks.min_rank(table(s, d, "part"), "p_size", "rank").select("p_partkey", "rank")


@query("win7_unit_position", "SELECT p_partkey, (ROW_NUMBER() OVER (PARTITION BY p_brand ORDER BY p_retailprice, p_partkey) - 1) / NULLIF(COUNT(*) OVER (PARTITION BY p_brand) - 1.0, 0) AS pos FROM part", "pos")
def _(s, d):
    return ranks.unit_position(table(s, d, "part"), "p_retailprice", "p_partkey", "pos", ["p_brand"]).select("p_partkey", "pos")


@query("win8_running_sum", f"WITH {ORDERS} SELECT artist, month, CAST(SUM(play_count) OVER (PARTITION BY artist ORDER BY month) AS BIGINT) AS running FROM months")
def _(s, d):
    return months(s, d).select("artist", "month", F.sum("play_count").over(Window.partitionBy("artist").orderBy("month")).alias("running"))


@query("win10_first_occurrence", f"WITH {PLAYS} SELECT event_id, ROW_NUMBER() OVER (PARTITION BY track_id ORDER BY ts, event_id) = 1 AS first FROM plays")
def _(s, d):
    return plays(s, d).select("event_id", (F.row_number().over(Window.partitionBy("track_id").orderBy("ts", "event_id")) == 1).alias("first"))


@query("win11_last_per_group", f"WITH {ORDERS} SELECT artist, MAX(month) AS month, arg_max(play_count, month) AS play_count FROM months GROUP BY 1")
def _(s, d):
    return months(s, d).groupBy("artist").agg(F.max("month").alias("month"), F.max_by("play_count", "month").alias("play_count"))


@query("win13_one_per_key_then_head", "SELECT p_partkey, p_brand, p_retailprice FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY p_brand ORDER BY p_retailprice DESC, p_partkey) AS k FROM part) WHERE k = 1 ORDER BY p_retailprice DESC, p_partkey LIMIT 5", "p_retailprice")
def _(s, d):
    one = ranks.keep_one(table(s, d, "part"), ["p_brand"], [F.desc("p_retailprice"), "p_partkey"])
    return ranks.top(one.select("p_partkey", "p_brand", "p_retailprice"), 5, F.desc("p_retailprice"), "p_partkey")


@query("win14_keep_last", "SELECT event_id FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY user_id, event_type ORDER BY ts DESC, event_id DESC) AS k FROM events) WHERE k = 1")
def _(s, d):
    return ranks.keep_one(table(s, d, "events"), ["user_id", "event_type"], [F.desc("ts"), F.desc("event_id")]).select("event_id")


@query("win15_keep_first", "SELECT event_id FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS k FROM events) WHERE k = 1")
def _(s, d):
    return ranks.keep_one(table(s, d, "events"), ["user_id"], ["ts", "event_id"]).select("event_id")


@query("win16_deciles", "SELECT s_suppkey, GREATEST(CEIL((k - 1) / ((n - 1) / 10.0)) - 1, 0) AS decile FROM (SELECT s_suppkey, ROW_NUMBER() OVER (ORDER BY s_acctbal DESC, s_suppkey) AS k, COUNT(*) OVER () AS n FROM supplier)", longs="decile")
def _(s, d):
    one = table(s, d, "supplier").withColumn("one", F.lit(1))
    w = Window.partitionBy("one")
    return one.select("s_suppkey", ranks.decile(F.row_number().over(w.orderBy(F.desc("s_acctbal"), "s_suppkey")), F.count("*").over(w)).alias("decile"))


@query("top11_head_lists", "SELECT p_brand, string_agg(p_name, '|' ORDER BY p_retailprice DESC, p_partkey) AS names FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY p_brand ORDER BY p_retailprice DESC, p_partkey) AS k FROM part) WHERE k <= 3 GROUP BY 1")
def _(s, d):
    head = ranks.top_per(table(s, d, "part"), 3, ["p_brand"], [F.desc("p_retailprice"), "p_partkey"], "k")
    return head.groupBy("p_brand").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("k", "p_name"))), lambda x: x["p_name"]), "|").alias("names"))


@query("top13_argmax", "SELECT arg_max(p_partkey, (p_retailprice, p_partkey)) AS p_partkey FROM part")
def _(s, d):
    return table(s, d, "part").agg(F.max_by("p_partkey", F.struct("p_retailprice", "p_partkey")).alias("p_partkey"))


@query("top14_seeded_sample", "SELECT p_partkey FROM part ORDER BY md5(p_partkey || '-7'), p_partkey LIMIT 25")
def _(s, d):
    """25 parts drawn without replacement: those whose hashes, with the seed, are smallest."""
    draw = F.md5(F.concat(F.col("p_partkey").cast("string"), F.lit("-7")))
    return table(s, d, "part").orderBy(draw, "p_partkey").limit(25).select("p_partkey")


@query("set1_union_keep_last", "SELECT user_id, v FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY user_id ORDER BY b DESC, event_id DESC) AS k FROM (SELECT user_id, event_id, value AS v, 1 AS b FROM events WHERE event_type = 'view' UNION ALL SELECT user_id, event_id, -value, 2 FROM events WHERE event_type = 'click')) WHERE k = 1", "v")
def _(s, d):
    e = table(s, d, "events")
    both = e.where("event_type = 'view'").select("user_id", "event_id", F.col("value").alias("v"), F.lit(1).alias("b")).unionByName(e.where("event_type = 'click'").select("user_id", "event_id", (-F.col("value")).alias("v"), F.lit(2).alias("b")))
    return ranks.keep_one(both, ["user_id"], [F.desc("b"), F.desc("event_id")]).select("user_id", "v")


@query("set2_difference", "SELECT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderdate < TIMESTAMP '1996-01-01')")
def _(s, d):
    return table(s, d, "customer").join(warehouse.between(table(s, d, "orders"), end="1996-01-01", t="o_orderdate"), F.col("c_custkey") == F.col("o_custkey"), "left_anti").select("c_custkey")


@query("set3_distinct_years", f"SELECT DISTINCT YEAR({_LOCAL.replace('ts', 'o_orderdate')}) AS year FROM orders", longs="year")
def _(s, d):
    return table(s, d, "orders").select(F.year(warehouse.local("o_orderdate", ZONE)).alias("year")).distinct()


@query("set4_ordered_dedupe", "SELECT user_id, string_agg(event_type, '>' ORDER BY p) AS kinds, CAST(SUM(n) - COUNT(*) AS BIGINT) AS dropped FROM (SELECT user_id, event_type, MIN(event_id) AS p, COUNT(*) AS n FROM events GROUP BY 1, 2) GROUP BY 1")
def _(s, d):
    first = table(s, d, "events").groupBy("user_id", "event_type").agg(F.min("event_id").alias("p"), F.count("*").alias("n"))
    return first.groupBy("user_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("p", "event_type"))), lambda x: x["event_type"]), ">").alias("kinds"), (F.sum("n") - F.count("*")).alias("dropped"))


@query("set6_union_distinct", "SELECT o_custkey AS k FROM orders UNION SELECT c_custkey FROM customer")
def _(s, d):
    return table(s, d, "orders").select(F.col("o_custkey").alias("k")).union(table(s, d, "customer").select("c_custkey")).distinct()


# --- text and dates -------------------------------------------------------------------------------------------------

_VARIANT = "p_name || CASE p_partkey % 4 WHEN 0 THEN ' (Live)' WHEN 1 THEN ' - Remastered 2011' WHEN 2 THEN ' feat. Someone' ELSE '' END"


def titles(s: SparkSession, d: str) -> DataFrame:
    k = F.col("p_partkey") % 4
    return table(s, d, "part").select("p_partkey", "p_brand", F.concat("p_name", F.when(k == 0, " (Live)").when(k == 1, " - Remastered 2011").when(k == 2, " feat. Someone").otherwise("")).alias("title"))


_MODS = ("live", "remix", "acoustic", "cover", "remaster", "demo", "instrumental")
_CLEAN = rf"trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(lower(title), '\b(feat|ft)\b\.?', ' ', 'g'), '[\(\[][^\)\]]*[\)\]]', ' ', 'g'), '\b({'|'.join(_MODS)})\w*\b', ' ', 'g'), '[^a-z0-9 ]', ' ', 'g'), '\s+', ' ', 'g'))"
_TITLES = f"titles AS (SELECT p_partkey, p_brand, {_VARIANT} AS title FROM part)"


@query("str2_normalize", f"WITH {_TITLES} SELECT p_partkey, {_CLEAN} AS clean, concat_ws(',', " + ", ".join(rf"CASE WHEN regexp_matches(lower(title), '\b{m}\w*\b') THEN '{m}' END" for m in _MODS) + ") AS modifiers FROM titles")
def _(s, d):
    return titles(s, d).select("p_partkey", text.clean_title("title").alias("clean"), F.array_join(text.modifiers("title"), ",").alias("modifiers"))


@query("str5_split_query", f"WITH {_TITLES} SELECT p_partkey, CASE WHEN contains(title, ' - ') THEN trim(split_part(title, ' - ', 1)) ELSE '' END AS artist, CASE WHEN contains(title, ' - ') THEN trim(substr(title, instr(title, ' - ') + 3)) ELSE trim(title) END AS name FROM titles")
def _(s, d):
    a, t = text.split_query("title")
    return titles(s, d).select("p_partkey", a.alias("artist"), t.alias("name"))


@query("str6_fold_suffix", f"WITH {_TITLES} SELECT p_partkey, regexp_replace(title, '^(.*?) - (.*)$', '\\1 (\\2)') AS folded FROM titles")
def _(s, d):
    return titles(s, d).select("p_partkey", text.fold_suffix("title").alias("folded"))


@query("str7_match_status", "SELECT s_suppkey, CASE WHEN s_acctbal / 10000 >= 0.72 THEN 'matched' WHEN s_acctbal / 10000 >= 0.5 THEN 'best guess' ELSE 'missed' END AS status FROM supplier")
def _(s, d):
    x = F.col("s_acctbal") / 10000
    return table(s, d, "supplier").select("s_suppkey", F.when(x >= 0.72, "matched").when(x >= 0.5, "best guess").otherwise("missed").alias("status"))


@query("str8_base_title", rf"WITH {_TITLES} SELECT p_partkey, trim(regexp_replace(split_part(lower(title), ' - ', 1), '\([^)]*\)', '', 'g')) AS base FROM titles")
def _(s, d):
    return titles(s, d).select("p_partkey", text.base_title("title").alias("base"))


@query("str9_slug", f"WITH {_TITLES} SELECT p_partkey, left(regexp_replace(regexp_replace(lower(title), '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g'), 40) AS slug FROM titles")
def _(s, d):
    return titles(s, d).select("p_partkey", text.slug("title").alias("slug"))


@query("str10_clock_label", "SELECT DISTINCT HOUR(ts) AS hour, CASE WHEN HOUR(ts) % 12 = 0 THEN 12 ELSE HOUR(ts) % 12 END || CASE WHEN HOUR(ts) < 12 THEN ' AM' ELSE ' PM' END AS label FROM events", longs="hour")
def _(s, d):
    return table(s, d, "events").select(F.hour("ts").alias("hour")).distinct().select("hour", text.clock_label("hour").alias("label"))


@query("str12_prompt_text", "SELECT event_id, concat_ws(chr(10), 'Type: ' || event_type, CASE WHEN value > 50 THEN 'Value: ' || CAST(CAST(ROUND(value) AS BIGINT) AS VARCHAR) END, CASE WHEN event_id % 2 = 0 THEN 'Props: ' || props END) AS prompt FROM events")
def _(s, d):
    value = F.when(F.col("value") > 50, F.concat(F.lit("Value: "), F.round("value").cast("long").cast("string")))
    return table(s, d, "events").select("event_id", F.concat_ws("\n", F.concat(F.lit("Type: "), "event_type"), value, F.when(F.col("event_id") % 2 == 0, F.concat(F.lit("Props: "), "props"))).alias("prompt"))


@query("dat1_parse_utc", "SELECT event_id, CAST(strftime(ts, '%Y-%m-%dT%H:%M:%S') AS TIMESTAMP) AS t FROM events")
def _(s, d):
    return table(s, d, "events").select("event_id", F.to_timestamp_ntz(F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss"), F.lit("yyyy-MM-dd'T'HH:mm:ss")).alias("t"))


@query("dat2_date_trunc", "SELECT o_orderkey, date_trunc('month', o_orderdate) AS m, date_trunc('quarter', o_orderdate) AS q, date_trunc('year', o_orderdate) AS y FROM orders")
def _(s, d):
    return table(s, d, "orders").select("o_orderkey", *[F.date_trunc(g, "o_orderdate").cast("timestamp_ntz").alias(g[0]) for g in ("month", "quarter", "year")])


@query("dat3_zone", f"SELECT event_id, {_LOCAL} AS t FROM events")
def _(s, d):
    return table(s, d, "events").select("event_id", warehouse.local("ts", ZONE).alias("t"))


@query("dat4_intervals", "SELECT o_orderkey, o_orderdate - INTERVAL 6 MONTHS AS a, o_orderdate - INTERVAL 90 DAYS AS b, o_orderdate + INTERVAL 30 MINUTES AS c FROM orders")
def _(s, d):
    t = F.col("o_orderdate")
    return table(s, d, "orders").select("o_orderkey", (t - F.expr("INTERVAL 6 MONTHS")).alias("a"), (t - F.expr("INTERVAL 90 DAYS")).alias("b"), (t + F.expr("INTERVAL 30 MINUTES")).alias("c"))


@query("dat5_month_spine", f"WITH {ORDERS} SELECT unnest(generate_series((SELECT MIN(month) FROM months), (SELECT MAX(month) FROM months), INTERVAL 1 MONTH)) AS month")
def _(s, d):
    return ranks.month_spine(months(s, d))


@query("dat6_weekend", f"SELECT event_id, ISODOW({_LOCAL}) >= 6 OR (ISODOW({_LOCAL}) = 5 AND HOUR({_LOCAL}) >= 17) AS weekend FROM events")
def _(s, d):
    t = warehouse.local("ts", ZONE)
    return table(s, d, "events").select("event_id", ((F.weekday(t) >= 5) | ((F.weekday(t) == 4) & (F.hour(t) >= 17))).alias("weekend"))


@query("dat7_adaptive_label", "SELECT o_orderkey, CASE WHEN date_diff('day', lo, hi) > 6 * 365.25 THEN CAST(YEAR(o_orderdate) AS VARCHAR) ELSE YEAR(o_orderdate) || ' Q' || QUARTER(o_orderdate) END AS label FROM orders, (SELECT MIN(o_orderdate) AS lo, MAX(o_orderdate) AS hi FROM orders)")
def _(s, d):
    o, t = table(s, d, "orders"), F.col("o_orderdate")
    span = F.broadcast(o.agg((F.date_diff(F.max(t), F.min(t)) > 6 * 365.25).alias("long")))
    return o.crossJoin(span).select("o_orderkey", F.when(F.col("long"), F.year(t).cast("string")).otherwise(F.concat(F.year(t).cast("string"), F.lit(" Q"), F.quarter(t).cast("string"))).alias("label"))
