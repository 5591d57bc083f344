"""Queries: cards of all windows in one pass, and the visitor's report. Orders are plays of several years, in a zone west of UTC."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import cards
from ..sources import reports
from ..sources.adapters import table
from ..sources.stored import scratch
from .registry import query

ZONE = "America/New_York"

_PLAYS = """p AS (SELECT timezone('America/New_York', timezone('UTC', o_orderdate)) AS lt, CAST(o_custkey AS VARCHAR) AS artist, o_orderpriority || o_custkey AS track_id, 'Song ' || o_orderpriority || o_custkey AS name,
    o_custkey || '/' || (ascii(o_orderpriority) % 3) || CASE WHEN ascii(o_orderpriority) % 2 = 1 THEN ' (Remastered)' ELSE '' END AS album, o_custkey || '|' || o_custkey || '/' || (ascii(o_orderpriority) % 3) AS album_key,
    CAST(ROUND(o_totalprice) AS BIGINT) AS ms, CAST(o_orderstatus = 'O' AS INTEGER) AS skip, CASE WHEN o_custkey % 5 <> 0 THEN 1950 + (o_custkey * 7 + ascii(o_orderpriority)) % 60 END AS own_year, o_custkey % 6 AS cluster, o_custkey % 4 <> 0 AS measured FROM orders),
    k AS (SELECT album_key, MIN(own_year) AS release_year FROM p GROUP BY 1)"""
_TRACKS = f"""{_PLAYS}, t AS (SELECT coalesce(CAST(y AS VARCHAR), 'all') AS window_id, track_id, MIN(name) AS name, MIN(artist) AS artist, MIN(album) AS album, ANY_VALUE(album_key) AS album_key, ANY_VALUE(cluster) AS cluster, ANY_VALUE(measured) AS measured,
    COUNT(*) AS plays, SUM(ms) AS ms, SUM(skip) AS skips, MIN(lt) AS first_played, MAX(lt) AS last_played FROM (SELECT *, YEAR(lt) AS y FROM p) GROUP BY GROUPING SETS ((y, track_id), (track_id)))"""
_TOPS = f"""{_TRACKS}, a AS (SELECT window_id, artist AS key, artist AS label, SUM(plays) AS plays, 'top_artists' AS card FROM t GROUP BY 1, 2), b AS (SELECT window_id, track_id AS key, name AS label, plays, 'top_tracks' AS card FROM t),
    c AS (SELECT window_id, album_key AS key, arg_min(artist || ' - ' || album, track_id) AS label, SUM(plays) AS plays, 'top_albums' AS card FROM t GROUP BY 1, 2),
    tops AS (SELECT window_id, card, label, CAST(plays AS BIGINT) AS plays, ROW_NUMBER() OVER (PARTITION BY window_id, card ORDER BY plays DESC, key) AS place FROM (SELECT * FROM a UNION ALL SELECT * FROM b UNION ALL SELECT * FROM c) QUALIFY place <= 5)"""
_AGES = """d AS (SELECT t.*, release_year FROM t JOIN k USING (album_key)), e AS (SELECT window_id, YEAR(MAX(last_played)) AS last, COUNT(*) AS tracks_of, COUNT(release_year) AS tracks_used, CAST(SUM(plays) AS BIGINT) AS plays_of, CAST(SUM(plays) FILTER (release_year IS NOT NULL) AS BIGINT) AS plays_used FROM d GROUP BY 1),
    m AS (SELECT window_id, CAST(FLOOR(median(release_year)) AS BIGINT) AS year FROM (SELECT window_id, release_year, unnest(range(plays)) FROM d WHERE release_year IS NOT NULL) GROUP BY 1),
    o AS (SELECT window_id, 'oldest: ' || arg_min(artist || ', "' || album || '" (' || release_year || ')', (release_year, -plays, track_id)) AS oldest, SUM(CASE WHEN release_year < last - 20 THEN plays ELSE 0 END) / SUM(plays) AS old_share FROM d JOIN e USING (window_id) WHERE release_year IS NOT NULL GROUP BY 1),
    ages AS (SELECT window_id, year, oldest, old_share, tracks_used, tracks_of, plays_used, plays_of, 'Tier B · covers ' || CAST(ROUND(100.0 * plays_used / plays_of) AS BIGINT) || '% of plays' AS coverage FROM e JOIN m USING (window_id) JOIN o USING (window_id))"""
_DECADES = """g AS (SELECT window_id, release_year // 10 * 10 AS decade, CAST(SUM(plays) AS BIGINT) AS plays FROM t JOIN k USING (album_key) WHERE release_year IS NOT NULL GROUP BY 1, 2),
    decades AS (SELECT *, plays / SUM(plays) OVER (PARTITION BY window_id) AS share, ROW_NUMBER() OVER (PARTITION BY window_id ORDER BY plays DESC, decade) AS place FROM g)"""
_CLUSTERS = """h AS (SELECT window_id, cluster, CAST(SUM(plays) AS BIGINT) AS plays, COUNT(*) AS tracks, COUNT(*) FILTER (measured) AS measured FROM t GROUP BY 1, 2),
    n AS (SELECT window_id, cluster, artist, ROW_NUMBER() OVER (PARTITION BY window_id, cluster ORDER BY SUM(plays) DESC, artist) AS pos FROM t GROUP BY 1, 2, 3), x AS (SELECT window_id, cluster, string_agg(artist, ', ' ORDER BY pos) AS artists, string_agg(artist, ', ' ORDER BY pos) FILTER (pos <= 2) AS two FROM n WHERE pos <= 3 GROUP BY 1, 2),
    clusters AS (SELECT window_id, cluster, 'Vibe ' || cluster AS name, plays, plays / SUM(plays) OVER w AS share, tracks, artists, two, ROW_NUMBER() OVER (PARTITION BY window_id ORDER BY plays DESC, cluster) AS place, SUM(tracks) OVER w AS all_tracks, SUM(measured) OVER w AS all_measured FROM h JOIN x USING (window_id, cluster) WINDOW w AS (PARTITION BY window_id))"""
_HOURS = "w AS (SELECT coalesce(CAST(y AS VARCHAR), 'all') AS window_id, hour, COUNT(*) AS plays FROM (SELECT YEAR(lt) AS y, HOUR(lt) AS hour FROM p) GROUP BY GROUPING SETS ((y, hour), (hour))), hours AS (SELECT a.window_id, a.hour, coalesce(w.plays, 0) AS plays FROM (SELECT window_id, range AS hour FROM (SELECT DISTINCT window_id FROM w), range(24)) a LEFT JOIN w ON w.window_id = a.window_id AND w.hour = a.hour)"
_NUMBER = lambda x: f"format('{{:,}}', CAST({x} AS BIGINT))"


def long_history(s: SparkSession, d: str) -> DataFrame:
    k, who = F.ascii("o_orderpriority"), F.col("o_custkey").cast("string")
    track = F.concat("o_orderpriority", who)
    album = F.concat(who, F.lit("/"), (k % 3).cast("string"), F.when(k % 2 == 1, " (Remastered)").otherwise(""))
    return table(s, d, "orders").select(F.col("o_orderdate").cast("timestamp_ntz").alias("ts"), who.alias("artist_name"), track.alias("track_id"), F.concat(F.lit("Song "), track).alias("track_name"), album.alias("album_name"), F.round("o_totalprice").cast("long").alias("ms_played"), F.when(F.col("o_orderstatus") == "O", "fwdbtn").otherwise("trackdone").alias("reason_end"))


def releases(s: SparkSession, d: str) -> DataFrame:
    k, c = F.ascii("o_orderpriority"), F.col("o_custkey")
    key = F.concat(c.cast("string"), F.lit("|"), c.cast("string"), F.lit("/"), (k % 3).cast("string"))
    return table(s, d, "orders").select(key.alias("album_key"), F.when(c % 5 != 0, 1950 + (c * 7 + k) % 60).alias("release_year")).distinct()


def clustered(s: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    c = F.col("o_custkey")
    own = table(s, d, "orders").select(F.concat("o_orderpriority", c.cast("string")).alias("track_id"), (c % 6).alias("cluster"), (c % 4 != 0).alias("measured")).distinct()
    return own, s.range(6).select(F.col("id").alias("cluster"), F.concat(F.lit("Vibe "), F.col("id").cast("string")).alias("name"))


@query("rpt4_window_totals", f"WITH {_TRACKS} SELECT window_id, CAST(SUM(plays) AS BIGINT) AS plays, SUM(ms) / 3.6e6 AS hours, COUNT(*) AS tracks, COUNT(DISTINCT artist) AS artists, MIN(first_played) AS first_played, MAX(last_played) AS last_played FROM t GROUP BY 1", "hours")
def _(s, d):
    return cards.totals(cards.window_tracks(long_history(s, d), ZONE))


@query("rpt5_window_tops", f"WITH {_TOPS} SELECT window_id, card, place, label, plays, label || ' (' || {_NUMBER('plays')} || ' plays)' AS evidence FROM tops")
def _(s, d):
    return cards.tops(cards.window_tracks(long_history(s, d), ZONE))


@query("rpt7_window_hours", f"WITH {_PLAYS}, {_HOURS} SELECT * FROM hours", longs="hour")
def _(s, d):
    return cards.time_of_day(long_history(s, d), ZONE)


@query("rpt9_window_ages", f"WITH {_TRACKS}, {_AGES} SELECT * FROM ages", "old_share")
def _(s, d):
    return cards.listening_age(cards.window_tracks(long_history(s, d), ZONE), releases(s, d))


@query("rpt9_window_decades", f"WITH {_TRACKS}, {_DECADES} SELECT window_id, decade, plays, share, place, decade || 's: ' || CAST(ROUND(100 * share) AS BIGINT) || '% (' || {_NUMBER('plays')} || ' plays)' AS evidence FROM decades", "share", "decade")
def _(s, d):
    return cards.decades(cards.window_tracks(long_history(s, d), ZONE), releases(s, d))


@query("rpt10_window_clusters", f"WITH {_TRACKS}, {_CLUSTERS} SELECT window_id, cluster, name, plays, share, tracks, artists, place, name || ': ' || CAST(ROUND(100 * share) AS BIGINT) || '% of plays (' || two || ')' AS evidence, 'Tier A · all ' || {_NUMBER('all_tracks')} || ' tracks · ' || CAST(ROUND(100.0 * all_measured / all_tracks) AS BIGINT) || '% with measured audio, the rest predicted features only' AS coverage FROM clusters", "share")
def _(s, d):
    return cards.taste_clusters(cards.window_tracks(long_history(s, d), ZONE), *clustered(s, d))


@query("rpt17_window_coverage", f"""WITH {_TRACKS}, {_AGES}, c AS (SELECT window_id, 'Tier A · all ' || {_NUMBER('COUNT(*)')} || ' tracks · ' || CAST(ROUND(100.0 * COUNT(*) FILTER (measured) / COUNT(*)) AS BIGINT) || '% with measured audio, the rest predicted features only' AS a FROM t GROUP BY 1)
    SELECT window_id, a AS tier_a, coverage AS tier_b, 'Tier C · ' || {_NUMBER('tracks_used')} || ' of ' || {_NUMBER('tracks_of')} || ' tracks' AS tier_c FROM ages JOIN c USING (window_id)""")
def _(s, d):
    """The notes of all three tiers, for every window."""
    tracks = cards.window_tracks(long_history(s, d), ZONE)
    age = cards.listening_age(tracks, releases(s, d)).select("window_id", F.col("coverage").alias("tier_b"), cards.coverage_note("C", "tracks_used", "tracks_of").alias("tier_c"))
    vibe = cards.taste_clusters(tracks, *clustered(s, d)).groupBy("window_id").agg(F.first("coverage").alias("tier_a"))
    return age.join(vibe, "window_id").select("window_id", "tier_a", "tier_b", "tier_c")


_CARDS = f"""{_TOPS}, {_AGES}, {_DECADES}, {_CLUSTERS}, {_HOURS}, report AS (
    SELECT window_id, 1 AS card_no, 'total_hours' AS card, 1 AS place, {_NUMBER('SUM(plays)')} || ' plays of ' || {_NUMBER('COUNT(*)')} || ' tracks' AS label, SUM(ms) / 3.6e6 AS value FROM t GROUP BY 1
    UNION ALL SELECT window_id, CASE card WHEN 'top_artists' THEN 2 WHEN 'top_tracks' THEN 3 ELSE 4 END, card, place, label, plays FROM tops
    UNION ALL SELECT window_id, 5, 'time_of_day', hour + 1, CAST(hour AS VARCHAR), plays FROM hours
    UNION ALL SELECT window_id, 6, 'skip_offenders', ROW_NUMBER() OVER (PARTITION BY window_id ORDER BY skips / plays DESC, plays DESC, track_id) AS place, name, skips / plays FROM t WHERE plays >= 5 AND skips / plays >= 0.3 QUALIFY place <= 5
    UNION ALL SELECT window_id, 7, 'listening_age', 1, oldest, year FROM ages
    UNION ALL SELECT window_id, 8, 'decade_histogram', place, decade || 's', share FROM decades
    UNION ALL SELECT window_id, 9, 'taste_clusters', place, name, share FROM clusters)"""


@query("rpt16_visitor_cards", f"WITH {_CARDS} SELECT * FROM report", "value", "card_no place")
def _(s, d):
    """A visitor's own history, in the visitor's zone: every card of all time and of each year."""
    return cards.report(long_history(s, d), ZONE, releases(s, d), *clustered(s, d))


def _written(s: SparkSession, d: str) -> str:
    path = scratch(s)
    reports.write(cards.report(long_history(s, d), ZONE, releases(s, d), *clustered(s, d)), path)
    return path


@query("src16_window_reports", f"WITH {_CARDS} SELECT * FROM report", "value", "card_no place")
def _(s, d):
    """The reports of all windows, written as JSON documents and read back."""
    return reports.card_rows(reports.read(s, _written(s, d)))


@query("src16_report_index", f"WITH {_CARDS} SELECT window_id, COUNT(DISTINCT card) AS cards, COUNT(*) AS rows FROM report GROUP BY 1")
def _(s, d):
    return reports.index(s, _written(s, d))


_SHOWN = "rtrim(rtrim(format('{:,.3f}', CAST(value AS DOUBLE)), '0'), '.')"
_MARKED = "replace(replace(replace(replace(label, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '\"', '&quot;')"


@query("src17_window_renderings", f"""WITH {_CARDS}, per_card AS (SELECT window_id, card_no, card, string_agg('| ' || place || ' | ' || replace(label, '|', '\\|') || ' | ' || {_SHOWN} || ' |', chr(10) ORDER BY place) AS lines,
    string_agg('<tr><td>' || place || '</td><td>' || {_MARKED} || '</td><td>' || {_SHOWN} || '</td></tr>', '' ORDER BY place) AS cells FROM report GROUP BY ALL)
    SELECT window_id, '# Report: ' || CASE window_id WHEN 'all' THEN 'all time' ELSE window_id END || chr(10) || string_agg(chr(10) || '## ' || card || chr(10) || chr(10) || '| place | what | value |' || chr(10) || '| --- | --- | --- |' || chr(10) || lines, chr(10) ORDER BY card_no) || chr(10) AS markdown,
    '<!doctype html><title>' || replace('Report: X</title><h1>Report: X</h1>', 'X', CASE window_id WHEN 'all' THEN 'all time' ELSE window_id END) || string_agg('<h2>' || card || '</h2><table>' || cells || '</table>', '' ORDER BY card_no) AS html FROM per_card GROUP BY 1""")
def _(s, d):
    """The reports of all windows as Markdown and HTML."""
    return reports.renderings(reports.documents(cards.report(long_history(s, d), ZONE, releases(s, d), *clustered(s, d))))
