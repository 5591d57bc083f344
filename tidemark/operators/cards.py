"""Cards of a listening report for every window at once: all time and each local calendar year, as tables.

Plays are counted once, by local year and track; windows are grouping sets over these counts, and every card is an aggregate of
them. A visitor's report is the same cards over the visitor's own plays and zone.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import album_key
from ..sources.stored import written
from . import ranks
from .warehouse import local, skipped

ALL = "all"
#: Releases are old if they are so many years before the window's last play.
OLD_YEARS = 20
#: The order of cards.
ORDER = ("total_hours", "top_artists", "top_tracks", "top_albums", "time_of_day", "skip_offenders", "listening_age", "decade_histogram", "taste_clusters")


def _windows(df: DataFrame, keys: list[str], *aggregates: Column) -> DataFrame:
    """Aggregates by `keys` for each year and for all of them: window_id, keys and the aggregates. No year: all time only."""
    got = df.groupingSets([["year", *keys], keys], "year", *keys).agg(F.grouping("year").alias("_all"), *aggregates)
    got = got.where((F.col("_all") == 1) | F.col("year").isNotNull())
    return got.withColumn("window_id", F.when(F.col("_all") == 1, ALL).otherwise(F.col("year").cast("string"))).drop("_all", "year")


def window_tracks(plays: DataFrame, zone: str = "UTC") -> DataFrame:
    """window_id, track_id, name, artist, album, plays, ms, skips, first_played, last_played (local): a row for each track that
    was played in a window. Written, as every card reads it."""
    at = local("ts", zone)
    per = plays.where(F.col("track_id").isNotNull()).groupBy(F.year(at).alias("year"), "track_id").agg(
        F.min("track_name").alias("name"), F.min("artist_name").alias("artist"), F.min("album_name").alias("album"), F.count("*").alias("plays"), F.sum("ms_played").alias("ms"), F.sum(skipped()).cast("long").alias("skips"), F.min(at).alias("first_played"), F.max(at).alias("last_played")
    )
    own = _windows(per, ["track_id"], *[F.min(c).alias(c) for c in ("name", "artist", "album")], *[F.sum(c).alias(c) for c in ("plays", "ms", "skips")], F.min("first_played").alias("first_played"), F.max("last_played").alias("last_played"))
    return written(own)


def totals(tracks: DataFrame) -> DataFrame:
    """window_id, plays, hours, tracks, artists, first_played, last_played: the windows there are, with what they hold."""
    return tracks.groupBy("window_id").agg(F.sum("plays").alias("plays"), (F.sum("ms") / 3.6e6).alias("hours"), F.count("*").alias("tracks"), F.count_distinct("artist").alias("artists"), F.min("first_played").alias("first_played"), F.max("last_played").alias("last_played"))


def _placed(df: DataFrame, card: str, n: int, key: str, label: str) -> DataFrame:
    got = ranks.top_per(df, n, ["window_id"], [F.desc("plays"), key], "place")
    evidence = F.concat(F.col(label), F.lit(" ("), F.format_number("plays", 0), F.lit(" plays)"))
    return got.select("window_id", F.lit(card).alias("card"), "place", F.col(label).alias("label"), "plays", evidence.alias("evidence"))


def tops(tracks: DataFrame, n: int = 5) -> DataFrame:
    """window_id, card (top_artists, top_tracks or top_albums), place, label, plays, evidence. Editions of an album count together,
    under the names of its smallest track_id; equal plays go by artist, track_id or album key."""
    artists = tracks.where("artist is not null").groupBy("window_id", "artist").agg(F.sum("plays").alias("plays"))
    named = tracks.where("album is not null and album <> ''").withColumn("key", album_key("artist", "album"))
    albums = named.groupBy("window_id", "key").agg(F.min_by(F.concat_ws(" - ", "artist", "album"), "track_id").alias("title"), F.sum("plays").alias("plays"))
    cards = [_placed(artists, "top_artists", n, "artist", "artist"), _placed(tracks, "top_tracks", n, "track_id", "name"), _placed(albums, "top_albums", n, "key", "title")]
    return reduce(DataFrame.unionByName, cards)


def _dated(tracks: DataFrame, releases: DataFrame) -> DataFrame:
    years = releases.where("release_year is not null").groupBy("album_key").agg(F.min("release_year").alias("release_year"))
    return tracks.withColumn("album_key", album_key("artist", "album")).join(years, "album_key", "left")


def percent(share: Column) -> Column:
    return F.concat(F.round(100 * share).cast("long").cast("string"), F.lit("%"))


def coverage_note(tier: str, used: str, of: str, plays_used: str | None = None, plays_of: str | None = None, measured: str | None = None) -> Column:
    """What a card rests on: with plays the share of plays, with measured tracks their share, else the number of tracks."""
    n = lambda c: F.format_number(c, 0)
    head = F.lit(f"Tier {tier} · ")
    if plays_of:
        return F.concat(head, F.lit("covers "), percent(F.col(plays_used) / F.col(plays_of)), F.lit(" of plays"))
    if measured:
        return F.concat(head, F.lit("all "), n(used), F.lit(" tracks · "), percent(F.col(measured) / F.col(used)), F.lit(" with measured audio, the rest predicted features only"))
    return F.concat(head, n(used), F.lit(" of "), n(of), F.lit(" tracks"))


def listening_age(tracks: DataFrame, releases: DataFrame) -> DataFrame:
    """Of each window with dated plays: the median year of release by plays, the oldest album, the share of plays of old releases,
    and what was dated. `releases` has album_key and release_year; of equally old albums the most played one's track counts."""
    own = _dated(tracks, releases)
    known = F.col("release_year").isNotNull()
    last = own.groupBy("window_id").agg(F.year(F.max("last_played")).alias("last"), F.count("*").alias("tracks_of"), F.sum("plays").alias("plays_of"), F.count("release_year").alias("tracks_used"), F.coalesce(F.sum(F.when(known, F.col("plays"))), F.lit(0)).alias("plays_used"))
    # years of a window are few, so the weighted median and the old share are taken of a histogram
    years = own.where(known).groupBy("window_id", "release_year").agg(F.sum("plays").alias("plays"), F.min(F.struct((-F.col("plays")).alias("p"), "track_id", "artist", "album")).alias("first"))
    got = years.join(last, "window_id").groupBy("window_id").agg(
        F.percentile("release_year", 0.5, F.col("plays")).cast("long").alias("year"), F.min_by("first", "release_year").alias("o"), F.min("release_year").alias("oldest_year"),
        (F.sum(F.when(F.col("release_year") < F.col("last") - OLD_YEARS, F.col("plays")).otherwise(0)) / F.sum("plays")).alias("old_share"), *[F.first(c).alias(c) for c in ("tracks_used", "tracks_of", "plays_used", "plays_of")],
    )
    oldest = F.concat(F.lit("oldest: "), F.col("o.artist"), F.lit(', "'), F.col("o.album"), F.lit('" ('), F.col("oldest_year").cast("string"), F.lit(")"))
    return got.select("window_id", "year", oldest.alias("oldest"), "old_share", "tracks_used", "tracks_of", "plays_used", "plays_of", coverage_note("B", "tracks_used", "tracks_of", "plays_used", "plays_of").alias("coverage"))


def decades(tracks: DataFrame, releases: DataFrame) -> DataFrame:
    """window_id, decade, plays, share, place (by plays, then the earlier decade), evidence."""
    own = _dated(tracks, releases).where("release_year is not null").groupBy("window_id", (F.floor(F.col("release_year") / 10) * 10).alias("decade")).agg(F.sum("plays").alias("plays"))
    own = own.join(own.groupBy("window_id").agg(F.sum("plays").alias("total")), "window_id").withColumn("share", F.col("plays") / F.col("total"))
    own = ranks.top_per(own, 1 << 30, ["window_id"], [F.desc("plays"), "decade"], "place")
    evidence = F.concat(F.col("decade").cast("string"), F.lit("s: "), percent(F.col("share")), F.lit(" ("), F.format_number("plays", 0), F.lit(" plays)"))
    return own.select("window_id", "decade", "plays", "share", "place", evidence.alias("evidence"))


def taste_clusters(tracks: DataFrame, clusters: DataFrame, names: DataFrame, artists: int = 3) -> DataFrame:
    """window_id, cluster, name, plays, share, tracks, artists (the most played), place, evidence, coverage.

    `clusters` has track_id, cluster and measured; `names` has cluster and name. Tracks without a cluster aren't in the card.
    """
    own = tracks.join(clusters.select("track_id", "cluster", "measured"), "track_id")
    per = own.groupBy("window_id", "cluster").agg(F.sum("plays").alias("plays"), F.count("*").alias("tracks"), F.count_if("measured").alias("_measured"))
    whole = per.groupBy("window_id").agg(F.sum("plays").alias("_plays"), F.sum("tracks").alias("_tracks"), F.sum("_measured").alias("_all_measured"))
    top = ranks.top_per(own.where("artist is not null").groupBy("window_id", "cluster", "artist").agg(F.sum("plays").alias("n")), artists, ["window_id", "cluster"], [F.desc("n"), "artist"], "at")
    top = top.groupBy("window_id", "cluster").agg(F.transform(F.array_sort(F.collect_list(F.struct("at", "artist"))), lambda x: x["artist"]).alias("artists"))
    got = per.join(whole, "window_id").join(top, ["window_id", "cluster"], "left").join(F.broadcast(names), "cluster", "left").withColumn("share", F.col("plays") / F.col("_plays"))
    got = ranks.top_per(got, 1 << 30, ["window_id"], [F.desc("plays"), "cluster"], "place")
    evidence = F.concat("name", F.lit(": "), percent(F.col("share")), F.lit(" of plays ("), F.array_join(F.slice("artists", 1, 2), ", "), F.lit(")"))
    return got.select("window_id", "cluster", "name", "plays", "share", "tracks", F.array_join("artists", ", ").alias("artists"), "place", evidence.alias("evidence"), coverage_note("A", "_tracks", "_tracks", measured="_all_measured").alias("coverage"))


def time_of_day(plays: DataFrame, zone: str = "UTC") -> DataFrame:
    """window_id, hour, plays: all 24 local hours of every window."""
    at = local("ts", zone)
    per = plays.where("track_id is not null and ts is not null").groupBy(F.year(at).alias("year"), F.hour(at).alias("hour")).agg(F.count("*").alias("plays"))
    got = _windows(per, ["hour"], F.sum("plays").alias("plays"))
    every = got.select("window_id").distinct().select("window_id", F.explode(F.sequence(F.lit(0), F.lit(23))).alias("hour"))
    return every.join(got, ["window_id", "hour"], "left").select("window_id", "hour", F.coalesce("plays", F.lit(0)).alias("plays"))


def skip_offenders(tracks: DataFrame, n: int = 5, min_plays: int = 5, min_rate: float = 0.3) -> DataFrame:
    own = tracks.withColumn("rate", F.col("skips") / F.col("plays")).where((F.col("plays") >= min_plays) & (F.col("rate") >= min_rate))
    return ranks.top_per(own, n, ["window_id"], [F.desc("rate"), F.desc("plays"), "track_id"], "place").select("window_id", "place", "name", "rate", "plays")


def report(plays: DataFrame, zone: str, releases: DataFrame, clusters: DataFrame, names: DataFrame, n: int = 5) -> DataFrame:
    """All cards of all windows in one table: window_id, card_no (from 1, in ORDER), card, place, label, value."""
    tracks = window_tracks(plays, zone)
    row = lambda df, card, place, label, value: df.select("window_id", F.lit(ORDER.index(card) + 1).cast("long").alias("card_no"), F.lit(card).alias("card"), F.col(place).cast("long").alias("place") if isinstance(place, str) else F.lit(place).cast("long").alias("place"), label.alias("label"), value.cast("double").alias("value"))
    age, top = listening_age(tracks, releases), tops(tracks, n)
    cards = [
        row(totals(tracks), "total_hours", 1, F.concat(F.format_number("plays", 0), F.lit(" plays of "), F.format_number("tracks", 0), F.lit(" tracks")), F.col("hours")),
        *[row(top.where(F.col("card") == card), card, "place", F.col("label"), F.col("plays")) for card in ("top_artists", "top_tracks", "top_albums")],
        row(time_of_day(plays, zone).withColumn("h", F.col("hour") + 1), "time_of_day", "h", F.col("hour").cast("string"), F.col("plays")),
        row(skip_offenders(tracks, n), "skip_offenders", "place", F.col("name"), F.col("rate")),
        row(age, "listening_age", 1, F.col("oldest"), F.col("year")),
        row(decades(tracks, releases), "decade_histogram", "place", F.concat(F.col("decade").cast("string"), F.lit("s")), F.col("share")),
        row(taste_clusters(tracks, clusters, names), "taste_clusters", "place", F.col("name"), F.col("share")),
    ]
    return reduce(DataFrame.unionByName, cards)
