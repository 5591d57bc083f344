"""The named questions about listening."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import album_key
from . import ranks
from .warehouse import between, local, play_rows

GRAINS = ("month", "quarter", "year")


def top_artists(plays: DataFrame, start: str | None = None, end: str | None = None, limit: int = 20) -> DataFrame:
    rows = between(play_rows(plays), start, end, "t")
    got = rows.groupBy("artist").agg(F.sum("play_count").alias("play_count"), (F.sum("ms_played") / 3.6e6).alias("total_hours"))
    return ranks.top(got, limit, F.desc("play_count"), "artist")


def top_tracks(tracks: DataFrame, limit: int = 20) -> DataFrame:
    return ranks.top(tracks.select("track_id", "name", "artist", "album", "play_count"), limit, F.desc("play_count"), "track_id")


def top_albums(tracks: DataFrame, limit: int = 20) -> DataFrame:
    """Editions of one album count together; names are those of its smallest track_id."""
    own = tracks.where(F.col("album").isNotNull() & (F.col("album") != "")).withColumn("key", album_key("artist", "album"))
    got = own.groupBy("key").agg(F.min_by("artist", "track_id").alias("artist"), F.min_by("album", "track_id").alias("album"), F.sum("play_count").alias("play_count"), (F.sum("total_ms") / 3.6e6).alias("total_hours"))
    return ranks.top(got, limit, F.desc("play_count"), "key").drop("key")


def summary(plays: DataFrame) -> DataFrame:
    return plays.agg(
        F.min("ts").alias("earliest_play"), F.max("ts").alias("latest_play"), F.count("*").alias("total_plays"), F.count_distinct("track_id").alias("unique_tracks"), F.count_distinct("artist_name").alias("unique_artists"), (F.sum("ms_played") / 3.6e6).alias("total_hours"),
    )


def clock(plays: DataFrame) -> DataFrame:
    return play_rows(plays).groupBy("hour_utc", "dow").agg(F.sum("play_count").alias("play_count"))


def dense_clock(plays: DataFrame, zone: str) -> DataFrame:
    """All 168 hours of a week in `zone`, zeros included, Monday first."""
    own = plays.select(F.weekday(local("ts", zone)).alias("dow"), F.hour(local("ts", zone)).alias("hour")).groupBy("dow", "hour").agg(F.count("*").alias("n"))
    spine = plays.sparkSession.range(168).select((F.col("id") / 24).cast("int").alias("dow"), (F.col("id") % 24).cast("int").alias("hour"))
    return spine.join(own, ["dow", "hour"], "left").select("dow", "hour", F.coalesce("n", F.lit(0)).alias("play_count"))


def time_of_day(plays: DataFrame, zone: str) -> DataFrame:
    """Plays of each local hour, zeros included, and whether it is the peak (the earliest of equal ones)."""
    own = plays.groupBy(F.hour(local("ts", zone)).alias("hour")).agg(F.count("*").alias("n"))
    full = plays.sparkSession.range(24).select(F.col("id").cast("int").alias("hour")).join(F.broadcast(own), "hour", "left").select("hour", F.coalesce("n", F.lit(0)).alias("play_count"))
    return full.withColumn("is_peak", F.row_number().over(Window.orderBy(F.desc("play_count"), "hour")) == 1)


def hours_by(plays: DataFrame, by: str, zone: str) -> DataFrame:
    """`time_of_day` for each value of `by`, in one pass."""
    own = plays.groupBy(by, F.hour(local("ts", zone)).alias("hour")).agg(F.count("*").alias("n"))
    spine = own.select(by).distinct().select(by, F.explode(F.sequence(F.lit(0), F.lit(23))).alias("hour"))
    full = spine.join(own, [by, "hour"], "left").select(by, "hour", F.coalesce("n", F.lit(0)).alias("play_count"))
    return full.withColumn("is_peak", F.row_number().over(Window.partitionBy(by).orderBy(F.desc("play_count"), "hour")) == 1)


def skip_offenders(tracks: DataFrame, min_plays: int = 5, min_rate: float = 0.3) -> DataFrame:
    return tracks.where((F.col("play_count") >= min_plays) & (F.col("skip_rate") >= min_rate)).select("track_id", "name", "artist", "play_count", "skip_rate").orderBy(F.desc("skip_rate"), F.desc("play_count"), "track_id")


def rediscovery(tracks: DataFrame, dormant_months: int = 6, min_past_plays: int = 10) -> DataFrame:
    last = tracks.agg((F.max("last_played") - F.make_ym_interval(F.lit(0), F.lit(dormant_months))).alias("cut"))
    got = tracks.join(F.broadcast(last), F.col("last_played") < F.col("cut")).where(F.col("play_count") >= min_past_plays)
    return got.select("track_id", "name", "artist", "play_count", "last_played").orderBy(F.desc("play_count"), "track_id")


def search(tracks: DataFrame, text: str, limit: int = 20) -> DataFrame:
    """% and _ in the text are wildcards."""
    like = f"%{text.lower()}%"
    own = tracks.where(F.lower("name").like(like) | F.lower("artist").like(like))
    return ranks.top(own.select("track_id", "name", "artist", "album", "play_count"), limit, F.desc("play_count"), "track_id")


def track_detail(tracks: DataFrame, id_or_name: str) -> DataFrame:
    """The track of that id, else the most played whose name holds the text."""
    exact = F.col("track_id") == id_or_name
    return tracks.where(exact | F.lower("name").like(f"%{id_or_name.lower()}%")).orderBy(F.desc(exact), F.desc("play_count"), "track_id").limit(1)


def tracks_by_ids(tracks: DataFrame, ids: list[str]) -> DataFrame:
    return tracks.where(F.col("track_id").isin(ids))


def recent_plays(plays: DataFrame, limit: int = 50) -> DataFrame:
    return plays.where(F.col("track_id").isNotNull()).select("ts", "track_id", "track_name", "artist_name").orderBy(F.desc("ts"), "track_id").limit(limit)


def artist_sprint(months: DataFrame, top_n: int = 5) -> DataFrame:
    """Running plays by month of every artist who was among a month's top n."""
    racers = ranks.top_per(months, top_n, ["month"], [F.desc("play_count"), "artist"]).select("artist").distinct()
    running = F.sum("play_count").over(Window.partitionBy("artist").orderBy("month").rowsBetween(Window.unboundedPreceding, 0))
    return months.join(racers, "artist", "left_semi").select("artist", "month", "play_count", running.alias("cumulative_plays"))


def sprint_matrix(months: DataFrame, top_n: int = 5) -> DataFrame:
    """The same with a row for every month: totals carry forward, from 0."""
    own = artist_sprint(months, top_n)
    spine = ranks.month_spine(months).crossJoin(own.select("artist").distinct())
    full = spine.join(own.select("artist", "month", "cumulative_plays"), ["artist", "month"], "left")
    return ranks.forward_fill(full, "cumulative_plays", ["artist"], ["month"])


def binged_then_abandoned(months: DataFrame, min_plays: int = 15, window_months: int = 3, most_after: int = 1) -> DataFrame:
    """Months with many plays of an artist and next to none in the months after. Rows without an artist are left out."""
    m = months.where(F.col("artist").isNotNull()).withColumn("i", F.year("month") * 12 + F.month("month"))
    after = F.coalesce(F.sum("play_count").over(Window.partitionBy("artist").orderBy("i").rangeBetween(1, window_months)), F.lit(0))
    return m.withColumn("followup_plays", after).where((F.col("play_count") >= min_plays) & (F.col("followup_plays") <= most_after)).select("artist", F.col("month").alias("spike_month"), F.col("play_count").alias("spike_plays"), "followup_plays")


def taste_drift(plays: DataFrame, grain: str = "quarter", top_n: int = 5) -> DataFrame:
    if grain not in GRAINS:
        raise ValueError(f"grain must be one of {', '.join(GRAINS)}")
    per = play_rows(plays).groupBy(F.date_trunc(grain, "t").alias("period"), "artist").agg(F.sum("play_count").alias("play_count"))
    return ranks.top_per(per, top_n, ["period"], [F.desc("play_count"), "artist"]).select("period", "rank", "artist", "play_count")


def drift_shares(plays: DataFrame, grain: str = "quarter", series: int = 5) -> DataFrame:
    """Share of each period of the leading artists, and of all others. Period leaders come first, by their plays in all."""
    per = play_rows(plays).groupBy(F.date_trunc(grain, "t").alias("period"), "artist").agg(F.sum("play_count").alias("play_count"))
    leads = ranks.top_per(per, 1, ["period"], [F.desc("play_count"), "artist"]).select("artist").distinct().withColumn("leads", F.lit(1))
    chosen = per.groupBy("artist").agg(F.sum("play_count").alias("n")).join(leads, "artist", "left").orderBy(F.desc(F.coalesce("leads", F.lit(0))), F.desc("n"), "artist").limit(series).select("artist", F.lit(True).alias("chosen"))
    named = per.join(F.broadcast(chosen), "artist", "left").groupBy("period", F.when(F.col("chosen"), F.col("artist")).otherwise("other").alias("series")).agg(F.sum("play_count").alias("n"))
    return named.select("period", "series", (F.col("n") / F.sum("n").over(Window.partitionBy("period"))).alias("share"))


def hourly_recent(hourly: DataFrame, limit: int = 50) -> DataFrame:
    return hourly.orderBy(F.desc("date"), F.desc("hour_utc"), "track_id").limit(limit)


def chart_frame(matrix: DataFrame, at: float, n: int) -> DataFrame:
    """A frame of the chart race `at` months after the first: values between two months, the largest first, no zeros."""
    first = int(at)
    order = Window.partitionBy("artist").orderBy("month")
    pair = matrix.withColumn("i", F.row_number().over(order) - 1).withColumn("next", F.lead("cumulative_plays").over(order))
    value = F.col("cumulative_plays") + (F.coalesce("next", "cumulative_plays") - F.col("cumulative_plays")) * (at - first)
    return pair.where(F.col("i") == first).select("artist", value.cast("double").alias("value")).where("value > 0").orderBy(F.desc("value"), "artist").limit(n)


def rate_predictor(plays: DataFrame, target: str, train: Column) -> DataFrame:
    """Mean target of the training rows by track, else by artist, else of all, for the other rows."""
    a, b = plays.where(train), plays.where(~train)
    by = lambda k, n: a.groupBy(k).agg(F.avg(target).alias(n))
    got = b.join(by("track_id", "_t"), "track_id", "left").join(by("artist_name", "_a"), "artist_name", "left").crossJoin(F.broadcast(a.agg(F.avg(target).alias("_g"))))
    return got.withColumn("score", F.coalesce("_t", "_a", "_g")).drop("_t", "_a", "_g")
