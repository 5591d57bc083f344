"""Warehouse tables derived from plays."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: A longer gap than this begins a session.
SESSION_GAP = "INTERVAL 30 MINUTES"


def skipped(reason: str = "reason_end") -> Column:
    """1 for plays that ended with the forward button, else 0."""
    return F.when(F.col(reason) == "fwdbtn", 1.0).otherwise(0.0)


def tracks(plays: DataFrame) -> DataFrame:
    """One row for each track; of several names the smallest."""
    return plays.groupBy("track_id").agg(
        F.min("track_name").alias("name"), F.min("artist_name").alias("artist"), F.min("album_name").alias("album"), F.min("ts").alias("first_played"), F.max("ts").alias("last_played"), F.count("*").alias("play_count"),
        F.sum("ms_played").alias("total_ms"), F.avg(skipped()).alias("skip_rate"), F.avg("completion").alias("mean_completion"), F.sum("verdict").alias("net_verdict"),
    )


def artists(plays: DataFrame) -> DataFrame:
    return plays.groupBy(F.col("artist_name").alias("artist")).agg(
        F.count_distinct("track_id").alias("track_count"), F.count("*").alias("play_count"), (F.sum("ms_played") / 3.6e6).alias("total_hours"), F.min("ts").alias("first_played"), F.max("ts").alias("last_played"), F.avg(skipped()).alias("skip_rate"),
    )


_NO_DAY = "DATE'0001-01-01'"


def _by_days(plays: DataFrame, by: tuple[str, ...], order: tuple[str, ...], gap: str) -> DataFrame:
    """Adds `gap` and `session`, from 1 within each listener (`by`); `order` begins with ts. Rows without a time come first.

    A listener is cut into days, so that one who plays very much isn't one task: gaps and starts are found within each day, then
    days are put together by comparing each one's first time with the last of the day before and adding up the starts. What
    goes over a whole listener has one row a day.
    """
    if order[0] != "ts":
        raise ValueError("plays must be in the order of ts")
    w = Window.partitionBy(*by, "_day").orderBy(*order)
    far = lambda g: F.when(g.isNull() | (g > F.expr(gap)), 1).otherwise(0)
    own = plays.withColumn("_day", F.coalesce(F.col("ts").cast("date"), F.expr(_NO_DAY))).withColumn("_k", F.row_number().over(w)).withColumn("gap", F.col("ts") - F.lag("ts").over(w))
    own = own.withColumn("_start", F.when(F.col("_k") == 1, 0).otherwise(far(F.col("gap")))).withColumn("_starts", F.sum("_start").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    days = own.groupBy(*by, "_day").agg(F.min("ts").alias("_first"), F.max("ts").alias("_last"), F.sum("_start").alias("_n"))
    over = Window.partitionBy(*by).orderBy("_day")
    days = days.withColumn("_before", F.lag("_last").over(over)).withColumn("_opens", far(F.col("_first") - F.col("_before")))
    days = days.withColumn("_base", F.sum(F.col("_opens") + F.col("_n")).over(over.rowsBetween(Window.unboundedPreceding, 0)) - F.col("_n"))
    days = days.select(*[F.col(c).alias(f"_d_{c}") for c in (*by, "_day")], "_before", "_base")
    same = [F.col(c).eqNullSafe(F.col(f"_d_{c}")) for c in (*by, "_day")]
    got = own.join(days, same)
    got = got.withColumn("gap", F.when(F.col("_k") == 1, F.col("ts") - F.col("_before")).otherwise(F.col("gap"))).withColumn("session", F.col("_base") + F.col("_starts"))
    return got.drop("_day", "_k", "_start", "_starts", "_before", "_base", *[f"_d_{c}" for c in (*by, "_day")])


def with_gap(plays: DataFrame, by: tuple[str, ...], order: tuple[str, ...]) -> DataFrame:
    """Adds `gap`, the time since the listener's play before; null for the first."""
    return _by_days(plays, by, order, SESSION_GAP).drop("session")


def with_session(plays: DataFrame, by: tuple[str, ...], order: tuple[str, ...] = ("ts",), gap: str = SESSION_GAP) -> DataFrame:
    """Adds `gap` and `session`: a play that follows after more than `gap`, or has no time, begins one."""
    return _by_days(plays, by, order, gap)


def sessions(plays: DataFrame, by: tuple[str, ...], order: tuple[str, ...] = ("ts",)) -> DataFrame:
    """One row for each session. Its dominant artist has the most plays in it, then the smallest name."""
    own = with_session(plays, by, order)
    key = [*by, "session"]
    per_artist = own.groupBy(*key, F.col("artist_name").alias("a")).agg(F.count("*").alias("n"), F.min("ts").alias("s"), F.max("ts").alias("e"), F.sum(F.when(F.col("reason_end") == "fwdbtn", 1).otherwise(0)).alias("k"), F.sum("ms_played").alias("ms"))
    return per_artist.groupBy(*key).agg(
        F.min("s").alias("started_at"), F.max("e").alias("ended_at"), F.sum("n").alias("n_tracks"), F.sum("k").alias("n_skips"), F.sum("ms").alias("total_ms"), F.min_by("a", F.struct(-F.col("n"), F.col("a"))).alias("dominant_artist"),
    )


def artist_months(plays: DataFrame) -> DataFrame:
    return plays.groupBy(F.col("artist_name").alias("artist"), F.date_trunc("month", "ts").alias("month")).agg(F.count("*").alias("play_count"), F.sum("ms_played").alias("total_ms"))


def plays_hourly(plays: DataFrame) -> DataFrame:
    """The coarse grain: no timestamps, one row for each hour and track."""
    return plays.groupBy(F.col("ts").cast("date").alias("date"), "hour_utc", "dow", F.col("artist_name").alias("artist"), "track_id").agg(F.count("*").alias("play_count"), F.sum("ms_played").alias("ms_played"), F.sum(skipped().cast("int")).alias("skips"))


def day_grain(df: DataFrame, *columns: str) -> DataFrame:
    """Timestamps cut to dates."""
    return df.withColumns({c: F.col(c).cast("date") for c in columns})


def play_rows(plays: DataFrame) -> DataFrame:
    """One shape for both grains: t, hour_utc, dow, artist, track_id, play_count, ms_played."""
    if "play_count" in plays.columns:
        return plays.select(F.col("date").cast("timestamp_ntz").alias("t"), "hour_utc", "dow", "artist", "track_id", "play_count", "ms_played")
    return plays.select(F.col("ts").alias("t"), "hour_utc", "dow", F.col("artist_name").alias("artist"), "track_id", F.lit(1).cast("long").alias("play_count"), "ms_played")


def between(df: DataFrame, start: str | None = None, end: str | None = None, t: str = "ts") -> DataFrame:
    """Rows of a half-open range; a bound that isn't given leaves no predicate, so the others reach the scan."""
    if start:
        df = df.where(F.col(t) >= F.lit(start).cast("timestamp_ntz"))
    if end:
        df = df.where(F.col(t) < F.lit(end).cast("timestamp_ntz"))
    return df


def local(t: str | Column, zone: str) -> Column:
    """A UTC time without zone as local time in `zone`."""
    return F.convert_timezone(F.lit("UTC"), F.lit(zone), F.col(t) if isinstance(t, str) else t)


def in_window(df: DataFrame, start: str | None, end: str | None, zone: str, t: str = "ts") -> DataFrame:
    """Rows whose local date in `zone` lies in [start, end). The bounds are converted, not the column, so they can be pushed."""
    bound = lambda d: F.convert_timezone(F.lit(zone), F.lit("UTC"), F.lit(d).cast("timestamp_ntz"))
    if start:
        df = df.where(F.col(t) >= bound(start))
    if end:
        df = df.where(F.col(t) < bound(end))
    return df


def by_window(plays: DataFrame, zone: str) -> DataFrame:
    """Each play once for every report window it is in: all time, and its local year. One pass serves all windows."""
    return plays.withColumn("window_id", F.explode(F.array(F.lit("all"), F.year(local("ts", zone)).cast("string"))))
