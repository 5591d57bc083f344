"""From raw play records to plays: completion, verdict and calendar parts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Fixed values of the verdict rules.
SKIP_BELOW, ABANDON_BELOW = 0.8, 0.3
DROPPED = ("ip_addr", "offline_timestamp", "incognito_mode")
RENAMED = {"master_metadata_track_name": "track_name", "master_metadata_album_artist_name": "artist_name", "master_metadata_album_album_name": "album_name"}
URI, URI_PREFIX = "spotify_track_uri", "spotify:track:"


def completion(ms: str = "ms_played", key: str = "track_id") -> Column:
    """Share of the longest play of the track, at most 1; 0 where that is unknown. It looks at the whole history."""
    longest = F.max(ms).over(Window.partitionBy(key))
    return F.least(F.coalesce(F.try_divide(F.col(ms).cast("double"), longest.cast("double")), F.lit(0.0)), F.lit(1.0))


def verdict(reason: str = "reason_end", share: str = "completion") -> Column:
    r, c = F.col(reason), F.col(share)
    return F.when(r.isin("trackdone", "backbtn"), 1).when((r == "fwdbtn") & (c < SKIP_BELOW), -1).when((r == "endplay") & (c < ABANDON_BELOW), -1).otherwise(0)


def with_verdict(plays: DataFrame) -> DataFrame:
    return plays.withColumn("completion", completion()).withColumn("verdict", verdict().cast("byte"))


def with_calendar(plays: DataFrame, ts: str = "ts") -> DataFrame:
    """year, month, hour_utc and dow (Monday is 0)."""
    return plays.withColumns({"year": F.year(ts), "month": F.month(ts), "hour_utc": F.hour(ts), "dow": F.weekday(ts)})


def to_plays(raw: DataFrame) -> DataFrame:
    """Raw records as plays. Records without a track are dropped; columns that aren't there are not missed."""
    known = {k: v for k, v in RENAMED.items() if k in raw.columns}
    plays = raw.drop(*DROPPED).where(F.col(URI).isNotNull()).withColumnsRenamed(known)
    plays = plays.withColumn("ts", F.to_timestamp("ts")).withColumn("track_id", F.regexp_replace(URI, f"^{URI_PREFIX}", ""))
    return with_calendar(with_verdict(plays))


def ingest_summary(plays: DataFrame) -> DataFrame:
    """Rows, tracks and the number of each verdict."""
    n = lambda v: F.count_if(F.col("verdict") == v)
    return plays.agg(F.count("*").alias("row_count"), F.count_distinct("track_id").alias("unique_tracks"), n(1).alias("rewards"), n(-1).alias("punishments"), n(0).alias("neutral"))
