"""Plays made from other event tables, so that every play operator runs over them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.ingest import with_calendar, with_verdict

REASONS = {"purchase": "trackdone", "signup": "backbtn", "click": "fwdbtn", "view": "endplay"}
FLAGS = {"A": "trackdone", "N": "endplay", "R": "fwdbtn"}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _mapped(column: str, values: dict[str, str], other: str = "other") -> F.Column:
    out = F.lit(None)
    for k, v in values.items():
        out = F.when(F.col(column) == k, v).otherwise(out)
    return F.coalesce(out, F.lit(other))


def event_plays(events: DataFrame) -> DataFrame:
    """Events as plays: the user is the artist, with ten tracks and three albums each; odd events are of a reissue."""
    k, user = F.col("event_id"), F.col("user_id").cast("string")
    edition = F.when(k % 2 == 1, F.lit(" (Remastered)")).otherwise(F.lit(""))
    plays = events.select(
        "event_id", "ts", user.alias("artist_name"), F.concat(user, F.lit("-"), (k % 10).cast("string")).alias("track_id"), F.concat(F.lit("Song "), user, F.lit("-"), (k % 10).cast("string")).alias("track_name"),
        F.concat(user, F.lit("/"), (k % 3).cast("string"), edition).alias("album_name"), F.round(F.col("value") * 1000).cast("long").alias("ms_played"), _mapped("event_type", REASONS).alias("reason_end"),
    )
    return with_calendar(with_verdict(plays))


def order_plays(orders: DataFrame) -> DataFrame:
    """Orders as plays over several years: customers are artists, priorities their tracks."""
    who = F.col("o_custkey").cast("string")
    return orders.select(F.col("o_orderkey").alias("event_id"), F.col("o_orderdate").alias("ts"), who.alias("artist_name"), F.concat("o_orderpriority", who).alias("track_id"), F.round(F.col("o_totalprice")).cast("long").alias("ms_played"))


def line_plays(lineitem: DataFrame) -> DataFrame:
    """Line items as plays, for volume. They have no unique key."""
    return lineitem.select(
        F.col("l_shipdate").alias("ts"), F.col("l_suppkey").cast("string").alias("artist_name"), F.col("l_partkey").cast("string").alias("track_id"),
        (F.col("l_quantity") * 60000).cast("long").alias("ms_played"), _mapped("l_returnflag", FLAGS).alias("reason_end"),
    )
