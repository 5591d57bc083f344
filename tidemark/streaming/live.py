"""Structured Streaming twins of the batch operators."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

LATE = "1 hour"


def event_stream(spark: SparkSession, path: str, per_trigger: int = 1) -> DataFrame:
    """Events of Parquet files as they arrive; event times need a zone to carry a watermark."""
    schema = spark.read.parquet(path).schema
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", per_trigger).parquet(path)
    return stream.withColumn("ts", F.to_utc_timestamp(F.col("ts").cast("timestamp"), "UTC"))


def dashboard(stream: DataFrame) -> DataFrame:
    """Totals that are whole after every file (complete mode)."""
    return stream.groupBy("event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total"))


def sessions(stream: DataFrame, gap: str = "30 minutes") -> DataFrame:
    """Sessions of each user, emitted once the watermark has passed their end."""
    own = stream.withWatermark("ts", LATE).groupBy("user_id", F.session_window("ts", gap)).agg(F.count("*").alias("n"))
    return own.select("user_id", F.col("session_window.start").alias("started_at"), "n")


def sliding(stream: DataFrame, size: str = "2 hours", slide: str = "1 hour") -> DataFrame:
    """started_at, event_type, n, total of overlapping windows, each emitted once, when the watermark has passed its end.

    Repeated deliveries of an event count once. Rows that are later than LATE are dropped; `late_rows` says how many.
    """
    own = stream.withWatermark("ts", LATE).dropDuplicatesWithinWatermark(["event_id"])
    per = own.groupBy(F.window("ts", size, slide), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total"))
    return per.select(F.col("window.start").alias("started_at"), "event_type", "n", "total")


def followed(stream: DataFrame, first: str, then: str, within: str = "1 hour") -> DataFrame:
    """user_id, first_id, then_id: events of one kind with those of another by the same user that follow within an interval.

    Two streams with watermarks are joined on user and time, so each row is kept only as long as a partner may still come.
    """
    a = stream.where(F.col("event_type") == first).withWatermark("ts", LATE).select(F.col("user_id").alias("a_user"), F.col("event_id").alias("first_id"), F.col("ts").alias("a_ts"))
    b = stream.where(F.col("event_type") == then).withWatermark("ts", LATE).select(F.col("user_id").alias("b_user"), F.col("event_id").alias("then_id"), F.col("ts").alias("b_ts"))
    met = (F.col("a_user") == F.col("b_user")) & (F.col("b_ts") > F.col("a_ts")) & (F.col("b_ts") <= F.col("a_ts") + F.expr(f"INTERVAL {within}"))
    return a.join(b, met).select(F.col("a_user").alias("user_id"), "first_id", "then_id")


def taste_state(stream: DataFrame, rate: float = 0.05) -> DataFrame:
    """One weight for each user, kept as state between batches: it falls with every error and is applied in time order."""

    def update(key, frames: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        n, w = state.get if state.exists else (0, 1.0)
        rows = pd.concat(list(frames)).sort_values(["ts", "event_id"])
        w *= (1 - rate) ** int((rows["event_type"] == "error").sum())
        n += len(rows)
        state.update((n, w))
        yield pd.DataFrame({"user_id": [key[0]], "n": [n], "weight": [w]})

    return stream.groupBy("user_id").applyInPandasWithState(update, "user_id long, n long, weight double", "n long, weight double", "update", "NoTimeout")


def start(df: DataFrame, name: str, mode: str, checkpoint: str):
    """Run a stream over what there is now into a table in memory, and give the query, which has ended."""
    query = df.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    return query


def run_to_end(df: DataFrame, spark: SparkSession, name: str, mode: str, checkpoint: str) -> DataFrame:
    """Run a stream over what there is now, and give its table.

    Rows that are only added (append mode) are written by tasks to files beside the checkpoint, and never stand on the driver.
    """
    if mode != "append":
        start(df, name, mode, checkpoint)
        return spark.table(name)
    path = f"{checkpoint}-{name}"
    df.writeStream.format("parquet").queryName(name).outputMode(mode).option("checkpointLocation", checkpoint).option("path", path).trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(df.schema).parquet(path)


def late_rows(query) -> int:
    """Rows that came later than the watermark, where each is told apart by `sliding`."""
    return sum(op["numRowsDroppedByWatermark"] for p in query.recentProgress for op in p["stateOperators"] if op["operatorName"] == "dedupeWithinWatermark")


def held_rows(query) -> int:
    """Rows that the query still keeps as state."""
    return sum(op["numRowsTotal"] for op in query.recentProgress[-1]["stateOperators"])
