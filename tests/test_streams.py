"""Streams give what a batch over the same rows gives, and forget what can't matter any more."""

import datetime
import random

import duckdb
import pytest
from pyspark.sql import functions as F

from tidemark.plans.catalog import ORACLE_SQL, QUERIES
from tidemark.streaming import live

T0 = datetime.datetime(2024, 1, 1)


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    """Four arrivals of a day each; the last one also has rows of the first day, and a row that is delivered twice."""
    rng = random.Random(4)
    path = str(tmp_path_factory.mktemp("events") / "e")
    rows = []
    for day in range(4):
        rows.append([(100 * day + i, T0 + datetime.timedelta(days=day, minutes=rng.randrange(1440)), rng.randrange(5), rng.choice(["click", "purchase"]), 1.0) for i in range(60)])
    late = [(900 + i, T0 + datetime.timedelta(minutes=i), 1, "click", 1.0) for i in range(7)]
    for batch in (rows[0], rows[1], rows[2], rows[3] + late + rows[3][:1]):
        spark.createDataFrame(batch, "event_id long, ts timestamp_ntz, user_id long, event_type string, value double").repartition(1).write.mode("append").parquet(path)
    return path, [r for batch in rows for r in batch]


def test_sliding_windows_and_late_rows(spark, folder, tmp_path):
    path, rows = folder
    query = live.start(live.sliding(live.event_stream(spark, path)), "w1", "append", str(tmp_path / "c"))
    want, passed = {}, max(r[1] for r in rows) - datetime.timedelta(hours=1)
    for _, ts, _, kind, value in rows:
        hour = ts.replace(minute=0)
        for start in (hour, hour - datetime.timedelta(hours=1)):
            if start + datetime.timedelta(hours=2) <= passed:
                n, total = want.get((start, kind), (0, 0.0))
                want[start, kind] = (n + 1, total + value)
    got = {(r.started_at, r.event_type): (r.n, r.total) for r in spark.table("w1").withColumn("started_at", F.col("started_at").cast("timestamp_ntz")).collect()}
    assert got == want and live.late_rows(query) == 7
    # windows and ids of the last hours are all that is kept
    assert live.held_rows(query) < 30


def test_interval_join_forgets(spark, folder, tmp_path):
    path, rows = folder
    query = live.start(live.followed(live.event_stream(spark, path), "click", "purchase", "2 hours"), "j1", "append", str(tmp_path / "c"))
    hours = datetime.timedelta(hours=2)
    first = rows[0:60] + rows[60:120] + rows[120:180] + rows[180:] + [rows[180]]  # the row that is delivered twice joins twice
    want = sorted((a[0], b[0]) for a in first for b in first if a[2] == b[2] and a[3] == "click" and b[3] == "purchase" and a[1] < b[1] <= a[1] + hours)
    assert sorted((r.first_id, r.then_id) for r in spark.table("j1").collect() if r.first_id < 900) == want
    assert live.held_rows(query) < 60


@pytest.fixture(scope="module")
def half(spark, tmp_path_factory):
    """An event each ten minutes for four days; one that comes late (its id is divisible by 50) lies in the last hour of the first half."""
    path = str(tmp_path_factory.mktemp("half"))
    rows = [(i + 15, T0 + datetime.timedelta(minutes=10 * i, seconds=1), i % 3, "view", 1.0) for i in range(576)]
    assert rows[285][0] % 50 == 0
    spark.createDataFrame(rows, "event_id long, ts timestamp_ntz, user_id long, event_type string, value double").repartition(1).write.parquet(f"{path}/events.parquet")
    return path


def same_as_sql(spark, path, name):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW events AS SELECT * FROM read_parquet('{path}/events.parquet/*.parquet')")
    want = con.execute(ORACLE_SQL[name]).fetchall()
    return sorted(tuple(r) for r in QUERIES[name](spark, path).collect()) == sorted(want) and len(want) > 0


def test_rows_of_the_last_hour_of_the_half_are_late(spark, half):
    assert same_as_sql(spark, half, "stream_late_rows")


def test_windows_leave_out_rows_of_the_last_hour_of_the_half(spark, half):
    assert same_as_sql(spark, half, "stream_sliding_windows")


def test_added_rows_are_written_by_tasks(spark, folder, tmp_path):
    """In append mode the rows are read from files, also where there are none yet; no table of them is held on the driver."""
    path, _ = folder
    got = live.run_to_end(live.sessions(live.event_stream(spark, path)), spark, "s2", "append", str(tmp_path / "c"))
    assert got.count() > 0 and got.inputFiles() and not spark.catalog.tableExists("s2")
    none = live.run_to_end(live.sessions(live.event_stream(spark, path).where("user_id < 0")), spark, "s3", "append", str(tmp_path / "d"))
    assert none.columns == got.columns and none.count() == 0
