"""Sessions put together from days equal those of one window over each listener."""

import datetime
import random
import re

from pyspark.sql import Window
from pyspark.sql import functions as F

from tidemark.operators import warehouse

SCHEMA = "event_id long, ts timestamp_ntz, user string, artist_name string, reason_end string, ms_played long"


def plays(spark):
    rng, start = random.Random(9), datetime.datetime(2024, 3, 1, 22)
    rows = []
    for user in ("a", "b", None, "heavy"):
        at = start
        for _ in range(2000 if user == "heavy" else 120):
            at += datetime.timedelta(seconds=rng.choice([0, 60, 1799, 1800, 1801, 7200, 40000 if user != "heavy" else 900]))
            rows.append((at, user))
    rows += [(None, "a"), (None, "a"), (None, "nothing"), (start, "one")]
    # exactly half an hour over midnight, and a second more
    rows += [(datetime.datetime(2024, 1, 1, 23, 45), "m"), (datetime.datetime(2024, 1, 2, 0, 15), "m"), (datetime.datetime(2024, 1, 2, 23, 50), "m"), (datetime.datetime(2024, 1, 3, 0, 20, 1), "m"), (datetime.datetime(2024, 1, 9), "m")]
    rng.shuffle(rows)
    return spark.createDataFrame([(i, t, u, rng.choice("xyz"), rng.choice(["fwdbtn", "trackdone"]), 1000) for i, (t, u) in enumerate(rows)], SCHEMA).repartition(3)


def test_sessions_over_midnight(spark):
    own = plays(spark)
    w = Window.partitionBy("user").orderBy("ts", "event_id")
    gap = F.col("ts") - F.lag("ts").over(w)
    want = own.withColumn("g", gap).withColumn("s", F.sum(F.when(F.col("g").isNull() | (F.col("g") > F.expr("INTERVAL 30 MINUTES")), 1).otherwise(0)).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    got = warehouse.with_session(own, ("user",), ("ts", "event_id"))
    assert got.count() == own.count()
    both = got.join(want.select("event_id", "g", "s"), "event_id")
    assert both.count() == own.count() and both.where("session <> s or not (gap <=> g)").count() == 0
    assert warehouse.with_gap(own, ("user",), ("ts", "event_id")).columns == [*own.columns, "gap"]
    one = warehouse.sessions(own, ("user",), ("ts", "event_id"))
    assert one.agg(F.sum("n_tracks")).first()[0] == own.count()
    m = [(r.session, r.n_tracks) for r in one.where("user = 'm'").orderBy("session").collect()]
    assert m == [(1, 2), (2, 1), (3, 1), (4, 1)]


def test_no_window_holds_a_whole_listener(spark):
    """Only days, of one row each, are put in the order of a whole listener."""
    got = warehouse.with_session(plays(spark), ("user",), ("ts", "event_id"))
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    windows = [line for line in plan.splitlines() if "Window [" in line]
    specs = [re.search(r"\], \[([^\]]*)\], \[([^\]]*)\]\s*$", line).groups() for line in windows]
    assert len(specs) >= 4
    # partitioned by listener and day, or ordered by day
    assert all("_day" in parts or re.fullmatch(r"_day#\d+ ASC NULLS FIRST", order) for parts, order in specs)


def test_sessions_of_no_rows(spark):
    assert warehouse.sessions(plays(spark).where("event_id < 0"), ("user",), ("ts", "event_id")).collect() == []
