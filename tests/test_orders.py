"""Ranks, running numbers and folds over whole tables, in parts that are about as large."""

import datetime
import random

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from tidemark.operators import ranks, taste

VALUES = {
    "double": lambda rng: rng.expovariate(1.0) ** 3,
    "timestamp_ntz": lambda rng: datetime.datetime(2000, 1, 1) + datetime.timedelta(seconds=int(rng.expovariate(1e-6))),
    "string": lambda rng: "https://host.example/" + "".join(rng.choice("ab") for _ in range(1 + int(rng.expovariate(0.1)))),
    "long": lambda rng: int(rng.expovariate(0.2)),
}


@pytest.mark.parametrize("kind", sorted(VALUES))
def test_parts_follow_the_order_and_are_even(spark, kind):
    rng = random.Random(1)
    rows = [(i, VALUES[kind](rng), f"g{i % 3}") for i in range(20000)]
    own = spark.createDataFrame(rows, f"id long, x {kind}, g string").repartition(4)
    got = ranks.in_parts(own.select("x").distinct(), [], ["x"]).groupBy("_part").agg(F.count("*").alias("n"), F.min("x").alias("lo"), F.max("x").alias("hi")).orderBy("_part").collect()
    assert all(a.hi < b.lo for a, b in zip(got, got[1:]))
    distinct = len({r[1] for r in rows})
    assert sum(r.n for r in got) == distinct
    assert max(r.n for r in got) <= max(3, 4 * distinct / 256)


@pytest.mark.parametrize("kind", sorted(VALUES))
def test_numbers_and_ranks_equal_one_window(spark, kind):
    rng = random.Random(2)
    rows = [(i, None if i % 50 == 0 else VALUES[kind](rng), f"g{0 if i % 3 else i % 7}") for i in range(3000)] + [(5000 + i, rows_x, "hot") for i, rows_x in enumerate([VALUES[kind](rng)] * 500)]
    own = spark.createDataFrame(rows, f"id long, x {kind}, g string").repartition(4)
    for by in ([], ["g"]):
        w = Window.partitionBy(*by).orderBy("x", "id")
        got = ranks.numbered(own, ["x", "id"], "k", by).withColumn("want", F.row_number().over(w))
        assert got.count() == len(rows) and got.where("k <> want").count() == 0
    got = ranks.percent_rank(own, "x", "p", ["g"]).where("x is not null")
    w = Window.partitionBy("g")
    want = (F.rank().over(w.orderBy("x")) + (F.count("*").over(Window.partitionBy("g", "x")) - 1) / 2) / F.count("*").over(w)
    assert got.withColumn("want", want).where("abs(p - want) > 1e-12 or p is null").count() == 0
    got = ranks.min_rank(own.where("x is not null"), "x", "r").withColumn("want", F.rank().over(Window.orderBy(F.desc("x"))))
    assert got.where("r <> want").count() == 0


def test_orders_of_no_and_one_row(spark):
    own = spark.createDataFrame([(1, 2.0)], "id long, x double")
    assert ranks.numbered(own, ["x"], "k").first().k == 1 and ranks.unit_position(own, "x", "id", "u").first().u == 1.0
    none = own.where("id = 2")
    assert ranks.numbered(none, ["x"], "k").collect() == [] and ranks.percent_rank(none, "x", "p").collect() == [] and ranks.unit_position(none, "x", "id", "u").collect() == []


@pytest.mark.parametrize("fold,decay,rate", [(1, 0.01, 0.05), (7, 0.3, 0.5), (1 << 16, 0.2, 0.05), (7, 0.0, 1.0)])
def test_fold_equals_a_replay(spark, monkeypatch, fold, decay, rate):
    monkeypatch.setattr(taste, "FOLD", fold)
    rng = random.Random(3)
    tracks = {f"t{i}": sorted(rng.sample(range(12), rng.randrange(0, 4))) for i in range(20)}
    start = datetime.datetime(2024, 1, 1)
    plays = [(i, start + datetime.timedelta(minutes=rng.randrange(600)), rng.choice(list(tracks)), rng.choice([-1, 0, 1])) for i in range(300)]
    weights = {}
    for _, _, track, verdict in sorted(plays, key=lambda p: (p[1], p[0])):
        if not tracks[track]:
            continue
        for side in ("w_approach", "w_avoid"):
            if (side == "w_avoid" and verdict > 0) or (side == "w_approach" and verdict < 0):
                for k in tracks[track]:
                    weights[k, side] = weights.get((k, side), 1.0) * (1 - rate)
        for key in weights:
            weights[key] += decay * (1 - weights[key])
    own = spark.createDataFrame(plays, "event_id long, ts timestamp_ntz, track_id string, verdict int")
    tags = spark.createDataFrame(list(tracks.items()), "track_id string, kc array<long>")
    got = taste.weights(taste.steps(own, tags, ("ts", "event_id")), rate, decay).collect()
    assert {r.kc for r in got} == {k for k, _ in weights}
    for r in got:
        assert r.w_approach == pytest.approx(weights.get((r.kc, "w_approach"), 1.0), abs=1e-9) and r.w_avoid == pytest.approx(weights.get((r.kc, "w_avoid"), 1.0), abs=1e-9)
