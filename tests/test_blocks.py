"""Rows compared block by block, against plain code."""

import math
import random

import pytest
from pyspark.sql import functions as F

from tidemark.operators import blocks, neighbours, similarity
from tidemark.plans.catalog import QUERIES

SF = "/root/testdata/sf0.001"


def plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_overlaps_send_no_row_for_a_pair(spark, monkeypatch):
    """Several blocks, small batches, sets of all sizes (empty ones and null too), ids below 0: all pairs, and no join on cells."""
    monkeypatch.setattr(blocks, "LIMIT", 30)
    monkeypatch.setattr(blocks, "PAIRS", 50)
    rng = random.Random(11)
    sets = {i - 50: rng.sample(range(-5, 60), rng.choice([0, 1, 4, 9])) for i in range(150)}
    own = spark.createDataFrame([*sets.items(), (999, None), (None, [1])], "id long, kc array<long>").repartition(3)
    got = similarity.pair_overlaps(own, "id")
    want = {(a, b, len(set(sets[a]) & set(sets[b]))) for a in sets for b in sets if a < b and set(sets[a]) & set(sets[b])}
    rows = [tuple(r) for r in got.collect()]
    assert len(rows) == len(want) and set(rows) == want
    assert "Join" not in plan(got) and "FlatMapGroupsInArrow" in plan(got)


@pytest.mark.parametrize("name", ["jn11_pair_overlaps", "lsh7_normalised_hamming"])
def test_overlap_queries_join_no_cells(spark, name):
    """The fingerprints are made with joins of one packed row; pairs are not made by a join of theirs on cells."""
    assert "FlatMapGroupsInArrow" in plan(QUERIES[name](spark, SF))


@pytest.mark.parametrize("n", [1, 6, 300])
def test_nearest_sets_block_by_block_and_by_index(spark, monkeypatch, n):
    """Many blocks of both sides and small steps; wide sets go by the index. Ties, empty sets and null sets as one by one."""
    for name, value in (("LIMIT", 40), ("LEAST", 10), ("QUERIES", 7), ("ROWS", 9), ("FIRST", 8)):
        monkeypatch.setattr(blocks, name, value)
    rng = random.Random(n)
    sets = {i: frozenset(rng.sample(range(90), rng.choice([0, 1, 3, 6, 6, 12, 70]))) for i in range(120)}
    sets |= {200 + i: frozenset({1, 2, 3, 4, 5, 6}) for i in range(60)}
    tie = {k: rng.randrange(3) for k in sets}
    own = spark.createDataFrame([*((k, sorted(v), tie[k]) for k, v in sets.items()), (500, None, 9)], "id long, kc array<long>, tie long").repartition(3)
    want = set()
    for q in (k for k in sets if k % 5 == 0):
        order = sorted((len(sets[q] ^ sets[k]), -tie[k], k) for k in sets if k != q)
        want |= {(q, k, d, i + 1) for i, (d, _, k) in enumerate(order[:n])}
    for wide in (90, 89):
        monkeypatch.setattr(neighbours, "WIDE", wide)
        got = neighbours.nearest_sets(own, own.where("id % 5 = 0"), "id", n, ties=(F.desc("tie"),), extra=("tie",))
        rows = [(r.q, r.id, r.distance, r.place) for r in got.collect()]
        assert len(rows) == len(want) and set(rows) == want
        assert ("FlatMapGroupsInArrow" in plan(got)) == (wide == 90)


@pytest.mark.parametrize("n", [2, 9])
def test_knn_block_by_block(spark, monkeypatch, n):
    """Equal vectors, far and near ones, and odd ones: infinite, not a number (after infinite), null, with a null, of another length."""
    for name, value in (("LIMIT", 50), ("LEAST", 20), ("QUERIES", 7), ("ROWS", 11), ("FIRST", 10)):
        monkeypatch.setattr(blocks, name, value)
    rng = random.Random(n)
    points = {i: [1e6 + rng.gauss(0, 10 ** (i % 5)) for _ in range(5)] for i in range(130)} | {200 + i: [1e6] * 5 for i in range(30)}
    points |= {300: [math.inf] * 5, 301: [math.nan] * 5, 302: None, 303: [1.0, None, 1.0, 1.0, 1.0], 304: [1.0], 305: [2.0], 306: [1e200] * 5}

    def rank(a, b):
        if a is None or b is None or None in a or None in b or len(a) != len(b):
            return (3, 0.0)
        total = 0.0
        for x, y in zip(a, b):
            total += (x - y) * (x - y)
        d = math.sqrt(total)
        return (2, 0.0) if math.isnan(d) else (1, d) if math.isinf(d) else (0, d)

    own = spark.createDataFrame(list(points.items()), "id long, embedding array<double>").repartition(4)
    got = neighbours.knn(own, own, "id", n)
    rows = {(r.q, r.place): r.id for r in got.collect()}
    want = {}
    for q in points:
        for i, k in enumerate(sorted((k for k in points if k != q), key=lambda k: (rank(points[q], points[k]), k))[:n]):
            want[q, i + 1] = k
    assert rows == want
    assert {r.distance for r in got.where("q = 304").collect()} >= {1.0, None}


def test_knn_table_asks_for_every_row(spark):
    n = spark.read.parquet(f"{SF}/embeddings.parquet").count()
    got = QUERIES["lsh10_knn_table"](spark, SF).groupBy("q").count().collect()
    assert len(got) == n and {r["count"] for r in got} == {10}


@pytest.mark.parametrize("name", ["lsh8_sign_neighbours", "lsh8_neighbour_table", "top9_neighbour_table"])
def test_neighbour_queries_pair_no_rows(spark, name):
    """Sets of few different members are compared within tasks: the rows of an index aren't joined."""
    got = plan(QUERIES[name](spark, SF))
    assert "FlatMapGroupsInArrow" in got and "array_intersect" not in got
