"""Candidates of misspelt titles: none that is similar enough is left out."""

import random
from difflib import SequenceMatcher

import duckdb
import pytest

from tidemark.operators import resolve
from tidemark.plans.queries_graph import library, misspelt

SF = "/root/testdata/sf0.001"


def nested_loops(df):
    return "NestedLoop" in df._jdf.queryExecution().executedPlan().toString() or "CartesianProduct" in df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("ratio", [0.72, 0.67, 0.9])
def test_all_similar_texts_are_candidates(spark, ratio):
    rng = random.Random(1)
    words = ["".join(rng.choice("abc d") for _ in range(rng.randrange(0, 14))) for _ in range(150)] + ["", "a", "aa", "aaa", "ab", "ba"]
    wrong = []
    for w in words[:80]:
        chars = list(w)
        for _ in range(rng.randrange(0, 3)):
            at = rng.randrange(len(chars) + 1)
            rng.choice([lambda: chars.insert(at, rng.choice("abcx")), lambda: chars.pop(at % len(chars)) if chars else None])()
        wrong.append("".join(chars))
    pairs = resolve.similar_pairs(spark.createDataFrame([(w,) for w in wrong + [None]], "q string"), "q", spark.createDataFrame([(w,) for w in words], "c string"), "c", ratio)
    rows = [tuple(r) for r in pairs.collect()]
    got, want = set(rows), {(a, b) for a in wrong for b in words if a and b and max(SequenceMatcher(None, a, b).ratio(), SequenceMatcher(None, b, a).ratio()) >= ratio}
    assert len(rows) == len(got) and want <= got
    assert len(got) < len(set(wrong)) * len(set(words))
    assert not nested_loops(pairs)


def test_ratios_that_promise_no_pair_are_refused(spark):
    with pytest.raises(ValueError):
        resolve.similar_pairs(spark.range(1), "id", spark.range(1), "id", 0.5)


def test_recall_on_given_titles(spark):
    asked, held = misspelt(spark, SF), library(spark, SF)
    names = {r.c_title for r in held.collect()}
    wrong = {r.q_title for r in asked.collect()}
    got = {tuple(r) for r in resolve.similar_pairs(asked, "q_title", held, "c_title").collect()}
    want = {(a, b) for a in wrong for b in names if SequenceMatcher(None, a, b).ratio() >= resolve.MATCHED}
    assert want <= got and len(got) < 0.5 * len(wrong) * len(names)
    found = resolve.best(asked, held, resolve.block_misspelt).join(held, "c").join(asked, "q").collect()
    assert len(found) == asked.count()
    # what comes back is the title that scores best among all, with its own brand where the brand has it
    assert sum(r.score >= resolve.MATCHED for r in found) > 0.95 * len(found)
    assert duckdb.sql(f"SELECT count(DISTINCT p_name) FROM '{SF}/part.parquet'").fetchall()[0][0] == len(names)


def test_titles_are_counted_before_they_meet(spark):
    """As many as the rows of `block_titles`, repeats of q and null titles among them; copies of a title don't meet as pairs (here 4 * 10^10)."""
    names = ["red bolt", "Red Bolt (Live)", "bolt", "old red bolt", "ox", "red ox", None, ""]
    q = spark.createDataFrame([(i % 13, names[i % 8]) for i in range(40)], "q long, q_title string")
    c = spark.createDataFrame([(i, names[i % 8]) for i in range(30)], "c long, c_title string")
    want = {r.q: r["count"] for r in resolve.block_titles(q, c).groupBy("q").count().collect()}
    assert {r.q: r.n for r in resolve.count_titles(q, c).collect()} == want
    many = spark.range(200_000).selectExpr("id as q", "'red bolt' as q_title")
    got = resolve.count_titles(many, many.toDF("c", "c_title")).groupBy("n").count().collect()
    assert [tuple(r) for r in got] == [(200_000, 200_000)]
