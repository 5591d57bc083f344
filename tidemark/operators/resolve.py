"""Fuzzy resolution of titles: blocking joins first, an Arrow-batched scorer for what is left."""

from __future__ import annotations

from collections.abc import Iterator
from difflib import SequenceMatcher

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.text import clean_title, modifiers

MATCHED, GUESSED = 0.72, 0.5
TITLE_WEIGHT, ARTIST_WEIGHT, MODIFIER_PENALTY = 0.55, 0.45, 0.35


@F.pandas_udf(T.DoubleType())
def similarity(pairs: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
    """Ratcliff-Obershelp ratio of two strings; nulls count as empty."""
    known: dict[tuple[str, str], float] = {}

    def one(a, b):
        key = (a or "", b or "")
        if key not in known:
            if len(known) > 200_000:
                known.clear()
            known[key] = SequenceMatcher(None, *key).ratio()
        return known[key]

    for a, b in pairs:
        yield pd.Series([one(x, y) for x, y in zip(a, b)], dtype="float64")


def match_score(df: DataFrame, q_title: str, q_artist: str, c_title: str, c_artist: str) -> DataFrame:
    """Adds `score`: weighted similarity of titles and artists, less a penalty where version words differ."""
    same = F.array_sort(modifiers(q_title)) == F.array_sort(modifiers(c_title))
    raw = TITLE_WEIGHT * similarity(clean_title(q_title), clean_title(c_title)) + ARTIST_WEIGHT * similarity(clean_title(q_artist), clean_title(c_artist))
    return df.withColumn("score", F.greatest(F.lit(0.0), F.least(F.lit(1.0), raw - F.when(same, 0.0).otherwise(MODIFIER_PENALTY))))


GRAM = 4


def _grams(c: str) -> F.Column:
    """The distinct substrings of GRAM characters."""
    return F.array_distinct(F.transform(F.sequence(F.lit(1), F.length(c) - GRAM + 1), lambda i: F.substring(F.col(c), i, F.lit(GRAM))))


def _contained(held: DataFrame, h: str, whole: DataFrame, w: str) -> DataFrame:
    """(h, w) for distinct titles of which the first stands within the second.

    What holds a title holds its grams, so the pairs are looked up by the gram of the title that the fewest others have.
    """
    long = lambda df, c: df.where(F.length(c) >= GRAM).select(c, F.explode(_grams(c)).alias("g"))
    inside = long(whole, w)
    rare = long(held, h).join(inside.groupBy("g").agg(F.count("*").alias("n")), "g").groupBy(h).agg(F.min_by("g", F.struct("n", "g")).alias("g"))
    return rare.join(inside, "g").where(F.col(w).contains(F.col(h))).select(h, w)


def _clean_pairs(q: DataFrame, c: DataFrame) -> DataFrame:
    """(q_clean, c_clean) for distinct clean titles that are equal or contained, by equi-joins on their rarest grams."""
    dq, dc = q.select("q_clean").distinct(), c.select("c_clean").distinct()
    same = dq.join(dc, F.col("q_clean") == F.col("c_clean"))
    return same.unionByName(_contained(dq, "q_clean", dc, "c_clean")).unionByName(_contained(dc, "c_clean", dq, "q_clean")).distinct()


def _cleaned(queries: DataFrame, library: DataFrame) -> tuple[DataFrame, DataFrame]:
    return queries.withColumn("q_clean", clean_title("q_title")), library.withColumn("c_clean", clean_title("c_title"))


def block_titles(queries: DataFrame, library: DataFrame) -> DataFrame:
    """Pairs whose clean titles are equal, or of which one of at least GRAM characters stands within the other.

    Distinct titles are compared, by equi-joins on their rarest grams rather than a nested loop; rows come back at the end.
    """
    q, c = _cleaned(queries, library)
    return q.join(_clean_pairs(q, c), "q_clean").join(c, "c_clean")


def count_titles(queries: DataFrame, library: DataFrame) -> DataFrame:
    """(q, n): how many rows `block_titles` gives for each q. Rows of equal titles are counted before they meet, not paired."""
    q, c = _cleaned(queries, library)
    q, c = (df.groupBy(*by).agg(F.count("*").alias(n)) for df, by, n in ((q, ("q", "q_clean"), "times"), (c, ("c_clean",), "rows")))
    held = _clean_pairs(q, c).join(c, "c_clean").groupBy("q_clean").agg(F.sum("rows").alias("rows"))
    return q.join(held, "q_clean").groupBy("q").agg(F.sum(F.col("times") * F.col("rows")).alias("n"))


def _pairs_of(c: str) -> F.Column:
    """The pairs of neighbouring characters of a text between a start and an end mark, repeats numbered: a set."""
    marked = F.concat(F.lit("\x02"), F.col(c), F.lit("\x03"))
    grams = F.transform(F.sequence(F.lit(1), F.length(c) + 1), lambda i: F.substring(marked, i, F.lit(2)))
    return F.transform(grams, lambda g, i: F.concat(g, F.size(F.filter(F.slice(grams, F.lit(1), i), lambda x: x == g)).cast("string")))


def _letters(c: str) -> F.Column:
    """The characters of a text, repeats numbered: a set whose overlap counts common characters."""
    chars = F.filter(F.split(c, ""), lambda x: x != "")
    return F.transform(chars, lambda g, i: F.concat(g, F.size(F.filter(F.slice(chars, F.lit(1), i), lambda x: x == g)).cast("string")))


def _least(a: F.Column, b: F.Column, ratio: float) -> tuple[F.Column, F.Column]:
    """Matched characters that texts of lengths a and b need for the ratio, and pairs of neighbours they then share.

    Of M matched characters and the two marks, each character that isn't matched parts two neighbours at most.
    """
    matched = F.ceil(F.round((a + b) * ratio / 2, 9))
    return matched, F.greatest(F.lit(1), 3 * matched + 1 - a - b)


def similar_pairs(asked: DataFrame, q: str, held: DataFrame, c: str, ratio: float = MATCHED) -> DataFrame:
    """(q, c) for distinct texts whose Ratcliff-Obershelp ratio can reach `ratio`: none that does is left out.

    A join on sets of neighbouring characters. A text is only looked up by its rarest few pairs: so many that one that shares
    as much as the ratio asks for must have one of them (prefix filter). Lengths, shared pairs and common characters are then
    counted; what passes is for the scorer. Empty texts match nothing. Ratios of two thirds and less promise no shared pair.
    """
    if not 2 / 3 < ratio <= 1:
        raise ValueError("ratio must lie in (2/3, 1]")
    ratio_of = ratio / (2 - ratio)  # the shorter text has at least this share of the longer one's length

    def grams(df: DataFrame, name: str) -> DataFrame:
        return df.select(name).where(F.length(name) > 0).distinct().withColumn("grams", _pairs_of(name))

    dq, dc = grams(asked, q), grams(held, c)
    # how many texts hold a pair: a table as large as the alphabet squared, whatever the number of texts
    common = dq.select(F.explode("grams").alias("g")).unionByName(dc.select(F.explode("grams").alias("g"))).groupBy("g").agg(F.count("*").alias("n"))

    def prefixes(df: DataFrame, name: str) -> DataFrame:
        ranked = df.select(name, F.explode("grams").alias("g")).join(common, "g").groupBy(name).agg(F.array_sort(F.collect_list(F.struct("n", "g"))).alias("r"))
        a = F.length(name)
        # the bound is smallest with the shortest partner; without its rounding up it grows with the partner
        least = F.greatest(F.lit(1), F.ceil((1.5 * ratio - 1) * (a + a * ratio_of) + 1 - 1e-9))
        return ranked.select(name, F.explode(F.slice("r", F.lit(1), (a + 2 - least).cast("int"))).alias("x")).select(name, "x.g")

    met = prefixes(dq, q).join(prefixes(dc, c), "g").where((F.length(c) >= F.length(q) * ratio_of - 1e-9) & (F.length(q) >= F.length(c) * ratio_of - 1e-9)).select(q, c).distinct()
    matched, shared = _least(F.length(q), F.length(c), ratio)
    overlap = lambda f: F.size(F.array_intersect(f(q), f(c)))
    return met.where(overlap(_pairs_of) >= shared).where(overlap(_letters) >= matched)


def block_misspelt(queries: DataFrame, library: DataFrame, ratio: float = MATCHED) -> DataFrame:
    """Pairs whose clean titles may be as similar as `ratio`; distinct titles are compared, rows come back at the end."""
    q, c = queries.withColumn("q_clean", clean_title("q_title")), library.withColumn("c_clean", clean_title("c_title"))
    return q.join(similar_pairs(q, "q_clean", c, "c_clean", ratio), "q_clean").join(c, "c_clean")


def status(score: str = "score") -> F.Column:
    return F.when(F.col(score) >= MATCHED, "matched").when(F.col(score) >= GUESSED, "best guess").otherwise("missed")


def best(queries: DataFrame, library: DataFrame, block=block_titles) -> DataFrame:
    """q, c and score: the library row that answers each query best (of equal scores the smallest c), null if none can.

    `block` gives the pairs that are scored: equal or contained titles, or with `block_misspelt` all that are similar enough. Equal questions are asked once, and equal library rows (all but the smallest c of a title and artist) are left out.
    """
    asked = queries.select("q_title", "q_artist").distinct()
    held = library.groupBy("c_title", "c_artist").agg(F.min("c").alias("c"))
    scored = match_score(block(asked, held), "q_title", "q_artist", "c_title", "c_artist")
    top = scored.groupBy("q_title", "q_artist").agg(F.max_by(F.struct("c", "score"), F.struct("score", -F.col("c"))).alias("best"))
    return queries.join(top, ["q_title", "q_artist"], "left").select("q", "best.c", "best.score")


def best_candidate(candidates: DataFrame, key: str, found: str) -> DataFrame:
    """(key, found, score, source): of the candidates (key, source, place, score, found) the one with the highest score, as sources
    are asked in turn and the first with a score of at least MATCHED is the last asked. Equal scores: the first source and place.

    One aggregation: once a source matches, nothing before it scored as high, so the best is within that source.
    """
    hit = F.col("score") >= MATCHED
    first = F.struct(F.when(hit, -F.col("source")).alias("hit"), F.col("score"), (-F.col("source")).alias("s"), (-F.col("place")).alias("p"))
    got = candidates.where("score is not null").groupBy(key).agg(F.max_by(F.struct(found, "score", "source"), first).alias("b"))
    return got.select(key, f"b.{found}", "b.score", "b.source")


def ready(resolved: DataFrame, found: str, *place: str) -> DataFrame:
    """The distinct matched ids, each at its first place, and how often it was matched beyond that."""
    matched = resolved.where(F.col("status") == "matched")
    return matched.groupBy(found).agg(F.min(F.struct(*place)).alias("p"), (F.count("*") - 1).alias("dropped")).select(found, "p.*", "dropped")


def report(resolved: DataFrame) -> DataFrame:
    """Number of resolved titles by status and, of matched ones, by source."""
    return resolved.groupBy("status", F.when(F.col("status") == "matched", F.col("source")).alias("source")).agg(F.count("*").alias("n"))
