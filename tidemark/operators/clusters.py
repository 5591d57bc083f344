"""k-medoids over fingerprints: fitted on a bounded sample of distinct ones, then every row goes to its nearest medoid."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import ranks
from .similarity import hamming

#: Distinct fingerprints that medoids are fitted on, at most; all rows are assigned.
SAMPLE = 4000

#: Numbers of clusters that are tried.
KS = range(6, 13)


def distances(cells: list[list[int]]) -> np.ndarray:
    width = max((max(c, default=-1) for c in cells), default=-1) + 1
    x = np.zeros((len(cells), max(width, 1)), np.float32)
    for i, c in enumerate(cells):
        x[i, c] = 1
    n = x.sum(1)
    return (n[:, None] + n[None, :] - 2 * x @ x.T) / np.maximum(n[:, None] + n[None, :], 1)


def seeds(d: np.ndarray, k: int) -> np.ndarray:
    """Farthest-first: the most central row, then ever the row farthest from those chosen (the first of equal ones)."""
    own = [int(d.sum(1).argmin())]
    while len(own) < min(k, len(d)):
        own.append(int(d[:, own].min(1).argmax()))
    return np.array(own)


def medoids(d: np.ndarray, k: int, rounds: int = 50) -> np.ndarray:
    """Seeds, then assignment and re-centring until nothing changes; an empty cluster keeps its medoid."""
    own = seeds(d, k)
    for _ in range(rounds):
        label = d[:, own].argmin(1)
        new = own.copy()
        for c in range(len(own)):
            members = np.flatnonzero(label == c)
            if len(members):
                new[c] = members[d[np.ix_(members, members)].sum(1).argmin()]
        if (new == own).all():
            break
        own = new
    return own


def silhouette(d: np.ndarray, label: np.ndarray) -> float:
    sums = np.stack([d[:, label == c].sum(1) for c in np.unique(label)], 1)
    n = np.array([(label == c).sum() for c in np.unique(label)])
    own = np.searchsorted(np.unique(label), label)
    a = sums[np.arange(len(d)), own] / np.maximum(n[own] - 1, 1)
    other = np.where(np.arange(len(n))[None] == own[:, None], np.inf, sums / n)
    b = other.min(1)
    return float(np.where(n[own] > 1, (b - a) / np.maximum(np.maximum(a, b), 1e-12), 0).mean())


def sample(tags: DataFrame, key: str) -> list[list[int]]:
    """At most SAMPLE distinct fingerprints, in the order of a hash of their smallest key."""
    distinct = tags.groupBy("kc").agg(F.min(key).alias(key)).orderBy(F.xxhash64(key), key).limit(SAMPLE)
    return [r["kc"] for r in distinct.collect()]


def silhouettes(d: np.ndarray, ks: range = KS) -> list[tuple[int, float]]:
    """(k, mean silhouette) of each k whose medoids make more than one cluster."""
    labels = ((k, d[:, medoids(d, k)].argmin(1)) for k in ks) if len(d) else ()
    return [(k, silhouette(d, label)) for k, label in labels if len(np.unique(label)) > 1]


def fit(tags: DataFrame, key: str, ks: range = KS) -> tuple[list[list[int]], float]:
    """Cells of the medoids of the k with the best mean silhouette (the smallest of equal ones), and that value."""
    cells = sample(tags, key)
    d, best = distances(cells), (-2.0, [])
    for k in ks:
        m = medoids(d, k)
        label = d[:, m].argmin(1)
        if len(np.unique(label)) > 1 and (s := silhouette(d, label)) > best[0] + 1e-12:
            best = (s, [cells[i] for i in m])
    return best[1], best[0]


def assign(tags: DataFrame, centres: list[list[int]]) -> DataFrame:
    """Adds `cluster`, the first of the nearest medoids, and `distance`. The medoids are a literal."""
    lists = F.array(*[F.array(*[F.lit(x).cast("long") for x in c]) for c in centres])
    far = F.transform(lists, lambda c, i: F.struct((hamming("kc", c) / F.greatest(F.size("kc") + F.size(c), F.lit(1))).alias("distance"), i.cast("long").alias("cluster")))
    return tags.withColumn("_n", F.array_min(far)).withColumns({"cluster": F.col("_n.cluster"), "distance": F.col("_n.distance")}).drop("_n")


def summary(assigned: DataFrame, plays: str) -> DataFrame:
    """Size, plays and share of plays of each cluster."""
    per = assigned.groupBy("cluster").agg(F.count("*").alias("tracks"), F.sum(plays).alias("plays"))
    return per.crossJoin(F.broadcast(per.agg(F.sum("plays").alias("t")))).select("cluster", "tracks", "plays", (F.col("plays") / F.col("t")).alias("share"))


def cards(assigned: DataFrame, key: str, artist: str, plays: str, artists: int = 3, exemplars: int = 10) -> DataFrame:
    """(cluster, top_artists, exemplars, medoid): the artists and the rows with most plays, most first, and the row nearest to the
    medoid. Ties go to the smallest name or key; rows without an artist count in none.
    """
    listed = lambda df, c: df.groupBy("cluster").agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", c))), lambda x: x[c]).alias("_" + c))
    played = assigned.where(F.col(artist).isNotNull()).groupBy("cluster", artist).agg(F.sum(plays).alias("n"))
    who = listed(ranks.top_per(played, artists, ["cluster"], [F.desc("n"), artist]), artist)
    what = listed(ranks.top_per(assigned, exemplars, ["cluster"], [F.desc_nulls_last(plays), key]), key)
    near = assigned.groupBy("cluster").agg(F.min_by(key, F.struct("distance", key)).alias("medoid"))
    got = near.join(what, "cluster").join(who, "cluster", "left")
    return got.select("cluster", F.coalesce("_" + artist, F.array().cast("array<string>")).alias("top_artists"), F.col("_" + key).alias("exemplars"), "medoid")


#: Least share and lift that name a cluster, and standard deviations of energy that do.
TAG_RATE, ERA_SHARE, ERA_LIFT, ENERGY = 0.25, 0.25, 1.5, 0.3


def names(assigned: DataFrame, tags: str = "mood_tags", intensity: str = "intensity", era: str = "era") -> DataFrame:
    """(cluster, name) by what sets a cluster apart from all rows: up to two tags by lift among those that TAG_RATE of it carry
    (none: its most frequent one), a word for its energy, and the era of the highest lift.

    Ties go to the smaller tag or era. Null tags, intensities and eras don't count; a cluster with nothing to say has an empty
    name. Everything beyond one aggregation is as large as clusters times distinct tags and eras.
    """
    every = F.broadcast(assigned.agg(F.count("*").alias("rows"), F.avg(intensity).alias("mean"), F.stddev_samp(intensity).alias("std"), F.count(era).alias("dated")))
    size = assigned.groupBy("cluster").agg(F.count("*").alias("n"), F.avg(intensity).alias("own"), F.count(era).alias("e")).crossJoin(every)
    tag = assigned.select("cluster", F.explode(F.array_compact(F.array_distinct(tags))).alias("tag")).groupBy("cluster", "tag").agg(F.count("*").alias("k"))
    rate = tag.join(tag.groupBy("tag").agg(F.sum("k").alias("in_all")), "tag").join(size, "cluster")
    rate = rate.withColumns({"r": F.col("k") / F.col("n"), "lift": F.col("k") / F.col("n") / (F.col("in_all") / F.col("rows"))}).withColumn("fit", F.col("r") >= TAG_RATE)
    best = ranks.top_per(rate, 2, ["cluster"], [F.desc("fit"), F.desc(F.round(F.when(F.col("fit"), F.col("lift")).otherwise(F.col("r")), 12)), "tag"], "place").where("fit or place = 1")
    best = best.groupBy("cluster").agg(F.transform(F.array_sort(F.collect_list(F.struct("place", "tag"))), lambda x: x["tag"]).alias("tags"))
    aged = assigned.where(F.col(era).isNotNull()).groupBy("cluster", F.col(era).alias("era")).agg(F.count("*").alias("k"))
    aged = aged.join(aged.groupBy("era").agg(F.sum("k").alias("in_all")), "era").join(size, "cluster").where(F.col("k") / F.col("e") >= ERA_SHARE)
    aged = aged.withColumn("lift", F.round(F.col("k") / F.col("e") / (F.col("in_all") / F.col("dated")), 12))
    aged = ranks.keep_one(aged, ["cluster"], [F.desc("lift"), "era"]).where(F.col("lift") >= ERA_LIFT).select("cluster", F.col("era").cast("string").alias("era"))
    z = (F.col("own") - F.col("mean")) / F.when(F.col("std") == 0, 1.0).otherwise(F.col("std"))
    word = F.when(z >= ENERGY, "high-energy").when(z <= -ENERGY, "low-key")
    parts = F.concat(F.coalesce("tags", F.array().cast("array<string>")), F.array_compact(F.array(word, F.col("era"))))
    name = F.array_join(parts, " · ")
    first = F.coalesce(F.get(parts, F.lit(0)), F.lit(""))
    capital = F.concat(F.upper(F.substring(first, 1, 1)), F.lower(F.substring(first, 2, 1_000)), F.substr(name, F.length(first) + 1))
    return size.join(best, "cluster", "left").join(aged, "cluster", "left").select("cluster", capital.alias("name"))
