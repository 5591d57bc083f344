"""The taste model in closed form: each weight is an affine fold of the plays, which is associative, so nothing is replayed."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.stored import written
from . import ranks

RATE, DECAY = 0.05, 0.01
#: Steps of one stretch.
FOLD = 1 << 16


def check(rate: float, decay: float) -> None:
    if not 0 < rate <= 1 or not 0 <= decay < 1:
        raise ValueError("rate must lie in (0, 1], decay in [0, 1)")


def valid(rate: Column, decay: Column) -> Column:
    """What `check` lets pass, for parameters that are columns; nulls are not valid."""
    return F.coalesce((rate > 0) & (rate <= 1) & (decay >= 0) & (decay < 1), F.lit(False))


def steps(plays: DataFrame, tags: DataFrame, order: tuple[str, ...]) -> DataFrame:
    """(step, kc, verdict) of tagged plays, numbered from 1 in time by parts of the order; those of untagged tracks aren't steps.

    Plays are written before they are numbered and after, as both the numbering and the fold read them more than once.
    """
    own = plays.join(tags.where(F.size("kc") > 0).select("track_id", "kc"), "track_id").select(*order, "kc", "verdict")
    return written(ranks.numbered(written(own), list(order), "step").select("step", "kc", "verdict"))


def weights(stepped: DataFrame, rate: float = RATE, decay: float = DECAY) -> DataFrame:
    """(kc, w_approach, w_avoid) of the cells that some decisive play has touched; all others are 1.

    With f = 1 - rate, c = 1 - decay and a cell's events at steps s_1 < ... < s_N of 1 to T (s_(N+1) = T + 1), its weight is
    f^N c^(T - s_1 + 1) + sum over j of f^(N-j) (c^(T - s_(j+1) + 1) - c^(T - s_j + 1)).

    A sum needs no replay, only how many events of its cell follow each one, and the next one's step: a scan in two levels. Events
    are ordered within stretches of FOLD steps, whose sums are made relative to their own end; then one row for each cell and
    stretch is scanned, which carries what follows it. No row holds more than numbers, however many plays a cell has.
    """
    check(rate, decay)
    f, c = 1 - rate, 1 - decay
    total = F.broadcast(stepped.agg(F.max("step").alias("T")))
    touched = stepped.where("verdict <> 0").select(F.explode("kc").alias("kc"), "step", F.when(F.col("verdict") > 0, "w_avoid").otherwise("w_approach").alias("which"))
    own = ["kc", "which", "stretch"]
    touched = touched.withColumn("stretch", F.floor((F.col("step") - 1) / FOLD)).crossJoin(total)
    touched = touched.withColumn("end", F.least("T", (F.col("stretch") + 1) * FOLD))
    w = Window.partitionBy(*own)
    # of an event the later ones in its stretch, and the next; an event that is the last there has its term one level above
    e = touched.withColumn("next", F.lead("step").over(w.orderBy("step"))).withColumn("after", F.count("*").over(w) - F.row_number().over(w.orderBy("step")))
    power = lambda base, x: F.pow(F.lit(base), x)
    end = F.col("end")
    inner = power(f, F.col("after")) * (power(c, end - F.col("next") + 1) - power(c, end - F.col("step") + 1))
    level = e.groupBy(*own).agg(F.first("T").alias("T"), F.first("end").alias("end"), F.count("*").alias("n"), F.min("step").alias("first"), F.max("step").alias("last"), F.coalesce(F.sum(inner), F.lit(0.0)).alias("inner"))
    down = Window.partitionBy("kc", "which").orderBy(F.desc("stretch"))
    level = level.withColumn("later", F.sum("n").over(down.rowsBetween(Window.unboundedPreceding, 0)) - F.col("n")).withColumn("next", F.lag("first").over(down))
    outer = power(f, F.col("later")) * (power(c, F.col("T") - end) * F.col("inner") + power(c, F.col("T") + 1 - F.coalesce("next", F.col("T") + 1)) - power(c, F.col("T") - F.col("last") + 1))
    per = level.groupBy("kc", "which").agg((F.sum(outer) + power(f, F.sum("n")) * power(c, F.first("T") - F.min("first") + 1)).alias("w"))
    pick = lambda k: F.coalesce(F.max(F.when(F.col("which") == k, F.col("w"))), F.lit(1.0)).alias(k)
    return per.groupBy("kc").agg(pick("w_approach"), pick("w_avoid"))


def valence(tags: DataFrame, model: DataFrame, key: str) -> DataFrame:
    """Sum over a track's cells of approach minus avoidance; 0 without cells."""
    long = tags.select(key, F.explode_outer("kc").alias("kc"))
    return long.join(model, "kc", "left").groupBy(key).agg(F.coalesce(F.sum(F.coalesce(F.col("w_approach") - F.col("w_avoid"), F.lit(0.0))), F.lit(0.0)).alias("valence"))


def attitude(v: str = "valence") -> F.Column:
    return F.when(F.col(v) > 0, "approach").when(F.col(v) < 0, "avoid").otherwise("neutral")


def rerank(shortlist: DataFrame, valences: DataFrame, key: str) -> DataFrame:
    """One row: of a shortlist (key, distance) the row with the highest valence (of equal ones the nearest, then the smallest
    key), and how many rows are strictly nearer. Rows without a valence can't win."""
    own = shortlist.select(key, "distance").join(valences.select(key, F.round("valence", 9).alias("valence")), key, "left")
    best = own.where("valence is not null").orderBy(F.desc("valence"), "distance", key).limit(1).select(F.col(key).alias("winner"), F.col("distance").alias("d"))
    return own.crossJoin(F.broadcast(best)).groupBy("winner").agg(F.count_if(F.col("distance") < F.col("d")).alias("closer_losers"))
