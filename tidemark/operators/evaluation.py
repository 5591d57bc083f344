"""Metrics of predictions and labels."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .ranks import percent_rank


def auc(df: DataFrame, score: str, label: str, by: list[str] | None = None) -> DataFrame:
    """Area under the ROC curve, ties counting half; null with one class. Only distinct scores are ranked."""
    by = by or []
    r = percent_rank(df.where(F.col(score).isNotNull()), score, "r", by)
    n1, n = F.count_if(F.col(label) == 1), F.count("*")
    value = F.try_divide(F.sum(F.when(F.col(label) == 1, F.col("r_abs")).otherwise(0.0)) - n1 * (n1 + 1) / 2, (n1 * (n - n1)).cast("double"))
    return r.groupBy(*by).agg(value.alias("auc")) if by else r.agg(value.alias("auc"))


def spearman(df: DataFrame, a: str, b: str) -> DataFrame:
    """Rank correlation with mean ranks; null for a constant."""
    return percent_rank(percent_rank(df, a, "ra"), b, "rb").agg(F.corr("ra_abs", "rb_abs").alias("spearman"))


def jaccard(a: str | Column, b: str | Column) -> Column:
    return F.try_divide(F.size(F.array_intersect(a, b)).cast("double"), F.size(F.array_union(a, b)))


def split_groups(df: DataFrame, group: str, shares: tuple[float, float] = (0.7, 0.85), seed: int = 0) -> DataFrame:
    """Adds `split` so that a group is in one split only: a hash of the group is its place between 0 and 1, cut at the shares.

    No row looks at another, so shares are met on the whole, not to a group.
    """
    place = F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}|"), F.col(group).cast("string"))), 1, 8), 16, 10).cast("long") / F.lit(2.0**32)
    return df.withColumn("split", F.when(place < shares[0], "train").when(place < shares[1], "validation").otherwise("test"))


def shannon_evenness(df: DataFrame, n: str) -> DataFrame:
    """Entropy of shares over its largest value; null with one share."""
    total = df.where(F.col(n) > 0).crossJoin(F.broadcast(df.agg(F.sum(n).alias("_t")))).withColumn("p", F.col(n) / F.col("_t"))
    k = F.count("*")
    return total.agg(F.when(k > 1, -F.sum(F.col("p") * F.ln("p")) / F.ln(k)).alias("evenness"))
