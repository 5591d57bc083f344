"""Ranks, running values and deduplication, with ties that are settled."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.stored import written


def top(df: DataFrame, n: int, *order: Column | str) -> DataFrame:
    return df.orderBy(*order).limit(n)


def top_per(df: DataFrame, n: int, by: list, order: list, name: str = "rank") -> DataFrame:
    """The first n rows of each group, numbered from 1. The limit is pushed below the shuffle."""
    return df.withColumn(name, F.row_number().over(Window.partitionBy(*by).orderBy(*order)).cast("long")).where(F.col(name) <= n)


def keep_one(df: DataFrame, by: list, order: list) -> DataFrame:
    return top_per(df, 1, by, order, "_rank").drop("_rank")


#: Parts of an order are found in steps of FAN ways each, so that a part has about PART_ROWS rows at most; SAMPLED rows are
#: looked at for each part.
FAN, PART_ROWS, SAMPLED = 16, 1 << 20, 32


def in_parts(df: DataFrame, by: list, order: list, name: str = "_part") -> DataFrame:
    """Adds the number of a row's part of the order of (by, order), ascending: parts hold about as many rows each.

    Splitters are quantiles of a sample, those rows whose values have the smallest hashes; so they depend on values alone,
    whatever their type, and are the same if a task runs again. The sample follows the number of parts, which follows the
    rows (256 parts, and 16 times as many when these get large). Equal values are in one part.
    """
    rows = df.count()
    levels = 2
    while FAN**levels * PART_ROWS < rows:
        levels += 1
    parts = FAN**levels
    key = F.struct(*by, *order)
    share = min(1.0, parts * SAMPLED / max(1, rows))
    sample = df.select(key.alias("k")).where(F.pmod(F.xxhash64("k"), F.lit(1 << 40)) < int(share * (1 << 40))).distinct()
    cuts = sample.agg(F.array_sort(F.collect_list("k")).alias("k"))
    # the smallest value of each part but the first; some may be equal where there are few values
    cuts = cuts.select(F.transform(F.sequence(F.lit(1), F.lit(parts - 1)), lambda i: F.get("k", F.floor(i * F.size("k") / parts).cast("int"))).alias("_cuts"))
    own = df.crossJoin(F.broadcast(cuts)).withColumns({"_key": key, name: F.lit(0)})
    for level in reversed(range(levels)):
        stride = FAN**level
        steps = F.array(*[F.lit(i * stride - 1) for i in range(1, FAN)])
        own = own.withColumn(name, F.col(name) + stride * F.size(F.filter(steps, lambda i: F.get("_cuts", F.col(name) + i) <= F.col("_key"))))
    return own.drop("_cuts", "_key")


def _upto(n: str, w) -> Column:
    return F.sum(n).over(w.rowsBetween(Window.unboundedPreceding, 0)) - F.col(n)


def numbered(df: DataFrame, order: list, name: str, by: list | None = None) -> DataFrame:
    """Adds the row's number from 1 in the order of `order` (columns, ascending), within `by`.

    A running number without one task for a group, or for the table: parts of the order are counted, then rows are numbered
    within them.
    """
    by = by or []
    own = in_parts(df, by, order)
    parts = own.groupBy(*by, "_part").agg(F.count("*").alias("_n"))
    parts = parts.select(*by, "_part", _upto("_n", Window.partitionBy(*by).orderBy("_part")).alias("_first"))
    own = own.join(parts, [*by, "_part"])
    return own.withColumn(name, F.col("_first") + F.row_number().over(Window.partitionBy(*by, "_part").orderBy(*order))).drop("_part", "_first")


def _before(counts: DataFrame, by: list, x: str, descending: bool) -> DataFrame:
    """Adds `_before`, the sum of `_n` over values that come before, to distinct values (of any type) with their counts.

    Sums of the parts are added up first, then values within each, so that no task sees all values.
    """
    order = F.desc(x) if descending else F.asc(x)
    own = in_parts(counts, by, [x]).withColumn("_part", F.col("_part") * (-1 if descending else 1))
    parts = own.groupBy(*by, "_part").agg(F.sum("_n").alias("_n"))
    parts = parts.select(*by, "_part", _upto("_n", Window.partitionBy(*by).orderBy("_part")).alias("_first"))
    own = own.join(parts, [*by, "_part"]).withColumn("_before", F.col("_first") + _upto("_n", Window.partitionBy(*by, "_part").orderBy(order)))
    return own.drop("_part", "_first")


def percent_rank(df: DataFrame, x: str, name: str, by: list | None = None, descending: bool = False) -> DataFrame:
    """Mean rank of equal values divided by the number of values (nulls have none).

    Distinct values are counted first, then ranked by parts of their order.
    """
    by = by or []
    counts = written(df.where(F.col(x).isNotNull()).groupBy(*by, x).agg(F.count("*").alias("_n")))
    total = counts.groupBy(*by).agg(F.sum("_n").alias("_total"))
    ranks = _before(counts, by, x, descending)
    ranks = ranks.join(total, by) if by else ranks.crossJoin(F.broadcast(total))
    place = F.col("_before") + (F.col("_n") + 1) / 2
    ranks = ranks.select(*by, x, (place / F.col("_total")).alias(name), place.alias(f"{name}_abs"))
    return df.join(ranks, [*by, x], "left")


def min_rank(df: DataFrame, x: str, name: str) -> DataFrame:
    """1 plus the number of rows with a larger value."""
    counts = written(df.groupBy(x).agg(F.count("*").alias("_n")))
    return df.join(_before(counts, [], x, True).select(x, (F.col("_before") + 1).alias(name)), x, "left")


def unit_position(df: DataFrame, x: str, key: str, name: str, by: list | None = None) -> DataFrame:
    """Position in ascending order from 0 to 1; 1 for a single row. Ties go by key."""
    by = by or []
    n = df.groupBy(*by).agg(F.count("*").alias("_total"))
    own = numbered(df, [x, key], "_k", by)
    own = own.join(n, by) if by else own.crossJoin(F.broadcast(n))
    return own.withColumn(name, F.when(F.col("_total") <= 1, F.lit(1.0)).otherwise((F.col("_k") - 1) / (F.col("_total") - 1))).drop("_k", "_total")


def decile(rank: Column, n: Column) -> Column:
    """Bucket 0 to 9 of a rank from 1 to n, with right-closed quantile edges."""
    return F.greatest(F.ceil(F.try_divide((rank - 1).cast("double"), (n - 1) / 10.0)) - 1, F.lit(0)).cast("long")


def forward_fill(df: DataFrame, x: str, by: list, order: list, default=0) -> DataFrame:
    w = Window.partitionBy(*by).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return df.withColumn(x, F.coalesce(F.last(x, ignorenulls=True).over(w), F.lit(default)))


def month_spine(df: DataFrame, t: str = "month") -> DataFrame:
    """Every month from the first to the last of `t`."""
    return df.agg(F.min(t).alias("a"), F.max(t).alias("b")).select(F.explode(F.sequence("a", "b", F.expr("interval 1 month"))).alias(t))
