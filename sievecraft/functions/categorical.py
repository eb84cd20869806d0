"""Encodings of categories and group-by-then, as aggregates joined back by value."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .window import group_quantiles, prefix_sums

#: A lookup of at most so many categories is broadcast; a larger one is joined by shuffle.
BROADCAST_ROWS = 100_000

AGGREGATES = {
    "mean": F.avg,
    "max": F.max,
    "min": F.min,
    "std": F.stddev_pop,
    "var": F.var_pop,
    "len": lambda c: F.count(F.lit(1)),
    "prod": F.product,
    "sum": F.sum,
}


def lookup(df: DataFrame, codes: DataFrame, col: str) -> DataFrame:
    """Left join by value; broadcast only if the lookup is known to be small."""
    small = codes.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS
    return df.join(F.broadcast(codes) if small else codes, col, "left")


def frequency_encode(train: DataFrame, df: DataFrame, col: str, out: str, relative: bool = True) -> DataFrame:
    """Share (or number) of training rows with the value; unseen becomes 0."""
    total = train.count()
    codes = train.where(F.col(col).isNotNull()).groupBy(col).agg((F.count("*") / F.lit(total) if relative else F.count("*")).alias(out))
    return lookup(df, codes, col).withColumn(out, F.coalesce(out, F.lit(0)))


def ordinal_codes(train: DataFrame, col: str, out: str) -> DataFrame:
    """(value, code): codes from 0 in sorted order, ranked range by range."""
    values = train.where(F.col(col).isNotNull()).select(F.col(col).alias("value")).distinct().withColumn("n", F.lit(1))
    return prefix_sums(values, "value", ["n"]).select(F.col("value").alias(col), F.col("before_n").cast("int").alias(out))


def ordinal_encode(train: DataFrame, df: DataFrame, col: str, out: str) -> DataFrame:
    return lookup(df, ordinal_codes(train, col, out), col)


def contrast(code: Column, k: int, kind: str) -> list[Column]:
    """k - 1 contrast columns of a code in 0..k-1: Helmert (level against the mean of those before) or backward difference."""
    cols = []
    for j in range(1, k):
        if kind == "helmert":
            cols.append(F.when(code == j, F.lit(float(j))).when(code < j, F.lit(-1.0)).otherwise(F.lit(0.0)))
        else:
            cols.append(F.when(code < j, F.lit(-(k - j) / k)).otherwise(F.lit(j / k)))
    return [F.when(code.isNotNull(), c) for c in cols]


def group_statistic(df: DataFrame, value: str, key: str, agg: str, out: str) -> DataFrame:
    """(key, out): an aggregate of every group, combined in tasks before the shuffle; medians by counts over ranges of values."""
    if agg == "median":
        return group_quantiles(df, key, value, {out: 0.5})
    return df.groupBy(key).agg(AGGREGATES[agg](F.col(value)).alias(out))


def group_by_then(train: DataFrame, df: DataFrame, value: str, key: str, agg: str, out: str) -> DataFrame:
    """The training aggregate of ``value`` in the row's group; an unseen key gives 0 for std, 1 for len, else the raw value."""
    codes = group_statistic(train, value, key, agg, out)
    unseen = {"std": F.lit(0.0), "len": F.lit(1)}.get(agg, F.col(value))
    return lookup(df, codes, key).withColumn(out, F.coalesce(out, unseen))


def group_by_then_over(df: DataFrame, value: str, key: str, agg: str, out: str) -> DataFrame:
    """Group-by-then where the training part is the table itself: no task holds a group. Rows without a key are a group."""
    codes = group_statistic(df, value, key, agg, out).withColumnRenamed(key, "__key")
    small = codes.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS
    return df.drop(out).join(F.broadcast(codes) if small else codes, F.col(key).eqNullSafe(F.col("__key")), "left").drop("__key")
