"""Rank transformations.

A window ordered over a whole column is one task. Here distinct values are dealt to ranges, summed inside each range
and shifted by the ranges before it, whose sums are one row per range.
"""

from __future__ import annotations

import math

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..scratch import ROWS, cut, discard


def range_edges(values: DataFrame, col: str) -> list:
    """Upper ends of up to as many ranges as there are shuffle partitions, from a sample by hash: they decide the cost, not the result."""
    parts = max(1, int(values.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    if parts == 1:
        return []
    some = sorted(r[0] for r in values.where(F.col(col).isNotNull()).select(col).orderBy(F.xxhash64(col)).limit(50 * parts).collect())
    return sorted({some[len(some) * i // parts] for i in range(1, parts)}) if some else []


def range_of(value: Column, edges: list) -> Column:
    """How many edges lie below the value, by binary search."""
    if not edges:
        return F.lit(0)
    steps = [1 << k for k in reversed(range(len(edges).bit_length()))]
    known = F.array(*[F.lit(e) for e in edges])
    return F.aggregate(F.array(*[F.lit(x) for x in steps]), F.lit(0), lambda at, step: F.when(F.get(known, at + step - 1) < value, at + step).otherwise(at))


def prefix_sums(values: DataFrame, col: str, sums: list[str], by: list[str] | None = None) -> DataFrame:
    """``values`` with before_<s> for each of ``sums``: its sum over the rows with a smaller ``col``, within ``by``.

    ``values`` has one row per ``by`` and ``col``; ``by`` has few values, and the sums per range come in one row each.
    """
    by = by or []
    ranged = values.withColumn("__part", range_of(F.col(col), range_edges(values, col)))
    totals = ranged.groupBy(*by, "__part").agg(*[F.sum(s).alias(f"__{s}") for s in sums])
    earlier = W.partitionBy(*by).orderBy("__part")
    offset = totals.select(*by, "__part", *[(F.sum(f"__{s}").over(earlier) - F.col(f"__{s}")).alias(f"__{s}") for s in sums])
    local = W.partitionBy(*by, "__part").orderBy(col)
    out = ranged.withColumns({f"before_{s}": F.sum(s).over(local) - F.col(s) for s in sums})
    out = out.join(offset if by else F.broadcast(offset), [*by, "__part"])
    return out.withColumns({f"before_{s}": F.col(f"before_{s}") + F.col(f"__{s}") for s in sums}).drop("__part", *[f"__{s}" for s in sums])


def value_ranks(df: DataFrame, col: str) -> DataFrame:
    """(value, n, before): distinct non-missing values with rows of that value and rows of smaller ones."""
    counts = df.where(F.col(col).isNotNull()).groupBy(F.col(col).alias("value")).agg(F.count("*").alias("n"))
    return prefix_sums(counts, "value", ["n"]).select("value", "n", F.col("before_n").alias("before"))


def exact_quantiles(df: DataFrame, cols: list[str], shares: list[float]) -> dict[str, list[float | None]]:
    """Exact quantiles of each column, interpolated between order statistics; None where a column has no values.

    Counts per value are written once and summed over ranges, so no task and no buffer holds a column; only the order
    statistics that are asked for come to the driver. ``df`` may be what ``counted`` makes.
    """
    pairs = F.array(*[F.struct(F.lit(c).alias("feature"), F.col(c).cast("double").alias("value")) for c in cols])
    number = F.col(ROWS) if ROWS in df.columns else F.lit(1)
    long = df.select(number.alias("n"), F.explode(pairs).alias("p")).select("n", "p.*").where("value IS NOT NULL")
    counts = cut(long.groupBy("feature", "value").agg(F.sum("n").alias("n")), "values")
    total = {r.feature: r.t for r in counts.groupBy("feature").agg(F.sum("n").alias("t")).collect()}
    at = {c: [q * (total[c] - 1) for q in shares] for c in cols if c in total}
    wanted = {c: sorted({k for x in ps for k in (math.floor(x), math.ceil(x))}) for c, ps in at.items()}
    if not wanted:
        discard(counts)
        return {c: [None] * len(shares) for c in cols}
    ranks = prefix_sums(counts, "value", ["n"], ["feature"])
    place = F.create_map(*[x for c, ks in wanted.items() for x in (F.lit(c), F.array(*[F.lit(k) for k in ks]))])
    hit = F.exists(F.element_at(place, F.col("feature")), lambda k: (k >= F.col("before_n")) & (k < F.col("before_n") + F.col("n")))
    found = ranks.where(hit).collect()
    discard(counts)
    out: dict[str, list[float | None]] = {c: [None] * len(shares) for c in cols}
    for c, ps in at.items():
        value = {k: r.value for r in found if r.feature == c for k in wanted[c] if r.before_n <= k < r.before_n + r.n}
        out[c] = [value[math.floor(x)] if x == math.floor(x) else (math.ceil(x) - x) * value[math.floor(x)] + (x - math.floor(x)) * value[math.ceil(x)] for x in ps]
    return out


def group_quantiles(df: DataFrame, key: str, col: str, shares: dict[str, float]) -> DataFrame:
    """(key, a column per share): exact quantiles of each group, interpolated; null is a key like any other.

    Values are counted per group and range of values, so no task and no buffer holds a group; groups without values are
    left out.
    """
    present = df.where(F.col(col).isNotNull()).select(F.struct(F.col(key)).alias("__key"), F.col(col).cast("double").alias("value"))
    counts = present.groupBy("__key", "value").agg(F.count("*").alias("n"))
    total = counts.groupBy("__key").agg(F.sum("n").alias("__total"))
    ranks = prefix_sums(counts, "value", ["n"], ["__key"]).join(total, "__key")

    def at(place: Column) -> Column:
        """Value of that order statistic; other values don't count."""
        return F.max(F.when((F.col("before_n") <= place) & (place < F.col("before_n") + F.col("n")), F.col("value")))

    out = []
    for name, q in shares.items():
        place = F.lit(q) * (F.col("__total") - 1)
        low, high, part = at(F.floor(place)), at(F.ceil(place)), F.max(place - F.floor(place))
        out.append(F.when(part == 0, low).otherwise((1 - part) * low + part * high).alias(name))
    return ranks.groupBy("__key").agg(*out).select(F.col("__key")[key].alias(key), *[f"`{n}`" for n in shares])


def rankdata(df: DataFrame, col: str, out: str) -> DataFrame:
    """Average rank from 1; missing stays missing."""
    ranks = value_ranks(df, col).select("value", (F.col("before") + (F.col("n") + 1) / 2.0).alias(out))
    return df.join(ranks, F.col(col) == ranks["value"], "left").drop("value")


def percent_ranks(df: DataFrame, col: str, out: str) -> DataFrame:
    """Uniform quantile transformation: (rank of the first equal value - 1) / (n - 1)."""
    total = df.where(F.col(col).isNotNull()).count()
    ranks = value_ranks(df, col).select("value", (F.col("before") / F.lit(float(max(1, total - 1)))).alias(out))
    return df.join(ranks, F.col(col) == ranks["value"], "left").drop("value")


#: Rows of one value that are numbered in one task at most, unless their ties are equal too.
HOT_ROWS = 100_000


def row_ranks(df: DataFrame, col: str, tie: str, out: str) -> DataFrame:
    """Row number by value, ties by another column. Rows of a frequent value are numbered range by range of the tie."""
    ranks = value_ranks(df, col).select(F.col("value").alias("__value"), F.col("n").alias("__rows"), F.col("before").alias("__before"))
    joined = df.join(ranks, F.col(col) == ranks["__value"], "left")
    present = df.where(F.col(col).isNotNull())
    hot = present.groupBy(F.col(col).alias("__hot")).agg(F.count("*").alias("__n")).where(F.col("__n") > HOT_ROWS).select("__hot")
    part, shift = F.lit(0), F.lit(0)
    if not hot.isEmpty():
        at = range_of(F.col(tie), range_edges(df, tie))
        part, shift = F.when(F.col("__rows") > HOT_ROWS, at).otherwise(0), F.coalesce("__shift", F.lit(0))
        counts = present.join(hot, F.col(col) == F.col("__hot")).groupBy("__hot", at.alias("__at")).agg(F.count("*").alias("__c"))
        earlier = W.partitionBy("__hot").orderBy("__at")  # a row a range
        starts = counts.select("__hot", "__at", (F.sum("__c").over(earlier) - F.col("__c")).alias("__shift"))
        joined = joined.join(starts, (F.col("__value") == F.col("__hot")) & (part == F.col("__at")), "left")
    # rows without a value get no number and are spread
    spread = F.when(F.col("__value").isNull(), F.pmod(F.xxhash64(tie), F.lit(1 << 16)).cast("int")).otherwise(part)
    number = F.row_number().over(W.partitionBy("__value", "__part").orderBy(tie)) + F.col("__before") + shift
    return joined.withColumn("__part", spread).withColumn(out, F.when(F.col("__value").isNotNull(), number)).select(*[f"`{c}`" for c in df.columns], out)


def plotting_position(rank: Column, n: int) -> Column:
    return (rank - 0.4) / (n + 0.2)


def trim_tail(rank: Column, value: Column, n: int, share: float = 0.2) -> Column:
    """The lowest share of rows becomes missing."""
    return F.when(rank > int(share * n), value)


def inverse_normal(p: Column) -> Column:
    """Inverse of the standard normal distribution, per row in Arrow batches, as built-in functions lack it."""

    @F.pandas_udf("double")
    def inverse(x: pd.Series) -> pd.Series:
        from statistics import NormalDist

        return x.map(NormalDist().inv_cdf, na_action="ignore")

    return inverse(p)


def normal_scores(df: DataFrame, col: str, out: str) -> DataFrame:
    """Normal quantile transformation: the share of the mean rank among equal values, kept 1e-7 from 0 and 1, through the inverse normal distribution."""
    total = df.where(F.col(col).isNotNull()).count()
    share = (F.col("before") + (F.col("n") - 1) / 2.0) / F.lit(float(max(1, total - 1)))
    ranks = value_ranks(df, col).select("value", inverse_normal(F.least(F.greatest(share, F.lit(1e-7)), F.lit(1 - 1e-7))).alias(out))
    return df.join(ranks, F.col(col) == ranks["value"], "left").drop("value")


def histogram_density(df: DataFrame, col: str, out: str, factor: float = 1.2) -> DataFrame:
    """Shifted-histogram density: rows within h of a value over 2nh, h = factor * IQR / n^(1/5).

    Distinct values go to cells a little wider than h, each to its own cell and both neighbours, so what is within h
    of a value is in its cell, and the range window runs per cell.
    """
    n = df.where(F.col(col).isNotNull()).count()
    low, high = exact_quantiles(df, [col], [0.25, 0.75])[col]
    h = factor * ((high or 0.0) - (low or 0.0)) / max(1, n) ** 0.2
    values = df.where(F.col(col).isNotNull()).groupBy(F.col(col).cast("double").alias("value")).agg(F.count("*").alias("n"))
    if h > 0:
        cell = F.floor(F.col("value") / F.lit(1.001 * h))
        dealt = values.withColumn("cell", cell).withColumn("d", F.explode(F.array(F.lit(-1), F.lit(0), F.lit(1)))).withColumn("cell", F.col("cell") + F.col("d"))
        near = F.expr(f"sum(n) OVER (PARTITION BY cell ORDER BY value RANGE BETWEEN {h!r}D PRECEDING AND {h!r}D FOLLOWING)")
        values = dealt.withColumn("near", near).where("d = 0").select("value", F.col("near").alias("n"))
    dens = values.select("value", F.try_divide("n", F.lit(2.0 * n * h)).alias(out))
    return df.join(dens, F.col(col) == dens["value"], "left").drop("value")
