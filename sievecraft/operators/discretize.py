"""Supervised discretisation by entropy: all segments of a level are cut in one job over value counts."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.window import range_edges, range_of


def value_class_counts(df: DataFrame, col: str, label: str) -> DataFrame:
    """(v, n0, n1): rows of each value by binary class."""
    return df.where(F.col(col).isNotNull()).groupBy(F.col(col).cast("double").alias("v")).agg(F.sum((F.col(label) == 0).cast("long")).alias("n0"), F.sum((F.col(label) == 1).cast("long")).alias("n1"))


def _h(a: Column, b: Column) -> Column:
    """Entropy in bits of two counts."""
    n = a + b
    part = lambda x: F.when(x > 0, -(x / n) * F.log2(x / n)).otherwise(F.lit(0.0))
    return part(a) + part(b)


def cut_gains(counts: DataFrame, segment: Column) -> DataFrame:
    """(segment, cut, gain, accepted ..) for each midpoint between neighbouring values that mix classes.

    Accepted if gain > (log2(N - 1) + delta) / N with delta = log2(3^k) - k H + k1 H1 + k2 H2.
    """
    c = counts.withColumn("segment", segment).withColumn("part", range_of(F.col("v"), range_edges(counts, "v")))
    # sums and first value of each range of a segment; a window over these few rows carries them across ranges
    ranges = c.groupBy("segment", "part").agg(F.sum("n0").alias("s0"), F.sum("n1").alias("s1"), F.min(F.struct("v", "n0", "n1")).alias("first"))
    along, whole = W.partitionBy("segment").orderBy("part"), W.partitionBy("segment")
    ranges = ranges.select("segment", "part", (F.sum("s0").over(along) - F.col("s0")).alias("o0"), (F.sum("s1").over(along) - F.col("s1")).alias("o1"), F.sum("s0").over(whole).alias("t0"), F.sum("s1").over(whole).alias("t1"), F.lead("first").over(along).alias("then"))
    w = W.partitionBy("segment", "part").orderBy("v")
    run = c.withColumn("l0", F.sum("n0").over(w)).withColumn("l1", F.sum("n1").over(w)).withColumn("next", F.lead(F.struct("v", "n0", "n1")).over(w)).join(ranges, ["segment", "part"])
    run = run.withColumns({"l0": F.col("l0") + F.col("o0"), "l1": F.col("l1") + F.col("o1"), "next": F.coalesce("next", "then")})
    run = run.withColumns({"next_v": F.col("next.v"), "next0": F.col("next.n0"), "next1": F.col("next.n1")})
    mixes = ((F.col("n0") > 0) & (F.col("next1") > 0)) | ((F.col("n1") > 0) & (F.col("next0") > 0))
    x = run.where(F.col("next_v").isNotNull() & mixes)
    r0, r1 = F.col("t0") - F.col("l0"), F.col("t1") - F.col("l1")
    n, nl, nr = F.col("t0") + F.col("t1"), F.col("l0") + F.col("l1"), r0 + r1
    h, hl, hr = _h(F.col("t0"), F.col("t1")), _h(F.col("l0"), F.col("l1")), _h(r0, r1)
    k = lambda a, b: (a > 0).cast("int") + (b > 0).cast("int")
    kk, kl, kr = k(F.col("t0"), F.col("t1")), k(F.col("l0"), F.col("l1")), k(r0, r1)
    gain = h - (nl / n) * hl - (nr / n) * hr
    delta = F.log2(F.pow(F.lit(3.0), kk)) - (kk * h - kl * hl - kr * hr)
    return x.select("segment", ((F.col("v") + F.col("next_v")) / 2).alias("cut"), gain.alias("gain"), (gain > (F.log2(n - 1) + delta) / n).alias("accepted"))


def segment_of(v: Column, cuts: list[float]) -> Column:
    """Number of cuts at or below the value (right-open bins); missing stays missing."""
    return F.when(v.isNotNull(), reduce(lambda a, e: a + (v >= F.lit(e)).cast("int"), cuts, F.lit(0)))


def mdlp_cuts(df: DataFrame, col: str, label: str) -> list[float]:
    """All accepted cuts; each level cuts every open segment at its best gain. Cuts come to the driver, counts don't."""
    counts = value_class_counts(df, col, label).persist()
    cuts: list[float] = []
    try:
        while True:
            best = cut_gains(counts, segment_of(F.col("v"), cuts)).groupBy("segment").agg(F.max_by(F.struct("cut", "accepted"), F.struct("gain", -F.col("cut"))).alias("b"))
            # the midpoint of neighbouring floats can be a cut that exists
            new = {r.cut for r in best.where("b.accepted").select("b.cut").collect()} - set(cuts)
            if not new:
                break
            cuts = sorted([*cuts, *new])
    finally:
        counts.unpersist()
    return cuts


def best_cut(df: DataFrame, col: str, label: str) -> DataFrame:
    """One row: the cut of highest gain over the whole column."""
    return cut_gains(value_class_counts(df, col, label), F.lit(0)).orderBy(F.desc("gain"), "cut").limit(1).select("cut", "gain", "accepted")
