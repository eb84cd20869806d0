"""Selecting features from scores, masks and coverage."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.window import range_edges, range_of
from ..scratch import cut, discard


def select_k_best(scores: DataFrame, k: int) -> DataFrame:
    """The k features of highest score; ties by name."""
    return scores.orderBy(F.desc("score"), "feature").limit(k)


def select_fraction(scores: DataFrame, n_features: int, fraction: float) -> DataFrame:
    return select_k_best(scores, max(1, int(fraction * n_features)))


def weighted_ranking(rankings: list[DataFrame], weights: list[float]) -> DataFrame:
    """Each ranking scaled to 0..1 and divided by its sum, then added with weights. Windows run over features only."""
    w = W.partitionBy()
    parts = []
    for r, weight in zip(rankings, weights):
        lo, hi = F.min("score").over(w), F.max("score").over(w)
        scaled = r.select("feature", F.coalesce(F.try_divide(F.col("score") - lo, hi - lo), F.lit(0.0)).alias("s"))
        parts.append(scaled.select("feature", (F.lit(weight) * F.coalesce(F.try_divide("s", F.sum("s").over(w)), F.lit(0.0))).alias("score")))
    return reduce(DataFrame.unionByName, parts).groupBy("feature").agg(F.sum("score").alias("score"))


def top_per_group(scores: DataFrame, group: str, k: int = 1) -> DataFrame:
    """The k features of highest score in each group (for instance of one transformation); ties by name."""
    place = F.row_number().over(W.partitionBy(group).orderBy(F.desc("score"), "feature"))
    return scores.withColumn("place", place).where(F.col("place") <= k)


def agreement(masks: list[DataFrame]) -> DataFrame:
    """Features that every mask selects."""
    return reduce(DataFrame.intersect, [m.select("feature") for m in masks])


def all_masks(df: DataFrame, n: int, most: int) -> DataFrame:
    """(mask, size): every non-empty subset of n features (62 at most, as there are 2^n) with at most ``most``; bit i stands for feature i."""
    masks = df.sparkSession.range(1, 1 << n).select(F.col("id").alias("mask"), F.bit_count("id").cast("int").alias("size"))
    return masks.where(F.col("size") <= most)


def set_cover(covers: DataFrame, steps: int, weight: DataFrame | None = None) -> DataFrame:
    """Greedy cover of rows by features. covers: (feature, row_id). (step, feature, newly): with weights, least weight per newly covered row first.

    Each step counts uncovered rows per feature and keeps one row; what is covered leaves by an anti-join, whose result
    is written so that no step repeats those before it.
    """
    spark = covers.sparkSession
    left, out = covers, []
    for step in range(1, steps + 1):
        gain = left.groupBy("feature").agg(F.count("*").alias("newly"))
        if weight is not None:
            best = gain.join(weight, "feature").orderBy(F.col("weight") / F.col("newly"), "feature").first()
        else:
            best = gain.orderBy(F.desc("newly"), "feature").first()
        if best is None:
            break
        out.append((step, best.feature, best.newly))
        done = left.where(F.col("feature") == best.feature).select("row_id")
        if step < steps:
            before, left = left, cut(left.join(done, "row_id", "left_anti"), "uncovered")
            if step > 1:  # the first is the caller's
                discard(before)
    return spark.createDataFrame(out, "step int, feature string, newly long")


def pareto_front(df: DataFrame, id_col: str, maximise: list[str]) -> DataFrame:
    """Rows that no other row dominates: better in one column and no worse in any.

    Two columns: the best second value of each first value, against the running maximum over larger first values,
    range by range. More: every task drops what its own rows dominate, and what is left of all tasks decides.
    """
    if len(maximise) == 2:
        a, b = maximise
        best = df.groupBy(a).agg(F.max(b).alias("__b"))
        best = best.withColumn("__part", range_of(F.col(a), range_edges(best, a)))
        later = W.orderBy(F.desc("__part")).rowsBetween(W.unboundedPreceding, -1)  # one row per range
        ranges = best.groupBy("__part").agg(F.max("__b").alias("__m")).select("__part", F.max("__m").over(later).alias("__beyond"))
        above = F.max("__b").over(W.partitionBy("__part").orderBy(F.desc(a)).rowsBetween(W.unboundedPreceding, -1))
        keep = best.withColumn("__above", above).join(F.broadcast(ranges), "__part").withColumn("__above", F.greatest("__above", "__beyond"))
        keep = keep.where(F.col("__above").isNull() | (F.col("__b") > F.col("__above")))
        return df.join(keep.select(a, F.col("__b").alias(b)), [a, b])
    names = [f"__p{i}" for i in range(len(maximise))]
    value = [F.col(c).cast("double").alias(n) for c, n in zip(maximise, names)]
    points = df.select(*value)
    for n in names:  # what has no value can't be compared: it neither dominates nor is dominated
        points = points.where(F.col(n).isNotNull() & ~F.isnan(n))
    front = skyline(points.distinct(), names).withColumn("__front", F.lit(True))
    rows = df.withColumns({n: F.col(c).cast("double") for c, n in zip(maximise, names)})
    whole = reduce(lambda x, y: x & y, [F.col(n).isNotNull() & ~F.isnan(n) for n in names])
    out = rows.withColumn("__whole", whole).join(front, names, "left").where(F.col("__front") | F.coalesce(~F.col("__whole"), F.lit(True)))
    return out.select(*[f"`{c}`" for c in df.columns])


#: Most cells of the grid that a skyline is cut by.
CELLS = 4096


def skyline(points: DataFrame, axes: list[str]) -> DataFrame:
    """Of distinct points without missing values those that no other dominates.

    Tasks drop what their own points dominate. The others fall into the cells of a grid: a cell that lies below another
    one in all axes goes whole, and each point of the rest meets only points of cells that are nowhere below its own. A
    point is sent to the cells that it may dominate into, of which there are at most as many as share a row or column
    of the grid with it.
    """
    import numpy as np
    import pandas as pd

    from ..scratch import cut

    left = cut(points.mapInPandas(local_skyline(axes), points.schema), "skyline")
    most = max(2, int(CELLS ** (1 / len(axes))))
    sample = left.orderBy(F.xxhash64(*axes)).limit(64 * most).toPandas()  # decides the cost, not the result
    edges = [np.unique(np.quantile(sample[c], np.arange(1, most) / most, method="lower")) if len(sample) else np.zeros(0) for c in axes]

    def cells_of(x: np.ndarray) -> np.ndarray:
        return np.stack([np.searchsorted(e, x[:, j], side="left") for j, e in enumerate(edges)], axis=1)

    def seen(batches):
        for b in batches:
            if len(b):
                yield pd.DataFrame({"cell": [c.tolist() for c in np.unique(cells_of(b[axes].to_numpy()), axis=0)]})

    cells = np.array([r.cell for r in left.mapInPandas(seen, "cell array<int>").distinct().collect()]).reshape(-1, len(axes))
    alive = cells[[not (cells > c).all(axis=1).any() for c in cells]] if len(cells) else cells
    number = {tuple(c): i for i, c in enumerate(alive.tolist())}
    into = {i: np.flatnonzero((alive <= c).all(axis=1)) for i, c in enumerate(alive)}

    def send(batches):
        for b in batches:
            own = np.array([number.get(tuple(c), -1) for c in cells_of(b[axes].to_numpy()).tolist()], dtype=np.int64)
            for i in np.unique(own[own >= 0]):
                mine = b[own == i]
                for k in into[int(i)]:
                    yield mine.assign(cell=int(k), own=bool(k == i))

    def meet(g: pd.DataFrame) -> pd.DataFrame:
        v = g[axes].to_numpy()
        order = np.argsort(-v.sum(axis=1), kind="stable")
        v, own = v[order], g["own"].to_numpy()[order]
        total = v.sum(axis=1)
        lost = np.zeros(len(g), dtype=bool)
        for lo in range(0, len(v), 256):
            part = v[lo : lo + 256, None, :]
            # what dominates has no smaller sum, so only points up to the last of that sum do
            last = np.searchsorted(-total, -total[min(lo + 255, len(v) - 1)], side="right")
            for at in range(0, last, 8192):
                near = v[None, at : at + 8192]
                lost[lo : lo + 256] |= ((near >= part).all(axis=2) & (near > part).any(axis=2)).any(axis=1)
        return pd.DataFrame(v[own & ~lost], columns=axes)

    kind = ", ".join(f"`{c}` double" for c in axes)
    return left.mapInPandas(send, f"{kind}, cell long, own boolean").groupBy("cell").applyInPandas(meet, kind)


def local_skyline(maximise: list[str], block: int = 1000):
    """mapInPandas function: the points of a task that none of its own points dominates; blocks meet the skyline so far."""
    import numpy as np
    import pandas as pd

    def run(batches):
        best = None
        for b in batches:
            for at in range(0, len(b), block):
                x = b.iloc[at : at + block]
                x = x if best is None else pd.concat([best, x], ignore_index=True)
                v = x[maximise].to_numpy(dtype=float)
                lost = np.zeros(len(v), dtype=bool)
                for lo in range(0, len(v), 256):
                    part = v[lo : lo + 256, None, :]
                    lost[lo : lo + 256] = ((v[None] >= part).all(axis=2) & (v[None] > part).any(axis=2)).any(axis=1)
                best = x[~lost]
        if best is not None:
            yield best

    return run


def nearest(points: DataFrame, anchors: DataFrame | None, features: list[str], id_col: str, k: int) -> DataFrame:
    """(anchor, id, dist, rank): the k nearest other rows of each anchor; without anchors, of every row."""
    from .neighbours import nearest_rows

    return nearest_rows(points, features, id_col, k, anchors)
