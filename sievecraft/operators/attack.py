"""Robustness by an attack on the decision boundary, for any model that predicts rows of numbers.

From each row a walk starts at the nearest row of a pool that the model predicts otherwise, goes to the boundary between both
by bisection, and then along it: a step at a right angle, drawn at random, and a little nearer to the row, kept if the
prediction is still another. All rows of a batch are asked together; a row costs ``queries`` predictions.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .boosting import _spread


def normals(ids: np.ndarray, dims: int, seed: int, turn: int) -> np.ndarray:
    """Normal numbers, rows x dims, that depend on row id, seed and turn only."""
    u = [np.stack([_spread(ids, ((seed * 1009 + turn) * 4099 + j) * 2 + side) for j in range(dims)], axis=1) for side in (0, 1)]
    return np.sqrt(-2 * np.log(np.maximum(u[0], 1e-300))) * np.cos(2 * np.pi * u[1])


def boundary_points(x: np.ndarray, ids: np.ndarray, pool: np.ndarray, predict: Callable[[np.ndarray], np.ndarray], width: np.ndarray, queries: int = 10, seed: int = 7) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(points, distances, whether any) of another prediction near each row; distances in units of ``width``. Half of the queries bisect, the others walk."""
    base, other = predict(x), predict(pool)
    apart = (((x[:, None] - pool[None]) / width) ** 2).sum(axis=2)
    apart[base[:, None] == other[None]] = np.inf
    found = np.isfinite(apart).any(axis=1) if len(pool) else np.zeros(len(x), dtype=bool)
    best = np.where(found[:, None], pool[apart.argmin(axis=1)], x) if len(pool) else x.copy()
    low = x.copy()
    for _ in range(queries // 2):
        middle = (low + best) / 2
        turned = predict(middle) != base
        best, low = np.where(turned[:, None], middle, best), np.where(turned[:, None], low, middle)
    for turn in range(queries - queries // 2):
        way = (best - x) / width
        far = np.sqrt((way**2).sum(axis=1, keepdims=True))
        unit = np.divide(way, far, out=np.zeros_like(way), where=far > 0)
        side = normals(ids, x.shape[1], seed, turn)
        side -= (side * unit).sum(axis=1, keepdims=True) * unit
        size = np.sqrt((side**2).sum(axis=1, keepdims=True))
        step = way + 0.3 * far * np.divide(side, size, out=np.zeros_like(side), where=size > 0)
        size = np.sqrt((step**2).sum(axis=1, keepdims=True))
        tried = x + width * np.divide(step, size, out=np.zeros_like(step), where=size > 0) * far * 0.9
        best = np.where((predict(tried) != base)[:, None], tried, best)
    return best, np.sqrt((((best - x) / width) ** 2).sum(axis=1)), found


def boundary_attack(df: DataFrame, features: list[str], label: str, row_id: str, predict: Callable[[np.ndarray], np.ndarray], labels: list, scale: dict[str, float], pool_rows: int = 256, queries: int = 10, seed: int = 7) -> DataFrame:
    """One row: rows, clean and attacked accuracy, safety = 1 - their difference, mean distance of the attacked rows.

    predict: places in ``labels`` of rows of ``features``. The pool are ``pool_rows`` rows of the table by a hash of the id: where
    walks may start, not what is measured; every row is attacked. Rows with a missing feature are left out.
    """
    rows = df.select(F.xxhash64(row_id).alias("__id"), F.col(label).alias("__y"), *[F.col(f).cast("double").alias(f) for f in features]).dropna(subset=features)
    rows = rows.where(~F.exists(F.array(*features), F.isnan))
    pool = rows.orderBy("__id").limit(pool_rows).toPandas()[features].to_numpy(dtype=float)
    width = np.array([scale[f] or 1.0 for f in features])
    known = np.array(labels)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        n = clean = attacked = turned = 0
        total = 0.0
        for b in batches:
            for at in range(0, len(b), 2048):
                part = b.iloc[at : at + 2048]
                x, y = part[features].to_numpy(dtype=float), part["__y"].to_numpy()
                points, far, found = boundary_points(x, part["__id"].to_numpy(), pool, predict, width, queries, seed)
                n += len(x)
                clean += int((known[predict(x)] == y).sum())
                attacked += int((known[predict(points)] == y).sum())
                turned += int(found.sum())
                total += float(far[found].sum())
        yield pd.DataFrame({"n": [n], "clean": [clean], "attacked": [attacked], "turned": [turned], "total": [total]})

    s = rows.mapInPandas(run, "n long, clean long, attacked long, turned long, total double").agg(*[F.sum(c).alias(c) for c in ("n", "clean", "attacked", "turned", "total")])
    return s.select(F.col("n").alias("rows"), F.try_divide("clean", "n").alias("clean"), F.try_divide("attacked", "n").alias("attacked"), (1 - F.try_divide(F.col("clean") - F.col("attacked"), F.col("n"))).alias("safety"), F.try_divide("total", "turned").alias("distance"))
