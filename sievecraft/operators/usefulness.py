"""Which transformations help which columns, learned from metafeatures with few labels.

An example is a (column, target, operator): is the target told better by the transformed column than by the raw one? To know
takes a pass over the table; metafeatures are aggregates for all columns at once. A classifier is trained on examples whose
label is known and asks, round by round, for the labels it is least sure of.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..scratch import ROWS, counted, cut, discard
from .mask_models import array_sums

#: What is known of a column and target without trying a transformation.
META = ["mean", "std", "skew", "kurtosis", "lowest", "highest", "zeros", "negative", "correlation", "positives"]


def _correlations(df: DataFrame, values: list[Column], targets: list[str]) -> np.ndarray:
    """Absolute correlation of each value with each target (values x targets), 0 where either is constant; missing and infinite values are left out.

    One pass: the sums of all pairs are products of matrices in the tasks. ``df`` may be what ``counted`` makes.
    """
    finite = [F.when(F.abs(v) < F.lit(float("inf")), v).alias(f"v{i}") for i, v in enumerate(values)]
    table = df.select((F.col(ROWS) if ROWS in df.columns else F.lit(1)).alias("w"), *finite, *[F.col(t).cast("double").alias(f"t{j}") for j, t in enumerate(targets)])
    vs, ts = [f"v{i}" for i in range(len(values))], [f"t{j}" for j in range(len(targets))]

    def partial(batches: Iterator[pd.DataFrame]) -> dict[int, np.ndarray]:
        out = np.zeros((6, len(vs), len(ts)))
        for b in batches:
            x, y = b[vs].to_numpy(dtype=float), b[ts].to_numpy(dtype=float)
            m, k = (~np.isnan(x)).astype(float), (~np.isnan(y)).astype(float)
            x, y = np.nan_to_num(x), np.nan_to_num(y)
            w = b["w"].to_numpy(dtype=float)[:, None]
            k, wy = k * w, y * w
            out += np.stack([m.T @ k, x.T @ k, (x * x).T @ k, m.T @ wy, m.T @ (y * wy), x.T @ wy])
        return {0: out.reshape(-1)}

    got = array_sums(table, partial)
    if not got:
        return np.zeros((len(vs), len(ts)))
    n, sx, sxx, sy, syy, sxy = got[0].reshape(6, len(vs), len(ts))
    n = np.maximum(n, 1)
    vx, vy = sxx / n - (sx / n) ** 2, syy / n - (sy / n) ** 2
    varies = (vx > 1e-12 * np.maximum(sxx / n, 1e-300)) & (vy > 1e-12)
    return np.where(varies, np.abs(sxy / n - sx / n * sy / n) / np.sqrt(np.where(varies, vx * vy, 1.0)), 0.0)


def metafeatures(df: DataFrame, columns: list[str], targets: list[str]) -> DataFrame:
    """(column, target, the META columns): two passes for all of them; targets are columns of 0 and 1."""
    x = lambda c: F.col(c).cast("double")
    per = {"mean": lambda c: F.avg(x(c)), "std": lambda c: F.stddev_pop(x(c)), "skew": lambda c: F.skewness(x(c)), "kurtosis": lambda c: F.kurtosis(x(c)), "lowest": lambda c: F.min(x(c)), "highest": lambda c: F.max(x(c)), "zeros": lambda c: F.avg((x(c) == 0).cast("int")), "negative": lambda c: F.avg((x(c) < 0).cast("int"))}
    row = df.agg(*[f(c).alias(f"{n}_{i}") for i, c in enumerate(columns) for n, f in per.items()], *[F.avg(x(t)).alias(f"positives_{j}") for j, t in enumerate(targets)]).first()
    found = _correlations(df, [x(c) for c in columns], targets)
    sound = lambda v: float(v) if v is not None and np.isfinite(v) else 0.0
    rows = [(c, t, *[sound(row[f"{n}_{i}"]) for n in per], float(found[i, j]), sound(row[f"positives_{j}"])) for i, c in enumerate(columns) for j, t in enumerate(targets)]
    return df.sparkSession.createDataFrame(rows, "column string, target string, " + ", ".join(f"{m} double" for m in META))


def gains(df: DataFrame, columns: list[str], targets: list[str], ops: dict[str, str]) -> DataFrame:
    """(column, target, op, gain): absolute correlation with the target after the operator less before; one pass for all."""
    value = lambda c, t: F.expr(t.replace("{0}", f"CAST(`{c}` AS DOUBLE)"))
    found = _correlations(df, [value(c, t) for c in columns for t in ("{0}", *ops.values())], targets).reshape(len(columns), 1 + len(ops), len(targets))
    rows = [(c, t, o, float(found[i, k + 1, j] - found[i, 0, j])) for i, c in enumerate(columns) for k, o in enumerate(ops) for j, t in enumerate(targets)]
    return df.sparkSession.createDataFrame(rows, "column string, target string, op string, gain double")


def examples(df: DataFrame, columns: list[str], targets: list[str], ops: dict[str, str], least: float = 1e-6) -> DataFrame:
    """(column, target, op, META, useful): whether an operator's gain is above ``least``.

    Gains are taken of different rows with their number, and metafeatures, which are aggregates, of the table.
    """
    few = counted(df.select(*[f"`{c}`" for c in dict.fromkeys([*columns, *targets])]))
    return metafeatures(df, columns, targets).join(gains(few, columns, targets, ops), ["column", "target"]).withColumn("useful", (F.col("gain") > least).cast("int"))


def active_rounds(pool: DataFrame, held: DataFrame, ops: list[str], rounds: int = 5, batch: int = 10, first: int = 20, seed: int = 7, label: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """(round, labelled, accuracy, majority): accuracy on the ``held`` examples after each round of labels, and of the more frequent answer.

    A round trains a forest on the labelled examples and labels the ``batch`` of the pool whose probability is nearest to a
    half. ``label`` adds useful to examples; without it the pool has the column already. Starts with ``first`` of the pool by hash.
    """
    from pyspark.ml.classification import RandomForestClassifier
    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.functions import vector_to_array

    label = label or (lambda asked: asked)
    inputs = [*META, *[f"op_{i}" for i in range(len(ops))]]
    encode = lambda df: VectorAssembler(inputCols=inputs, outputCol="features").transform(df.withColumns({f"op_{i}": (F.col("op") == o).cast("double") for i, o in enumerate(ops)}))
    key = ["column", "target", "op"]
    held = cut(held, "held")
    order = pool.withColumn("__h", F.xxhash64(*key, F.lit(seed))).orderBy("__h", *key).drop("__h")
    known = cut(label(order.limit(first)), "known")
    majority = held.agg(F.avg("useful")).first()[0] or 0.0
    out, spark = [], pool.sparkSession
    for step in range(rounds):
        if known.select("useful").distinct().count() < 2:
            more = known.select("useful").first()
            hit = held.agg(F.avg((F.col("useful") == (more[0] if more else 0)).cast("int"))).first()[0]
            guess = F.lit(0.5)
            score = lambda df: df.withColumn("__p", guess)
        else:
            model = RandomForestClassifier(labelCol="useful", featuresCol="features", numTrees=30, maxDepth=6, seed=seed).fit(encode(known))
            score = lambda df, m=model: m.transform(encode(df)).withColumn("__p", vector_to_array("probability")[1])
            hit = score(held).agg(F.avg(((F.col("__p") > 0.5).cast("int") == F.col("useful")).cast("int"))).first()[0]
        out.append((step, known.count(), float(hit or 0.0), float(max(majority, 1 - majority))))
        asked = score(pool.join(known.select(*key), key, "left_anti")).orderBy(F.abs(F.col("__p") - 0.5), *key).limit(batch).select(*pool.columns)
        before, known = known, cut(known.unionByName(label(asked).select(*known.columns)), "known")
        discard(before)
    return spark.createDataFrame(out, "round int, labelled long, accuracy double, majority double")
