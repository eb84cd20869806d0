"""Construction searches whose frontier is a table.

A round takes the best open nodes of the frontier, expands them, keeps forms that are new by their prints, scores these in
chunks of bounded columns and appends them. Children of one node stand in one chunk, so that what they share is computed
once. Tasks read the features and compute known operators on arrays; a chunk with any other is computed by Spark. Rows with
equal features and label are one row with their number. The driver holds a chunk's expressions, the nodes that were expanded
and the scores of a round, never the frontier.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import NamedTuple

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F

from ..scratch import ROWS, counted, cut, discard
from . import forms as fm
from .mask_models import BLOCK, array_sums, places

#: Candidates that are scored together.
CHUNK = 128
#: The same where tasks compute them from the features.
ARRAY_CHUNK = 512


def _divide(a, b) -> np.ndarray:
    return np.where(b != 0, a / b, np.nan)


def ln(x: np.ndarray) -> np.ndarray:
    """Logarithms to the last bit as Spark's ``ln`` has them (fdlibm's); numpy's depend on the processor, which moves values at an edge of bins. NaN where x isn't positive."""
    m, k = np.frexp(np.where(x > 0, x, np.nan))
    high = (m.view(np.int64) >> 32) & 0xFFFFF
    upper = high + 0x95F64 > 0xFFFFF  # m from sqrt(2) / 2 on
    m, k = np.where(upper, m, m * 2), np.where(upper, k, k - 1).astype(float)
    f = m - 1
    s = f / (2 + f)
    z = s * s
    w = z * z
    r = z * (0.6666666666666735130 + w * (0.2857142874366239149 + w * (0.1818357216161805012 + w * 0.1479819860511658591))) + w * (0.3999999999940941908 + w * (0.2222219843214978396 + w * 0.1531383769920937332))
    half = 0.5 * f * f
    low = k * 1.90821492927058770002e-10
    middle = ((high - 0x6147A) | (0x6B851 - high)) > 0
    tail = np.where(middle, half - (s * (half + r) + low), s * (f - r) - low)
    close = f * f * (0.5 - 0.33333333333333333 * f) - low
    out = k * 6.93147180369123816490e-01 - (np.where(np.abs(f) < 2.0**-20, close, tail) - f)
    return np.where(x == np.inf, np.inf, out)


#: Operators on arrays of doubles in which what is missing is NaN, by their template.
ARRAYS: dict[str, Callable[..., np.ndarray]] = {
    "(-{0})": np.negative,
    "({0} * {0})": np.square,
    "ln({0})": ln,
    "try_divide(1D, {0})": lambda a: _divide(1.0, a),
    "({0} + {1})": np.add,
    "({0} - {1})": np.subtract,
    "({0} * {1})": np.multiply,
    "try_divide({0}, {1})": _divide,
}


class Step(NamedTuple):
    """How a form comes from its parents; a raw feature has none."""

    key: str
    template: str
    parents: tuple[str, ...]


def array_steps(held: list[Step], known: dict[str, Step], df: DataFrame) -> list[Step] | None:
    """``held`` after the expanded nodes that they come from; none if Spark has to compute any of them."""
    out: dict[str, Step] = {}
    types = dict(df.dtypes)

    def add(step: Step) -> None:
        for p in step.parents:
            if p not in out and p in known:
                add(known[p])
        out[step.key] = step

    for step in held:
        add(step)
    if len({x.key for x in held}) == len(held) and all(p in out for x in out.values() for p in x.parents) and all(types.get(x.key) == "double" if not x.parents else x.template in ARRAYS for x in out.values()):
        return list(out.values())


def values(b: pd.DataFrame, steps: list[Step], wanted: dict[str, int]) -> Iterator[tuple[int, np.ndarray]]:
    """(place, array) of each form that is wanted."""
    inner, kept = {p for x in steps for p in x.parents}, {}
    for x in steps:
        v = ARRAYS[x.template](*[kept[p] for p in x.parents]) if x.parents else b[x.key].to_numpy(dtype=float)
        if x.key in inner:
            kept[x.key] = v
        if x.key in wanted:
            yield wanted[x.key], v


def classes(df: DataFrame, label: str) -> list:
    return sorted(r[0] for r in df.select(label).where(F.col(label).isNotNull()).distinct().collect())


def mutual_informations(df: DataFrame, exprs: list[str], label: str, labels: list, bins: int = 10, keys: list[str] | None = None, steps: list[Step] | None = None) -> list[float]:
    """Mutual information in bits of the label and each expression's equal-width bins; missing and infinite values are a bin of their own.

    Two passes over the rows: ranges, then counts per bin and class, added up in tasks. ``df`` may be what ``counted`` makes.
    With ``steps``, whose forms ``keys`` are the expressions, rows come to the tasks as their features only.
    """
    size = len(exprs)
    cols = [f"c{i}" for i in range(size)]
    of = [F.col(label).alias("__y"), (F.col(ROWS) if ROWS in df.columns else F.lit(1)).alias("__w")]
    if steps is None:
        table = df.select(*of, *[F.expr(e).cast("double").alias(c) for c, e in zip(cols, exprs)])
        each = lambda b: ((i, b[c].to_numpy(dtype=float)) for i, c in enumerate(cols))
    else:
        raw = {x.key: f"r{i}" for i, x in enumerate(x for x in steps if not x.parents)}
        table = df.select(*of, *[F.col(f"`{f}`").alias(c) for f, c in raw.items()])
        named = [Step(raw.get(x.key, x.key), x.template, tuple(raw.get(p, p) for p in x.parents)) for x in steps]
        place = {raw.get(x, x): i for i, x in enumerate(keys)}
        each = lambda b: values(b, named, place)

    def blocks(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for at in range(0, len(b), BLOCK):
                yield b.iloc[at : at + BLOCK]

    def ranges(batches: Iterator[pd.DataFrame]) -> dict[int, np.ndarray]:
        # lowest, negative highest, -1 where values are missing
        out = np.vstack([np.full((2, size), np.inf), np.zeros((1, size))])
        with np.errstate(all="ignore"):
            for b in blocks(batches):
                for i, x in each(b):
                    low, high = x.min(), x.max()
                    if not (np.isfinite(low) and np.isfinite(high)):
                        out[2, i], x = -1, x[np.isfinite(x)]
                        if not len(x):
                            continue
                        low, high = x.min(), x.max()
                    out[0, i], out[1, i] = min(out[0, i], low), min(out[1, i], -high)
        return {0: out.reshape(-1)}

    found = array_sums(table, ranges, np.minimum).get(0, np.zeros(3 * size)).reshape(3, size)
    low, high, holes = found[0], -found[1], found[2] < 0
    low, high = np.where(np.isfinite(low), low, 0.0), np.where(np.isfinite(high), high, 0.0)
    width = np.where(high > low, (high - low) / bins, 1.0)
    k, m = len(labels), bins + 1

    def partial(batches: Iterator[pd.DataFrame]) -> dict[int, np.ndarray]:
        out = np.zeros((size, m * (k + 1)))
        with np.errstate(all="ignore"):
            for b in blocks(batches):
                n, label_at = b["__w"].to_numpy(dtype=float), places(labels, b["__y"])
                for i, x in each(b):
                    bin_of = np.clip(np.floor((x - low[i]) / width[i]), 0, bins - 1)
                    if holes[i]:
                        bin_of = np.where(np.isfinite(x), bin_of, bins)
                    out[i] += np.bincount(bin_of.astype(np.int64) * (k + 1) + label_at, n, m * (k + 1))
        return {0: out.reshape(-1)}

    got = array_sums(table, partial)
    if not got:
        return [0.0] * size
    counts = got[0].reshape(size, m, k + 1)
    entropy = lambda n: np.log2(n.sum()) - (n[n > 0] * np.log2(n[n > 0])).sum() / n.sum() if n.sum() else 0.0
    return [float(entropy(c.sum(axis=1)) + entropy(c.sum(axis=0)) - entropy(c.reshape(-1))) for c in counts]


def score_forms(df: DataFrame, forms: DataFrame, label: str, bins: int = 10, chunk: int | None = None, labels: list | None = None, ops: tuple[dict[str, str], dict[str, str]] | None = None, known: dict[str, Step] | None = None) -> DataFrame:
    """``forms`` with score; a chunk of expressions at a time. With ``ops`` and the expanded nodes in ``known``, tasks compute them from the features."""
    spark, scores, held, steps = df.sparkSession, [], [], []
    labels = labels or classes(df, label)
    arrays = ops is not None and all(t in ARRAYS for o in ops for t in o.values())
    chunk = chunk or (ARRAY_CHUNK if arrays else CHUNK)

    def flush() -> None:
        if held:
            found = array_steps(steps, known or {}, df) if arrays else None
            more = [[r.key for r in held], found] if found else []
            scores.extend((r.key, s) for r, s in zip(held, mutual_informations(df, [r.expr for r in held], label, labels, bins, *more)))
            held.clear()
            steps.clear()

    for r in forms.select("key", "op", "expr", "parents").orderBy("parents", "key").toLocalIterator():
        held.append(r)
        steps.append(step_of(r, ops) if arrays else None)
        if len(held) == chunk:
            flush()
    flush()
    return forms.join(spark.createDataFrame(scores, "key string, score double"), "key")


def step_of(r: Row, ops: tuple[dict[str, str], dict[str, str]]) -> Step:
    return Step(r.key, ops[len(r.parents) - 1][r.op] if r.parents else "", tuple(r.parents))


def expand(df: DataFrame, features: list[str], label: str, unary: dict[str, str], binary: dict[str, str], how: str = "best", rounds: int = 200, width: int = 1, bins: int = 10) -> DataFrame:
    """(key, op, complexity, score, step): all forms that ``rounds`` expansions of ``width`` nodes at a time reach, raw features at step 0.

    how: best takes open nodes by score, depth the latest first, harmonic by the harmonic mean of score and simplicity. A
    node is expanded by all unary operators and by all binary ones with every raw feature.
    """
    spark, df = df.sparkSession, counted(df.select(*[f"`{f}`" for f in features], f"`{label}`"))
    labels = classes(df, label)
    names = [f.split()[0] for f in fm.SCHEMA.split(", ")]
    keep = [*names, "score", "step"]
    ops, known = (unary, binary), {f: Step(f, "", ()) for f in features}
    save = lambda forms, step: cut(score_forms(df, forms, label, bins, labels=labels, ops=ops, known=known).withColumn("step", F.lit(step)).select(*keep), "frontier")
    parts, done = [save(fm.raw_forms(spark, features), 0)], []
    read = lambda dfs: spark.read.schema(dfs[0].schema).parquet(*[d._scratch_path for d in dfs])
    for step in range(1, rounds + 1):
        nodes = read(parts)
        open_nodes = nodes.join(read(done).select("key"), "key", "left_anti") if done else nodes
        if how == "harmonic":
            top = nodes.agg(F.max("score")).first()[0] or 1.0
            good, simple = F.col("score") / F.lit(top), 1.0 / F.col("complexity")
            order = [F.desc(2 * good * simple / (good + simple))]
        else:
            order = [F.desc("step"), F.desc("score")] if how == "depth" else [F.desc("score")]
        # of equal scores the less complex node, then the first key
        chosen = cut(open_nodes.withColumn("score", F.round("score", 9)).orderBy(*order, "complexity", "key").limit(width), "expanded")
        rows = chosen.select("key", "op", "parents").collect()
        if not rows:
            break
        known |= {r.key: step_of(r, ops) for r in rows}
        done.append(chosen)
        made = fm.unary_forms(chosen.select(*names), unary).unionByName(fm.binary_forms(chosen.select(*names), features, binary))
        new = cut(fm.new_forms(made, nodes), "forms")
        if not new.isEmpty():
            parts.append(save(new, step))
        discard(new)
    discard(df)
    return read(parts).select("key", "op", "complexity", "score", "step")
