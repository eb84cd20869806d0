"""Numeric feature transformations as column expressions.

Missing is NULL: NaN and infinities are normalised on the way in, and expressions outside their domain give NULL.
``fit_*`` functions read one aggregate row of the training part and return expressions with its numbers inside, so a
fitted transformation costs no join.
"""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .window import exact_quantiles

INF = float("inf")


def clean(c: Column) -> Column:
    """NaN and infinities become NULL."""
    return F.when(F.isnan(c) | (F.abs(c) == INF), None).otherwise(c)


def filled(c: Column, value: float = -1.0) -> Column:
    """The legacy option: missing becomes -1 before a transformation."""
    return F.coalesce(clean(c), F.lit(value))


UNARY = {
    "square": lambda c: c * c,
    "pow3": lambda c: c * c * c,
    "sqrt": lambda c: F.when(c >= 0, F.sqrt(c)),
    "abs": F.abs,
    "rint": F.rint,
    "minus": lambda c: -c,
    "one_div": lambda c: F.try_divide(F.lit(1.0), c),
    "log": lambda c: F.when(c > 0, F.ln(c)),
    "exp": F.exp,
    "cos": F.cos,
    "sin": F.sin,
    "tan": F.tan,
    "cosh": F.cosh,
    "sinh": F.sinh,
    "tanh": F.tanh,
    "degrees": F.degrees,
    "radians": F.radians,
    "sigmoid": lambda c: F.lit(1.0) / (F.lit(1.0) + F.exp(-c)),
    "binarize": lambda c: F.when(c > 0, 1.0).otherwise(0.0),
    "log_clamped": lambda c: F.ln(F.when(c.isNull() | (c <= 0), 1e-6).otherwise(c)),
    "sqrt_filled": lambda c: F.when(c.isNull() | (c < 0), -1.0).otherwise(F.sqrt(F.abs(c))),
    "to_int": lambda c: c.cast("long"),
}

BINARY = {
    "divide": F.try_divide,
    "subtract": lambda a, b: a - b,
    "power": lambda a, b: clean(F.pow(a, b)),
    "add": lambda a, b: a + b,
}


def n_ary(op: str, cols: list[Column], skip_missing: bool = False) -> Column:
    """sum, prod, max or min over columns of a row; missing makes it missing unless skipped."""
    neutral = {"sum": 0.0, "prod": 1.0}
    if op in neutral:
        parts = [F.coalesce(c, F.lit(neutral[op])) if skip_missing else c for c in cols]
        return reduce((lambda a, b: a + b) if op == "sum" else (lambda a, b: a * b), parts)
    out = (F.greatest if op == "max" else F.least)(*cols)
    return out if skip_missing else F.when(reduce(lambda a, b: a & b, [c.isNotNull() for c in cols]), out)


def fit_minmax(train: DataFrame, cols: list[str]) -> dict[str, Column]:
    """(x - min) / (max - min); a constant column becomes 0."""
    row = train.agg(*[f(c).alias(f"{n}_{c}") for c in cols for n, f in (("lo", F.min), ("hi", F.max))]).first()
    out = {}
    for c in cols:
        lo, hi = row[f"lo_{c}"], row[f"hi_{c}"]
        width = None if lo is None else hi - lo
        out[c] = F.when(F.col(c).isNotNull(), F.lit(0.0)) if not width else (F.col(c) - F.lit(lo)) / F.lit(width)
    return out


def fit_standard(train: DataFrame, cols: list[str]) -> dict[str, Column]:
    """(x - mean) / population deviation; a constant column becomes 0."""
    row = train.agg(*[f(c).alias(f"{n}_{c}") for c in cols for n, f in (("m", F.avg), ("s", F.stddev_pop))]).first()
    return {c: (F.col(c) - F.lit(row[f"m_{c}"])) / F.lit(row[f"s_{c}"]) if row[f"s_{c}"] else F.col(c) * 0.0 for c in cols}


def fit_robust(train: DataFrame, cols: list[str], low: float = 0.25, high: float = 0.75) -> dict[str, Column]:
    """(x - median) / (upper - lower quantile)."""
    row = exact_quantiles(train, cols, [low, 0.5, high])
    return {c: F.try_divide(F.col(c) - F.lit(row[c][1]), F.lit(row[c][2] - row[c][0])) for c in cols}


def fit_impute(train: DataFrame, cols: list[str], how: str = "mean") -> dict[str, Column]:
    """Missing becomes the training mean, median or most frequent value (the smallest of ties)."""
    if how == "most_frequent":
        values = {c: (train.where(F.col(c).isNotNull()).groupBy(c).count().orderBy(F.desc("count"), c).first() or [None])[0] for c in cols}
    elif how == "median":
        values = {c: q[0] for c, q in exact_quantiles(train.select(*[clean(F.col(c)).alias(c) for c in cols]), cols, [0.5]).items()}
    else:
        row = train.agg(*[F.avg(clean(F.col(c))).alias(c) for c in cols]).first()
        values = {c: row[c] for c in cols}
    return {c: F.coalesce(clean(F.col(c)) if how != "most_frequent" else F.col(c), F.lit(values[c])) for c in cols}


def fit_one_hot(train: DataFrame, col: str, most: int = 1000) -> dict[str, Column]:
    """A 0/1 column per distinct training value; unseen values have zeros. Columns beyond ``most`` values are refused."""
    values = sorted(r[0] for r in train.select(col).where(F.col(col).isNotNull()).distinct().limit(most + 1).collect())
    if len(values) > most:
        raise ValueError(f"{col} has more than {most} values")
    return {f"{col}={v}": F.coalesce((F.col(col) == F.lit(v)).cast("int"), F.lit(0)) for v in values}


def bins(c: Column, edges: list[float]) -> Column:
    """Number of the right-closed bin between ascending edges; -1 outside or missing."""
    inside = reduce(lambda a, e: a + (c > F.lit(e)).cast("int"), edges[1:-1], F.lit(0))
    return F.when(c.isNotNull() & (c > F.lit(edges[0])) & (c <= F.lit(edges[-1])), inside).otherwise(-1)


def fit_equi_width(train: DataFrame, cols: list[str], n: int = 10) -> dict[str, Column]:
    """n bins of equal width; the lowest edge is widened by 0.1 % of the range."""
    row = train.agg(*[f(c).alias(f"{k}_{c}") for c in cols for k, f in (("lo", F.min), ("hi", F.max))]).first()
    out = {}
    for c in cols:
        lo, hi = float(row[f"lo_{c}"]), float(row[f"hi_{c}"])
        edges = [lo + (hi - lo) * i / n for i in range(n + 1)]
        edges[0] -= 0.001 * (hi - lo)
        out[c] = bins(F.col(c), edges)
    return out


def fit_quantile_bins(train: DataFrame, cols: list[str], n: int = 10) -> dict[str, Column]:
    """Bins between exact quantiles; equal edges are merged, the lowest value belongs to the first bin."""
    row = exact_quantiles(train, cols, [i / n for i in range(n + 1)])
    out = {}
    for c in cols:
        edges = sorted(set(row[c]))
        out[c] = bins(F.col(c), [math.nextafter(edges[0], -INF), *edges[1:]])
    return out


def fit_winsorize(train: DataFrame, col: str, low: float = 0.0, high: float = 0.0) -> Column:
    """Clamp to the order statistics that cut the given shares; without shares nothing changes."""
    if not low and not high:
        return F.col(col)
    lo, hi = exact_quantiles(train, [col], [low, 1 - high])[col]
    return F.when(F.col(col).isNotNull(), F.least(F.greatest(F.col(col), F.lit(lo)), F.lit(hi)))


def polynomial(cols: list[str], degree: int = 2, interaction_only: bool = False, bias: bool = True) -> dict[str, Column]:
    """All products of up to ``degree`` columns."""
    from itertools import combinations, combinations_with_replacement

    pick = combinations if interaction_only else combinations_with_replacement
    out = {"1": F.lit(1.0)} if bias else {}
    for d in range(1, degree + 1):
        for names in pick(cols, d):
            out["*".join(names)] = reduce(lambda a, b: a * b, [F.col(c) for c in names])
    return out


def row_norm(cols: list[str]) -> dict[str, Column]:
    """Columns divided by the row's Euclidean norm; a zero row stays."""
    norm = F.sqrt(reduce(lambda a, b: a + b, [F.col(c) * F.col(c) for c in cols]))
    return {c: F.when(norm > 0, F.col(c) / norm).otherwise(F.lit(0.0)) for c in cols}


def lat_lon_to_xyz(lat: Column, lon: Column, radius: float = 6371.230) -> dict[str, Column]:
    """Kilometres on a sphere."""
    a, b = F.radians(lat), F.radians(lon)
    return {"x": F.lit(radius) * F.cos(a) * F.cos(b), "y": F.lit(radius) * F.cos(a) * F.sin(b), "z": F.lit(radius) * F.sin(a)}
