"""A user's own operators: transformations with fit, applicability and derived properties, numpy functions, group aggregates."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .categorical import AGGREGATES


@dataclass(frozen=True)
class Transformation:
    """fit: (training table, columns) -> expression per column; applicable: whether a column's properties allow it; derive: those of its result.

    Properties are a column's row of the profile, as a dictionary.
    """

    name: str
    fit: Callable[[DataFrame, list[str]], dict[str, Column]]
    applicable: Callable[[dict], bool] = lambda properties: bool(properties.get("numeric"))
    derive: Callable[[dict], dict] = dict


TRANSFORMATIONS: dict[str, Transformation] = {}


def register(t: Transformation) -> Transformation:
    TRANSFORMATIONS[t.name] = t
    return t


def numpy_unary(name: str, f: Callable[[np.ndarray], np.ndarray]) -> Transformation:
    """Register a numpy function of one column; it runs on Arrow batches, and what isn't finite becomes missing."""

    def run(x: pd.Series) -> pd.Series:
        with np.errstate(all="ignore"):
            y = np.asarray(f(x.to_numpy(dtype=float)), dtype=float)
        return pd.Series(np.where(np.isfinite(y), y, np.nan)).astype(object).where(np.isfinite(y), None)

    run.__annotations__ = {"x": pd.Series, "return": pd.Series}
    column = F.pandas_udf(run, "double")
    return register(Transformation(name, lambda train, cols: {c: column(F.col(c).cast("double")) for c in cols}))


def register_aggregate(name: str, f: Callable[[Column], Column]) -> None:
    """Make an aggregate expression known to group-by-then."""
    AGGREGATES[name] = f


def apply(train: DataFrame, df: DataFrame, name: str, properties: dict[str, dict]) -> tuple[DataFrame, dict[str, dict]]:
    """(table with a column ``name(c)`` for every column that the transformation applies to, their properties)."""
    t = TRANSFORMATIONS[name]
    cols = [c for c, p in properties.items() if t.applicable(p)]
    fitted = t.fit(train, cols)
    return df.withColumns({f"{name}({c})": e for c, e in fitted.items()}), {f"{name}({c})": t.derive(dict(properties[c])) for c in cols}
