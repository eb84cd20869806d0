"""Queries with operators that a user adds."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from ..functions import extend as ex
from ..functions import categorical as cat
from ..operators import profile as pf
from ..operators.select import select_k_best
from ..registry import FEATURES, lines, query, r6, read

C = F.col


def _properties(df):
    return {r.col: r.asDict() for r in pf.profile(df, FEATURES).collect()}


def _centred(train, cols):
    row = train.agg(*[F.avg(c).alias(c) for c in cols]).first()
    return {c: C(c) - F.lit(row[c]) for c in cols}


@query("custom_transformation", "SELECT row_id, " + ", ".join(f"round({f} - (SELECT avg({f}) FROM {{lines}}), 6) AS {f}" for f in ("quantity", "price")) + " FROM {lines}")
def custom_transformation(s, d):
    """Centring, for columns whose least value is above zero."""
    ex.register(ex.Transformation("centre", _centred, lambda p: bool(p["numeric"]) and p["lo"] > 0))
    df = lines(s, d)
    out, _ = ex.apply(df, df, "centre", _properties(df))
    return out.select("row_id", *[r6(C(f"centre({f})"), f) for f in ("quantity", "price")])


@query("numpy_unary", "SELECT row_id, round(cbrt(price), 6) AS price, CASE WHEN discount > 0 THEN round(log10(discount), 6) END AS discount FROM {lines}")
def numpy_unary(s, d):
    """Two numpy functions; what isn't finite becomes missing."""
    df, p = lines(s, d), _properties(lines(s, d))
    ex.numpy_unary("cbrt", np.cbrt)
    ex.numpy_unary("log10", np.log10)
    out, _ = ex.apply(df, df, "cbrt", {"price": p["price"]})
    out, _ = ex.apply(df, out, "log10", {"discount": p["discount"]})
    return out.select("row_id", r6(C("cbrt(price)"), "price"), r6(C("log10(discount)"), "discount"))


@query("custom_group_aggregate", "SELECT c_custkey, count(c_acctbal) OVER (PARTITION BY c_nationkey) AS n FROM customer")
def custom_group_aggregate(s, d):
    ex.register_aggregate("count", F.count)
    df = read(s, d, "customer").select("c_custkey", "c_nationkey", "c_acctbal")
    return cat.group_by_then(df, df, "c_acctbal", "c_nationkey", "count", "n").select("c_custkey", C("n").cast("long").alias("n"))


def correlation_ranking(df, features, label):
    """A ranking function as users write them: (table, features, label) -> (feature, score)."""
    row = df.agg(*[F.abs(F.corr(f, label)).alias(f) for f in features])
    return row.select(F.explode(F.array(*[F.struct(F.lit(f).alias("feature"), C(f).alias("score")) for f in features])).alias("p")).select("p.*")


@query("custom_ranking", "SELECT feature, round(score, 6) AS score FROM (" + " UNION ALL ".join(f"SELECT '{f}' AS feature, abs(corr({f}, label)) AS score FROM {{lines}}" for f in FEATURES) + ") ORDER BY score DESC, feature LIMIT 2")
def custom_ranking(s, d):
    return select_k_best(correlation_ranking(lines(s, d), FEATURES, "label"), 2).select("feature", r6(C("score"), "score"))
