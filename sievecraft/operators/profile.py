"""Column profiles, operator assignment and metafeatures: one aggregate over the table each."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

NUMERIC = (T.ByteType, T.ShortType, T.IntegerType, T.LongType, T.FloatType, T.DoubleType, T.DecimalType, T.BooleanType)


def is_numeric(df: DataFrame, col: str) -> bool:
    return isinstance(df.schema[col].dataType, NUMERIC)


def profile(df: DataFrame, cols: list[str] | None = None, chunk: int = 40) -> DataFrame:
    """(col, numeric, n, missing, has_zero, lo, hi, n_distinct); strings have no lo, hi. Wide tables go in chunks of columns.

    Distinct values are counted a column at a time, so a task holds values of one column and not a copy of every row per column.
    """
    cols = cols or df.columns
    out = None
    for at in range(0, len(cols), chunk):
        part = cols[at : at + chunk]
        aggs, rows = [F.count(F.lit(1)).alias("__n")], []
        for c in part:
            num = is_numeric(df, c)
            v = F.col(c).cast("double") if num else F.lit(None).cast("double")
            aggs += [F.count(c).alias(f"c_{c}"), F.min(v).alias(f"lo_{c}"), F.max(v).alias(f"hi_{c}"), F.coalesce(F.max(v == 0), F.lit(False)).alias(f"z_{c}")]
            rows.append(F.struct(F.lit(c).alias("col"), F.lit(num).alias("numeric"), F.col("__n").alias("n"), (F.col("__n") - F.col(f"c_{c}")).alias("missing"), F.col(f"z_{c}").alias("has_zero"), F.col(f"lo_{c}").alias("lo"), F.col(f"hi_{c}").alias("hi")))
        distinct = [df.select(F.col(f"`{c}`").alias("v")).where("v IS NOT NULL").distinct().agg(F.count("*").alias("n_distinct")).select(F.lit(c).alias("col"), "n_distinct") for c in part]
        one = df.agg(*aggs).select(F.explode(F.array(*rows)).alias("p")).select("p.*").join(reduce(DataFrame.unionByName, distinct), "col")
        out = one if out is None else out.unionByName(one)
    return out


#: operator -> predicate over a profile row.
APPLICABLE = {
    "log": "numeric AND missing = 0 AND NOT has_zero AND lo > 0",
    "one_div": "numeric AND NOT has_zero",
    "divide_by": "numeric AND NOT has_zero",
    "group_value": "numeric AND missing = 0",
    "minmax_scale": "numeric AND missing = 0 AND NOT (lo = 0 AND hi = 1)",
    "discretize": "numeric AND n_distinct > 10",
    "impute": "missing > 0",
    "one_hot": "NOT numeric AND n_distinct <= 1000",
}


def applicable(profiled: DataFrame, rules: dict[str, str] = APPLICABLE) -> DataFrame:
    """(col, op): operators whose predicate holds for the column."""
    each = F.array(*[F.struct(F.lit(op).alias("op"), F.coalesce(F.expr(rule), F.lit(False)).alias("ok")) for op, rule in rules.items()])
    return profiled.select("col", F.explode(each).alias("p")).where("p.ok").select("col", "p.op")


#: Mapper rules of the legacy engine: transformer family -> predicate over a profile row.
FAMILIES = {
    "numeric": "numeric",
    "categorical": "n_distinct / n < 0.05",
    "bucket": "numeric AND n_distinct > 10",
    "latitude_longitude": "numeric AND lower(col) RLIKE 'lat|lon' AND lo >= -180 AND hi <= 180",
    "all": "true",
}
#: Transformations of each family.
TRANSFORMS = {
    "numeric": ["binarize", "cos", "degrees", "identity_fill", "log_clamped", "polynomial", "sigmoid", "sqrt_filled", "square", "standard"],
    "categorical": ["frequency_encode", "one_hot", "ordinal_encode", "helmert", "backward_difference"],
    "bucket": ["bucket", "qbucket"],
    "latitude_longitude": ["latlon_to_xyz"],
    "all": ["str_length", "parse_numbers", "skip"],
}


def is_date(value: str | None) -> bool:
    """Whether the value parses as a date or time, as the legacy engine tries it."""
    from dateutil import parser

    try:
        parser.parse(value)
    except (ValueError, TypeError, OverflowError):
        return False
    return True


def assign_transformers(df: DataFrame, order: str) -> DataFrame:
    """(col, family) of all families that a column falls in.

    date: a text column whose value in the first row by ``order`` parses; latitude_longitude: the last double column of each
    name within +-180, if there is one of both.
    """
    texts = [f.name for f in df.schema.fields if isinstance(f.dataType, T.StringType)]
    first = df.agg(*[F.min(F.struct(F.col(f"`{order}`").alias("at"), F.col(f"`{c}`").alias("v"))).alias(c) for c in texts]).first() if texts else {}
    dates = [c for c in texts if first[c] is not None and is_date(first[c]["v"])]
    rows = [(c, i, isinstance(df.schema[c].dataType, T.DoubleType), c in dates) for i, c in enumerate(df.columns)]
    known = profile(df).join(F.broadcast(df.sparkSession.createDataFrame(rows, "col string, place int, double boolean, date boolean")), "col")
    in_range = F.col("double") & (F.col("lo") >= -180) & (F.col("hi") <= 180)
    last = lambda name: F.max(F.when(in_range & F.contains(F.lower("col"), F.lit(name)), F.col("place"))).over(W.partitionBy())
    rules = FAMILIES | {"latitude_longitude": "lat IS NOT NULL AND lon IS NOT NULL AND place IN (lat, lon)", "date": "date"}
    return applicable(known.withColumns({"lat": last("lat"), "lon": last("lon")}), rules).withColumnRenamed("op", "family")


def transforms_per_column(profiled: DataFrame, families: dict[str, list[str]] = TRANSFORMS) -> DataFrame:
    """(col, family, op) of all families that a column falls in."""
    each = F.array(*[F.struct(F.lit(f).alias("family"), F.array(*map(F.lit, ops)).alias("ops")) for f, ops in families.items()])
    rows = applicable(profiled, FAMILIES).withColumnRenamed("op", "family")
    pairs = F.explode(each).alias("p")
    return rows.select("col", "family", pairs).where("p.family = family").select("col", "family", F.explode("p.ops").alias("op"))


def metafeatures(df: DataFrame, cols: list[str]) -> DataFrame:
    """(col, n, skew, hi, lo, mean, std, var) with population moments."""
    aggs = [F.struct(F.lit(c).alias("col"), F.count(c).alias("n"), F.skewness(c).alias("skew"), F.max(c).cast("double").alias("hi"), F.min(c).cast("double").alias("lo"), F.avg(c).alias("mean"), F.stddev_pop(c).alias("std"), F.var_pop(c).alias("var")) for c in cols]
    return df.agg(F.array(*aggs).alias("x")).select(F.explode("x").alias("p")).select("p.*")


def pair_metafeatures(meta: DataFrame) -> DataFrame:
    """Absolute differences of the metafeatures of every two columns."""
    a, b = meta.alias("a"), meta.alias("b")
    names = ["skew", "hi", "lo", "mean", "std", "var"]
    return a.join(b, F.col("a.col") < F.col("b.col")).select(F.col("a.col").alias("col_a"), F.col("b.col").alias("col_b"), *[F.abs(F.col(f"a.{n}") - F.col(f"b.{n}")).alias(n) for n in names])


def class_distribution(df: DataFrame, label: str) -> DataFrame:
    """(label, share), and the position of the share in ascending order."""
    counts = df.groupBy(label).agg(F.count("*").alias("n"))
    share = F.col("n") / F.sum("n").over(W.partitionBy())
    return counts.select(label, share.alias("share")).withColumn("place", F.row_number().over(W.orderBy("share", label)))


def dataset_metafeatures(df: DataFrame, features: list[str], label: str) -> DataFrame:
    """One row: skewness of the variances over their sum, binary columns (number and share), share of the smallest class."""
    row = df.agg(*[g for f in features for g in (F.var_pop(f).alias(f"v_{f}"), F.countDistinct(f).alias(f"d_{f}"))])
    variances = F.array(*[F.col(f"v_{f}") for f in features])
    total = sum([F.col(f"v_{f}") for f in features], F.lit(0.0))
    n_binary = sum([(F.col(f"d_{f}") == 2).cast("int") for f in features], F.lit(0))
    x = row.select((F.posexplode(variances)), total.alias("total"), n_binary.alias("n_binary")).select((F.col("col") / F.col("total")).alias("v"), "n_binary")
    skew = x.agg(F.skewness("v").alias("variance_skew"), F.max("n_binary").alias("n_binary"))
    least = class_distribution(df, label).agg(F.min("share").alias("minority_share"))
    return skew.join(F.broadcast(least)).withColumn("binary_share", F.col("n_binary") / F.lit(float(len(features))))
