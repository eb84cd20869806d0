"""Queries over projections, predicates and profiles."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import numeric as num
from ..operators import profile as pf
from ..registry import FEATURES, lines, query, r6, read

C = F.col
PCOLS = ["p_partkey", "p_brand", "p_type", "p_size", "p_retailprice"]
_HOLED = "SELECT c_custkey, c_mktsegment, c_acctbal, c_nationkey, CASE WHEN c_custkey % 5 <> 0 THEN c_acctbal + 5000 END AS holed FROM customer"
_CCOLS = {"c_custkey": 1, "c_mktsegment": 0, "c_acctbal": 1, "c_nationkey": 1, "holed": 1}


def _holed(s, d):
    return read(s, d, "customer").select("c_custkey", "c_mktsegment", "c_acctbal", "c_nationkey", F.when(C("c_custkey") % 5 != 0, C("c_acctbal") + 5000).alias("holed"))


_PROFILE = f"WITH t AS ({_HOLED}), pr AS (" + " UNION ALL ".join(
    f"SELECT '{c}' AS col, {bool(n)} AS numeric, count(*) AS n, count(*) - count({c}) AS missing, " + (f"coalesce(bool_or({c} = 0), false) AS has_zero, min({c})::DOUBLE AS lo, max({c})::DOUBLE AS hi" if n else "false AS has_zero, NULL::DOUBLE AS lo, NULL::DOUBLE AS hi") + f", count(DISTINCT {c}) AS n_distinct FROM t"
    for c, n in _CCOLS.items()
) + ")"


@query("profile_columns", _PROFILE + " SELECT * FROM pr")
def profile_columns(s, d):
    return pf.profile(_holed(s, d))


@query("derive_properties", "SELECT 'log_price' AS col, round(min(ln(price)), 6) AS lo, round(max(ln(price)), 6) AS hi, count(DISTINCT ln(price)) AS n_distinct FROM {lines} UNION ALL SELECT 'minus_quantity', min(-quantity), max(-quantity), count(DISTINCT -quantity) FROM {lines}")
def derive_properties(s, d):
    built = lines(s, d).select(num.UNARY["log"](C("price")).alias("log_price"), num.UNARY["minus"](C("quantity")).alias("minus_quantity"))
    return pf.profile(built).select("col", r6(C("lo"), "lo"), r6(C("hi"), "hi"), "n_distinct")


@query("applicable", _PROFILE + " " + " UNION ALL ".join(f"SELECT col, '{op}' AS op FROM pr WHERE {rule}" for op, rule in pf.APPLICABLE.items()))
def applicable(s, d):
    return pf.applicable(pf.profile(_holed(s, d)))


_FAM = {k: v.replace("lower(col) RLIKE 'lat|lon'", "regexp_matches(lower(col), 'lat|lon')") for k, v in pf.FAMILIES.items()}


#: Forms of dates and times for SQL, which has no parser that tries all; the query asks the parser itself.
_MONTH = "(jan|feb|mar|apr|may|jun|jul|aug|sep|oct|nov|dec)[a-z]*[.]?"
_DATE = rf"^\s*((\d{{4}}[-/.]\d{{1,2}}([-/.]\d{{1,2}})?|\d{{1,2}}[-/.]\d{{1,2}}[-/.](\d{{4}}|\d{{2}})|\d{{8}}|\d{{1,2}}[- ]{_MONTH}[- ,]*(\d{{4}})?|{_MONTH}( \d{{1,2}})?,?( \d{{4}})?)([t ]+\d{{1,2}}:\d{{2}}(:\d{{2}}([.]\d+)?)?)?(z|[+-]\d{{2}}:?\d{{2}})?|\d{{1,2}}:\d{{2}}(:\d{{2}})?)\s*$"
_LAST = ", ".join(f"{n} AS (SELECT max(place) AS at FROM pr JOIN places USING (col) WHERE is_double AND contains(lower(col), '{n}') AND lo >= -180 AND hi <= 180)" for n in ("lat", "lon"))
_PLACES = ", ".join(f"('{c}', {i}, {c in ('c_acctbal', 'holed')})" for i, c in enumerate(_CCOLS))
_ASSIGN = (
    f"{_PROFILE}, places AS (SELECT * FROM (VALUES {_PLACES}) AS p(col, place, is_double)), {_LAST} "
    + " UNION ALL ".join(f"SELECT col, '{op}' AS family FROM pr WHERE {rule}" for op, rule in pf.FAMILIES.items() if op != "latitude_longitude")
    + " UNION ALL SELECT col, 'latitude_longitude' FROM places, lat, lon WHERE lat.at IS NOT NULL AND lon.at IS NOT NULL AND place IN (lat.at, lon.at)"
    + f" UNION ALL SELECT 'c_mktsegment', 'date' FROM (SELECT c_mktsegment AS v FROM t ORDER BY c_custkey NULLS FIRST, c_mktsegment NULLS FIRST LIMIT 1) WHERE regexp_matches(lower(v), '{_DATE}')"
)


@query("assign_transformers", _ASSIGN)
def assign_transformers(s, d):
    return pf.assign_transformers(_holed(s, d), "c_custkey")


@query("transforms_per_column", _PROFILE + " " + " UNION ALL ".join(f"SELECT col, '{f}' AS family, unnest({pf.TRANSFORMS[f]}) AS op FROM pr WHERE {rule}" for f, rule in _FAM.items()))
def transforms_per_column(s, d):
    return pf.transforms_per_column(pf.profile(_holed(s, d)))


_SKEW = "(avg(pow({0}, 3)) - 3 * avg({0}) * avg(pow({0}, 2)) + 2 * pow(avg({0}), 3)) / pow(stddev_pop({0}), 3)"
_META = " UNION ALL ".join(f"SELECT '{f}' AS col, count({f}) AS n, {_SKEW.format(f)} AS skew, max({f}) AS hi, min({f}) AS lo, avg({f}) AS mean, stddev_pop({f}) AS std, var_pop({f}) AS var FROM {{lines}}" for f in FEATURES)


@query("attribute_metafeatures", f"SELECT col, n, round(skew, 4) AS skew, hi, lo, round(mean, 5) AS mean, round(std, 5) AS std, round(var, 3) AS var FROM ({_META})")
def attribute_metafeatures(s, d):
    return pf.metafeatures(lines(s, d), FEATURES).select("col", "n", F.round("skew", 4).alias("skew"), "hi", "lo", F.round("mean", 5).alias("mean"), F.round("std", 5).alias("std"), F.round("var", 3).alias("var"))


@query("pair_metafeatures", f"WITH m AS ({_META}) SELECT a.col AS col_a, b.col AS col_b, round(abs(a.hi - b.hi), 4) AS hi, round(abs(a.mean - b.mean), 4) AS mean, round(abs(a.std - b.std), 4) AS std FROM m a JOIN m b ON a.col < b.col")
def pair_metafeatures(s, d):
    return pf.pair_metafeatures(pf.metafeatures(lines(s, d), FEATURES)).select("col_a", "col_b", *[F.round(c, 4).alias(c) for c in ("hi", "mean", "std")])


@query("class_distribution", "WITH c AS (SELECT l_returnflag AS label, count(*) / (SELECT count(*) FROM lineitem) AS share FROM lineitem GROUP BY 1) SELECT label, round(share, 6) AS share, row_number() OVER (ORDER BY share, label)::INT AS place FROM c")
def class_distribution(s, d):
    return pf.class_distribution(read(s, d, "lineitem").select(C("l_returnflag").alias("label")), "label").select("label", r6(C("share"), "share"), "place")


_V = "SELECT unnest([" + ", ".join(f"var_pop({f})" for f in FEATURES) + "]) / (" + " + ".join(f"var_pop({f})" for f in FEATURES) + ") AS v FROM {lines}"


@query("dataset_metafeatures", f"SELECT round({_SKEW.format('v')}, 4) AS variance_skew, (SELECT " + " + ".join(f"(count(DISTINCT {f}) = 2)::INT" for f in [*FEATURES, "grp"]) + " FROM {lines}) - 0 AS n_binary, round((SELECT " + " + ".join(f"(count(DISTINCT {f}) = 2)::INT" for f in [*FEATURES, "grp"]) + " FROM {lines}) / 5.0, 6) AS binary_share, round((SELECT least(avg(label), 1 - avg(label)) FROM {lines}), 6) AS minority_share FROM (" + _V.replace("]) / (", ", var_pop(grp)]) / (").replace(") AS v", " + var_pop(grp)) AS v") + ")")
def dataset_metafeatures(s, d):
    return pf.dataset_metafeatures(lines(s, d), [*FEATURES, "grp"], "label").select(F.round("variance_skew", 4).alias("variance_skew"), "n_binary", r6(C("binary_share"), "binary_share"), r6(C("minority_share"), "minority_share"))


@query("dataset_statistics", "SELECT count(*) AS n_rows, 5::INT AS n_raw, (SELECT count(DISTINCT c_mktsegment) FROM customer) + 4 AS n_encoded FROM customer")
def dataset_statistics(s, d):
    df = read(s, d, "customer")
    encoded = len(df.columns) - 1 + len(num.fit_one_hot(df, "c_mktsegment"))
    return df.agg(F.count("*").alias("n_rows")).select("n_rows", F.lit(len(df.columns)).alias("n_raw"), F.lit(encoded).cast("long").alias("n_encoded"))


@query("is_numeric", _PROFILE + " SELECT col, numeric FROM pr")
def is_numeric(s, d):
    df = _holed(s, d)
    return s.createDataFrame([(c, pf.is_numeric(df, c)) for c in df.columns], "col string, numeric boolean")


@query("apply_mask", "SELECT row_id, quantity, discount FROM {lines}")
def apply_mask(s, d):
    mask = [True, False, True, False]
    return lines(s, d).select("row_id", *[f for f, m in zip(FEATURES, mask) if m])


@query("concat_features", "SELECT row_id, discount, price, quantity FROM {lines}")
def concat_features(s, d):
    nested = [["quantity", ["price", "discount"]], "price"]
    flat = lambda x: [x] if isinstance(x, str) else [z for y in x for z in flat(y)]
    return lines(s, d).select("row_id", *sorted(set(flat(nested))))


@query("split_column", "SELECT event_id, split_part(t, '-', 1) AS p0, split_part(t, '-', 2) AS p1, split_part(t, '-', 3) AS p2, split_part(t, '-', 4) AS p3 FROM (SELECT event_id, event_type || '-' || user_id || '-' || event_id % 7 || '-x' AS t FROM events)")
def split_column(s, d):
    parts = F.split(F.concat_ws("-", "event_type", C("user_id").cast("string"), (C("event_id") % 7).cast("string"), F.lit("x")), "-")
    return read(s, d, "events").select("event_id", *[parts[i].alias(f"p{i}") for i in range(4)])


@query("derive_label", "SELECT o_orderkey, (epoch(l_shipdate) - epoch(o_orderdate)) / 86400 > 60 AS late, l_linenumber FROM lineitem JOIN orders ON l_orderkey = o_orderkey")
def derive_label(s, d):
    df = read(s, d, "lineitem").join(read(s, d, "orders"), C("l_orderkey") == C("o_orderkey"))
    return df.select("o_orderkey", ((F.unix_timestamp("l_shipdate") - F.unix_timestamp("o_orderdate")) / 86400 > 60).alias("late"), "l_linenumber")


@query("drop_missing_label", f"SELECT c_custkey, holed FROM ({_HOLED}) WHERE holed IS NOT NULL")
def drop_missing_label(s, d):
    return _holed(s, d).where(C("holed").isNotNull()).select("c_custkey", "holed")


@query("mispredictions", "SELECT row_id, label, (discount > 0.05)::INT AS pred, (discount > 0.05)::INT = label AS correct FROM {lines}")
def mispredictions(s, d):
    return lines(s, d).select("row_id", "label", (C("discount") > 0.05).cast("int").alias("pred")).withColumn("correct", C("pred") == C("label"))


@query("mask_to_names", "SELECT n_nationkey, list_filter(['quantity', 'price', 'discount', 'tax'], lambda x, i: (n_nationkey >> (i - 1)) % 2 = 1) AS names FROM nation")
def mask_to_names(s, d):
    names = F.array(*map(F.lit, FEATURES))
    return read(s, d, "nation").select("n_nationkey", F.filter(names, lambda x, i: F.getbit(C("n_nationkey").cast("long"), i) == 1).alias("names"))
