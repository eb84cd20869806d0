"""Queries over the candidate catalog."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.window import prefix_sums
from ..operators import catalog as cg
from ..operators import dependencies as dp
from ..operators import profile as pf
from ..registry import FEATURES, lines, query, r6, read
from .scratch import cut

C = F.col


def _catalog(s, d):
    """Raw candidates: the numeric columns that the profile of the table shows."""
    found = pf.profile(lines(s, d), FEATURES).where("numeric AND missing = 0").select("col").collect()
    return cg.raw_catalog(s, sorted(r.col for r in found))


#: Numeric columns without a missing value, and their values by row.
_RAW = "raw AS (" + " UNION ALL ".join(f"SELECT '{f}' AS k FROM {{lines}} HAVING count({f}) = count(*) AND bool_and(typeof({f}) = 'DOUBLE')" for f in sorted(FEATURES)) + ")"
_LONG = _RAW + ", v AS (SELECT * FROM (" + " UNION ALL ".join(f"SELECT row_id, '{f}' AS k, {f} AS x FROM {{lines}}" for f in sorted(FEATURES)) + ") WHERE k IN (SELECT k FROM raw))"
_U = "u AS (SELECT o || '(' || k || ')' AS k FROM raw, (SELECT unnest(['minus', 'log', 'one_div', 'square']) AS o))"


def _spans(s, d, made):
    """Key, complexity and least and greatest value of each candidate over the rows."""
    made = cut(made)
    spans = cg.candidate_prints(lines(s, d), made, "row_id")
    return made.join(spans, "key").select("key", "complexity", r6(C("lo"), "lo"), r6(C("hi"), "hi"))


_UNARY_VALUES = {"minus": "-x", "log": "CASE WHEN x > 0 THEN ln(x) END", "one_div": "CASE WHEN x <> 0 THEN 1 / x END", "square": "x * x"}


@query("generate_unary", f"WITH {_LONG} " + " UNION ALL ".join(f"SELECT '{o}(' || k || ')' AS key, 2::INT AS complexity, round(min({e}), 6) AS lo, round(max({e}), 6) AS hi FROM v GROUP BY k" for o, e in _UNARY_VALUES.items()))
def generate_unary(s, d):
    return _spans(s, d, cg.generate_unary(_catalog(s, d), 2))


@query("generate_unary_applicable", "WITH t AS (SELECT * FROM {lines}), pr AS (" + " UNION ALL ".join(f"SELECT '{f}' AS col, bool_or({f} = 0) AS z, min({f}) AS lo FROM t" for f in FEATURES) + ") SELECT 'log(' || col || ')' AS key FROM pr WHERE NOT z AND lo > 0 UNION ALL SELECT 'one_div(' || col || ')' FROM pr WHERE NOT z")
def generate_unary_applicable(s, d):
    allowed = pf.applicable(pf.profile(lines(s, d), FEATURES))
    return cg.generate_unary(_catalog(s, d), 2, allowed=allowed).select("key")


_BINARY_VALUES = {"sum": ("{a} + {b}", True), "prod": ("{a} * {b}", True), "divide": ("CASE WHEN {b} <> 0 THEN {a} / {b} END", False), "subtract": ("{a} - {b}", False)}
_PAIRS = [(o, a, b, e.format(a=a, b=b)) for o, (e, same) in _BINARY_VALUES.items() for a in sorted(FEATURES) for b in sorted(FEATURES) if a < b or a > b and not same]


@query("generate_binary", f"WITH {_RAW}, t AS (SELECT * FROM {{lines}}) " + " UNION ALL ".join(f"SELECT '{o}({a},{b})' AS key, 3::INT AS complexity, round(min({e}), 6) AS lo, round(max({e}), 6) AS hi FROM t HAVING (SELECT count(*) FROM raw WHERE k IN ('{a}', '{b}')) = 2" for o, a, b, e in _PAIRS))
def generate_binary(s, d):
    return _spans(s, d, cg.generate_binary(_catalog(s, d), 3))


@query("candidate_pairs", f"WITH {_RAW} SELECT 'unordered_repeated' AS kind, count(*) AS n FROM raw x, raw y WHERE x.k <= y.k UNION ALL SELECT 'unordered', count(*) FROM raw x, raw y WHERE x.k < y.k UNION ALL SELECT 'ordered', count(*) FROM raw x, raw y WHERE x.k <> y.k UNION ALL SELECT 'ordered_repeated', count(*) FROM raw x, raw y")
def candidate_pairs(s, d):
    a = _catalog(s, d).select(C("key").alias("a"))
    b = _catalog(s, d).select(C("key").alias("b"))
    kinds = {"unordered_repeated": C("a") <= C("b"), "unordered": C("a") < C("b"), "ordered": C("a") != C("b"), "ordered_repeated": F.lit(True)}
    pairs = a.join(F.broadcast(b))
    return pairs.select(F.explode(F.array_compact(F.array(*[F.when(p, F.lit(k)) for k, p in kinds.items()]))).alias("kind")).groupBy("kind").agg(F.count("*").alias("n"))


@query("complexity_partition_pairs", f"WITH {_RAW}, {_U}, c AS (SELECT k, 1 AS c FROM raw UNION ALL SELECT k, 2 FROM u) SELECT t AS complexity, count(*) AS pairs FROM c a JOIN c b ON a.k < b.k, (SELECT unnest([3, 4, 5])::INT AS t) WHERE t - 1 - a.c = b.c GROUP BY 1")
def complexity_partition_pairs(s, d):
    raw = _catalog(s, d)
    both = cut(raw.unionByName(cg.generate_unary(raw, 2)))
    out = None
    for c in (3, 4, 5):
        n = cg.generate_binary(both, c, {"prod": "({0} * {1})"}).groupBy("complexity").agg(F.count("*").alias("pairs"))
        out = n if out is None else out.unionByName(n)
    return out


@query("generate_one_round", f"WITH {_RAW}, {_U}, a AS (SELECT k FROM raw UNION ALL SELECT k FROM u) SELECT 'unary' AS part, count(*) AS n FROM u UNION ALL SELECT 'binary', count(*) FROM a x, a y WHERE x.k < y.k UNION ALL SELECT 'unary_of_binary', count(*) FROM a x, a y, (SELECT unnest(['minus', 'log', 'one_div', 'square']) AS o) WHERE x.k < y.k")
def generate_one_round(s, d):
    out = cg.one_round(_catalog(s, d), binary={"prod": "({0} * {1})"})
    return out.where("op <> 'raw'").groupBy(F.when(C("op") == "prod", "binary").when(C("complexity") == 2, "unary").otherwise("unary_of_binary").alias("part")).agg(F.count("*").alias("n"))


@query("search_space_size", "SELECT n * 4 AS unary, (n * 5) * (n * 5 - 1) * 4 AS binary, (n * 5) * (n * 5 - 1) * 16 AS unary_of_binary, n + n * 4 + (n * 5) * (n * 5 - 1) * 20 AS total FROM (WITH " + _RAW + " SELECT count(*) AS n FROM raw)")
def search_space_size(s, d):
    n = _catalog(s, d).count()
    size = cg.search_space_size(n, len(cg.UNARY_OPS), len(cg.BINARY_OPS))
    return s.createDataFrame([tuple(size.values())], ", ".join(f"{k} long" for k in size))


_FORMS = [("minus(minus(x))", "x"), ("one_div(one_div(x))", "x"), ("scale(scale(x))", "scale(x)"), ("log(x)", "log(x)")]


@query("canonical_key", "SELECT c_mktsegment AS col, c_mktsegment AS twice_minus, 'scale(' || c_mktsegment || ')' AS twice_scale, 'sum(a,' || lower(c_mktsegment) || ')' AS sorted, 'log(log(' || c_mktsegment || '))' AS twice_log FROM (SELECT DISTINCT c_mktsegment FROM customer)")
def canonical_key(s, d):
    df = read(s, d, "customer").select(C("c_mktsegment").alias("col")).distinct()
    k = lambda op, c: cg.canonical(F.lit(op), c)
    return df.select("col", k("minus", k("minus", C("col"))).alias("twice_minus"), k("scale", k("scale", C("col"))).alias("twice_scale"), cg.canonical(F.lit("sum"), F.lower("col"), F.lit("a")).alias("sorted"), k("log", k("log", C("col"))).alias("twice_log"))


@query("canonical_group_key", "SELECT c_mktsegment AS k, 'min(x;' || c_mktsegment || ')' AS nested, '0' AS nested_std, 'minus(max(x;' || c_mktsegment || '))' AS min_minus, 'mean(x;' || c_mktsegment || ')' AS scaled_key FROM (SELECT DISTINCT c_mktsegment FROM customer)")
def canonical_group_key(s, d):
    df = read(s, d, "customer").select(C("c_mktsegment").alias("k")).distinct()
    form = lambda template: cg.canonical_groups(F.regexp_replace(F.lit(template), "K", C("k")))
    return df.select("k", form("max(min(x;K);K)").alias("nested"), form("std(min(x;K);K)").alias("nested_std"), form("min(minus(x);K)").alias("min_minus"), form("mean(x;log(K))").alias("scaled_key"))


@query("materialize_candidates", "SELECT row_id, round(price * quantity, 4) AS c0, round(quantity + tax, 6) AS c1 FROM {lines}")
def materialize_candidates(s, d):
    made = cg.generate_binary(_catalog(s, d), 3).where("key IN ('prod(price,quantity)', 'sum(quantity,tax)')")
    out, _ = cg.materialize(lines(s, d), made, ["row_id"])
    return out.select("row_id", F.round("c0", 4).alias("c0"), r6(C("c1"), "c1"))


#: Constructed candidates: constants, the same values in other words, and such as differ.
_FORMED = [("gap", "(price - price)", 2), ("tax0", "(tax * 0D)", 2), ("quantity2", "(quantity + quantity)", 2), ("quantity3", "(2D * quantity)", 2), ("price_tax", "(price * tax)", 3),
           ("tax_price", "(tax * price)", 3), ("undone", "(-(-discount))", 3), ("square", "(quantity * quantity)", 2), ("net", "(price - price * discount)", 4)]
_EVERY = [(f, f, 1) for f in sorted(FEATURES)] + _FORMED
_VALUES = "t AS (SELECT " + ", ".join(f"{e.replace('0D', '0::DOUBLE').replace('2D', '2::DOUBLE')} AS {k}" for k, e, _ in _EVERY) + " FROM {lines})"


def _forms(s, d):
    formed = s.createDataFrame([(k, "formed", [], e, n, []) for k, e, n in _FORMED], cg.SCHEMA)
    every = cut(_catalog(s, d).unionByName(formed))
    return every, cg.candidate_prints(lines(s, d), every, "row_id", 5)


@query("drop_constant", f"WITH {_VALUES} " + " UNION ALL ".join(f"SELECT '{k}' AS key, round(min({k}), 6) AS lo, round(max({k}), 6) AS hi FROM t HAVING min({k}) < max({k})" for k, _, _ in _EVERY))
def drop_constant(s, d):
    return cg.drop_constant(_forms(s, d)[1]).select("key", r6(C("lo"), "lo"), r6(C("hi"), "hi"))


_FIRST = sorted(_EVERY, key=lambda c: (c[2], c[0]))


@query("drop_equivalent", f"WITH {_VALUES} " + " UNION ALL ".join(f"SELECT '{k}' AS key FROM t HAVING " + (" AND ".join(f"NOT bool_and(round({k}, 9) IS NOT DISTINCT FROM round({o}, 9))" for o, _, _ in _FIRST[:i]) or "true") for i, (k, _, _) in enumerate(_FIRST)))
def drop_equivalent(s, d):
    every, prints = _forms(s, d)
    return cg.drop_equivalent(prints, every.select("key", "complexity", "expr"), lines(s, d), 5).select("key")


# scored candidates: parts stand for raw features of price, their products with a score from the table
_SC = """WITH b AS (SELECT p_brand AS k, round(avg(p_size), 6) AS score FROM part GROUP BY 1),
    sc AS (SELECT k AS key, 'raw' AS op, [] AS parents, score, 1 AS complexity, [k] AS raw FROM b
           UNION ALL SELECT 'square(' || k || ')', 'square', [k], round(score + (length(k) % 3) - 1 + score / 100 - 0.2, 6), 2, [k] FROM b
           UNION ALL SELECT 'prod(' || x.k || ',' || y.k || ')', 'prod', [x.k, y.k], round((x.score + y.score) / 2 + 0.3, 6), 3, [x.k, y.k] FROM b x JOIN b y ON x.k < y.k)"""


def _scored(s, d):
    b = read(s, d, "part").groupBy(C("p_brand").alias("k")).agg(r6(F.avg("p_size")).alias("score"))
    none = F.array().cast("array<string>")
    raw = b.select(C("k").alias("key"), F.lit("raw").alias("op"), none.alias("parents"), "score", F.lit(1).alias("complexity"), F.array("k").alias("raw"))
    sq = b.select(F.concat(F.lit("square("), "k", F.lit(")")).alias("key"), F.lit("square").alias("op"), F.array("k").alias("parents"), r6(C("score") + F.length("k") % 3 - 1 + C("score") / 100 - 0.2).alias("score"), F.lit(2).alias("complexity"), F.array("k").alias("raw"))
    x, y = b.alias("x"), b.alias("y")
    pr = x.join(y, C("x.k") < C("y.k")).select(F.concat(F.lit("prod("), "x.k", F.lit(","), "y.k", F.lit(")")).alias("key"), F.lit("prod").alias("op"), F.array("x.k", "y.k").alias("parents"), r6((C("x.score") + C("y.score")) / 2 + 0.3).alias("score"), F.lit(3).alias("complexity"), F.array("x.k", "y.k").alias("raw"))
    return cut(raw.unionByName(sq).unionByName(pr), "scored")


_GAIN = _SC + ", pg AS (SELECT s.*, m AS best_parent, s.score - m AS gain FROM sc s LEFT JOIN (SELECT a.key, max(p.score) AS m FROM (SELECT key, unnest(parents) AS parent FROM sc) a JOIN sc p ON p.key = a.parent GROUP BY 1) USING (key))"


@query("drop_equal_score", _SC + " SELECT key FROM (SELECT *, row_number() OVER (PARTITION BY score ORDER BY complexity, key) AS rn FROM sc) WHERE rn = 1")
def drop_equal_score(s, d):
    return cg.drop_equal_score(_scored(s, d)).select("key")


@query("epsilon_prune", _GAIN + " SELECT key, round(gain, 6) AS gain FROM pg WHERE op = 'raw' OR gain > 0.1")
def epsilon_prune(s, d):
    return cg.epsilon_prune(_scored(s, d), 0.1).select("key", r6(C("gain"), "gain"))


@query("predecessor_prune", _GAIN + " SELECT key FROM pg WHERE best_parent IS NULL OR score > best_parent")
def predecessor_prune(s, d):
    return cg.predecessor_prune(_scored(s, d)).select("key")


@query("complexity_prune", _SC + " SELECT key FROM (SELECT *, max(score) OVER (PARTITION BY raw ORDER BY complexity RANGE BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS below FROM sc) WHERE below IS NULL OR score > below")
def complexity_prune(s, d):
    return cg.complexity_prune(_scored(s, d)).select("key")


@query("order_by_complexity", _SC + " SELECT key, complexity::INT AS complexity, row_number() OVER (ORDER BY complexity, len(raw), key)::INT AS place FROM sc")
def order_by_complexity(s, d):
    # one sortable text per candidate, ranked range by range
    scored = _scored(s, d).withColumn("value", F.concat(F.format_string("%010d%010d", "complexity", F.size("raw")), "key")).withColumn("n", F.lit(1))
    return prefix_sums(scored, "value", ["n"]).select("key", "complexity", (C("before_n") + 1).cast("int").alias("place"))


@query("harmonic_stop", _SC + ", h AS (SELECT key, complexity, cume_dist() OVER (ORDER BY complexity DESC) AS a, cume_dist() OVER (ORDER BY score) AS b FROM sc) SELECT complexity::INT AS complexity, round(max(2 * a * b / (a + b)), 6) AS best FROM h GROUP BY 1")
def harmonic_stop(s, d):
    return cg.harmonic_scores(_scored(s, d)).groupBy("complexity").agg(r6(F.max("harmonic"), "best"))


_RSS = "SELECT p_size AS k, count(*) AS n, sum(pow(p_retailprice - 1000, 2)) AS rss FROM part GROUP BY 1"


def _models(s, d):
    return read(s, d, "part").groupBy(C("p_size").alias("k")).agg(F.count("*").alias("n"), F.sum((C("p_retailprice") - 1000) * (C("p_retailprice") - 1000)).alias("rss"))


@query("aicc_select", f"SELECT k, round(2 * k + n * ln(rss / n) + 2 * k * (k + 1) / (n - k - 1), 5) AS aicc FROM ({_RSS}) WHERE n > k + 1 ORDER BY 2, k LIMIT 3")
def aicc_select(s, d):
    """The three best models; those with too few rows for the correction have an infinite criterion and are never best."""
    scored = _models(s, d).select("k", F.round(cg.aicc(C("k"), C("n"), C("rss")), 5).alias("aicc"))
    return scored.where(C("aicc") < float("inf")).orderBy("aicc", "k").limit(3)


@query("aic_ensemble", f"WITH m AS (SELECT k, 2 * k + ln(rss / n) AS a FROM ({_RSS})), w AS (SELECT k, exp(-(a - (SELECT min(a) FROM m)) / 2) AS w FROM m) SELECT k, round(w / (SELECT sum(w) FROM w), 6) AS weight FROM w")
def aic_ensemble(s, d):
    models = _models(s, d).withColumn("a", 2 * C("k") + F.ln(C("rss") / C("n")))
    return cg.aic_weights(models, "a").select("k", r6(C("weight"), "weight"))


@query("gain_per_operator", _GAIN + " SELECT op, round(avg(gain), 6) AS mean, round(min(gain), 6) AS lo, round(max(gain), 6) AS hi, round(avg((gain > 0)::INT), 6) AS positive FROM pg WHERE op <> 'raw' GROUP BY 1")
def gain_per_operator(s, d):
    return cg.parent_gain(_scored(s, d)).where("op <> 'raw'").groupBy("op").agg(r6(F.avg("gain"), "mean"), r6(F.min("gain"), "lo"), r6(F.max("gain"), "hi"), r6(F.avg((C("gain") > 0).cast("int")), "positive"))


@query("monotonicity_report", _GAIN + " SELECT op, gain > 0 AS beats, count(*) AS n FROM pg WHERE gain IS NOT NULL GROUP BY 1, 2")
def monotonicity_report(s, d):
    return cg.parent_gain(_scored(s, d)).where("gain IS NOT NULL").groupBy("op", (C("gain") > 0).alias("beats")).agg(F.count("*").alias("n"))


@query("entanglement", _SC + ", j AS (SELECT a.key, a.score, max(p.score) AS hi, min(p.score) AS lo FROM (SELECT key, score, unnest(parents) AS parent FROM sc WHERE op = 'prod') a JOIN sc p ON p.key = a.parent GROUP BY 1, 2) SELECT CASE WHEN score > hi THEN 'above' WHEN score < lo THEN 'below' ELSE 'between' END AS place, count(*) AS n FROM j GROUP BY 1")
def entanglement(s, d):
    sc = _scored(s, d)
    up = sc.select(C("key").alias("parent"), C("score").alias("ps"))
    j = sc.where("op = 'prod'").select("key", "score", F.explode("parents").alias("parent")).join(up, "parent").groupBy("key", "score").agg(F.max("ps").alias("hi"), F.min("ps").alias("lo"))
    return j.groupBy(F.when(C("score") > C("hi"), "above").when(C("score") < C("lo"), "below").otherwise("between").alias("place")).agg(F.count("*").alias("n"))


@query("prediction_distance", "SELECT round(sqrt(sum(pow(a - b, 2))), 6) AS l2, round(1 - sum(a * b) / sum(greatest(a, b)), 6) AS jaccard FROM (SELECT (discount > 0.05)::INT AS a, (tax > 0.04)::INT AS b FROM {lines})")
def prediction_distance(s, d):
    x = lines(s, d).select((C("discount") > 0.05).cast("int").alias("a"), (C("tax") > 0.04).cast("int").alias("b"))
    return x.agg(r6(F.sqrt(F.sum((C("a") - C("b")) * (C("a") - C("b")))), "l2"), r6(1 - F.sum(C("a") * C("b")) / F.sum(F.greatest("a", "b")), "jaccard"))


@query("fd_to_target", "SELECT lhs, NOT EXISTS (SELECT 1 FROM customer GROUP BY CASE lhs WHEN 'c_custkey' THEN c_custkey::VARCHAR WHEN 'c_nationkey' THEN c_nationkey::VARCHAR ELSE c_nationkey::VARCHAR || '|' || c_acctbal::VARCHAR END HAVING min(c_mktsegment) <> max(c_mktsegment)) AS holds FROM (SELECT unnest(['c_custkey', 'c_nationkey']) AS lhs)")
def fd_to_target(s, d):
    return dp.functional_dependencies(read(s, d, "customer"), ["c_custkey", "c_nationkey"], "c_mktsegment", 2).select("lhs", "holds")


_SIX = ["l_linenumber", "l_quantity", "l_discount", "l_returnflag", "day", "month"]


def _six(s, d):
    t = read(s, d, "lineitem")
    return t.withColumns({"day": F.dayofmonth("l_shipdate"), "month": F.date_format("l_shipdate", "yyyy-MM")})


def _six_sql(error):
    """Errors of all sets of six columns; those without a smaller set that holds."""
    one = lambda m: ", ".join(c for i, c in enumerate(_SIX) if (m >> i) & 1)
    parts = " UNION ALL ".join(f"SELECT {m} AS mask, '{one(m).replace(' ', '')}' AS lhs, sum(e) AS e FROM (SELECT sum(c) - max(c) AS e FROM (SELECT {one(m)}, l_linestatus, count(*) AS c FROM t GROUP BY ALL) GROUP BY {one(m)})" for m in range(1, 64))
    return f"WITH t AS (SELECT *, day(l_shipdate) AS day, strftime(l_shipdate, '%Y-%m') AS month FROM lineitem), e AS (SELECT mask, lhs, e / (SELECT count(*) FROM t) AS error FROM ({parts})), h AS (SELECT mask FROM e WHERE error <= {error}) SELECT lhs, bit_count(mask)::INT AS size, round(error, 9) AS error, error <= {error} AS holds FROM e WHERE NOT EXISTS (SELECT 1 FROM h WHERE h.mask & e.mask = h.mask AND h.mask <> e.mask) AND ((SELECT error FROM e WHERE mask = 63) <= {error} OR bit_count(mask) = 1)"


@query("functional_dependencies", _six_sql(0.02))
def functional_dependencies(s, d):
    """Sets of six columns that determine the line status but for a fiftieth of the rows."""
    return dp.functional_dependencies(_six(s, d), _SIX, "l_linestatus", error=0.02).withColumn("error", F.round("error", 9))


@query("exact_dependencies", _six_sql(0.0))
def exact_dependencies(s, d):
    """Sets of six columns that determine the line status in all rows."""
    return dp.functional_dependencies(_six(s, d), _SIX, "l_linestatus").withColumn("error", F.round("error", 9))
