"""Queries over discretisation, construction searches, clusters and streams."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import numeric as num
from ..operators import catalog as cg
from ..operators import construct as co
from ..operators import discretize as dz
from ..operators import rank as rk
from ..operators import sample as sm
from ..operators import usefulness as us
from ..registry import FEATURES, lines, query, r6, read
from .scratch import cut, shared_path

C = F.col

_H = "(CASE WHEN {a} > 0 THEN -({a} / ({a} + {b})) * log2({a} / ({a} + {b})) ELSE 0 END + CASE WHEN {b} > 0 THEN -({b} / ({a} + {b})) * log2({b} / ({a} + {b})) ELSE 0 END)"
_CUT = f"""WITH c AS (SELECT discount AS v, sum(1 - label)::DOUBLE AS n0, sum(label)::DOUBLE AS n1 FROM {{lines}} GROUP BY 1),
    r AS (SELECT v, n0, n1, sum(n0) OVER (ORDER BY v) AS l0, sum(n1) OVER (ORDER BY v) AS l1, sum(n0) OVER () AS t0, sum(n1) OVER () AS t1, lead(v) OVER (ORDER BY v) AS nv FROM c),
    x AS (SELECT (v + nv) / 2 AS cut, {_H.format(a='t0', b='t1')} - (l0 + l1) / (t0 + t1) * {_H.format(a='l0', b='l1')} - (t0 + t1 - l0 - l1) / (t0 + t1) * {_H.format(a='(t0 - l0)', b='(t1 - l1)')} AS gain FROM r WHERE nv IS NOT NULL)"""


@query("mdlp_first_cut", _CUT + " SELECT round(cut, 6) AS cut, round(gain, 9) AS gain FROM x ORDER BY x.gain DESC, x.cut LIMIT 1")
def mdlp_first_cut(s, d):
    return dz.best_cut(lines(s, d), "discount", "label").select(r6(C("cut"), "cut"), F.round("gain", 9).alias("gain"))


@query("cut_point_gain", _CUT + " SELECT round(cut, 6) AS cut, round(gain, 9) AS gain FROM x")
def cut_point_gain(s, d):
    x = dz.cut_gains(dz.value_class_counts(lines(s, d), "discount", "label"), F.lit(0))
    return x.select(r6(C("cut"), "cut"), F.round("gain", 9).alias("gain"))


def _mdlp_sql(levels):
    """All levels of entropy cuts with their stopping rule: each level cuts every segment at its best gain if that is accepted."""
    k = lambda a, b: f"(({a} > 0)::INT + ({b} > 0)::INT)"
    h = lambda a, b: _H.format(a=a, b=b)
    whole, left, right = ("t0", "t1"), ("l0", "l1"), ("(t0 - l0)", "(t1 - l1)")
    n, nl, nr = "(t0 + t1)", "(l0 + l1)", "(t0 + t1 - l0 - l1)"
    gain = f"{h(*whole)} - {nl} / {n} * {h(*left)} - {nr} / {n} * {h(*right)}"
    delta = f"log2(pow(3, {k(*whole)})) - ({k(*whole)} * {h(*whole)} - {k(*left)} * {h(*left)} - {k(*right)} * {h(*right)})"
    ctes = ["t AS (SELECT p_partkey, p_size::DOUBLE AS v, ((p_size BETWEEN 16 AND 35) <> (p_partkey % 20 = 0))::INT AS y FROM part)", "c AS (SELECT v, sum(1 - y)::DOUBLE AS n0, sum(y)::DOUBLE AS n1 FROM t GROUP BY 1)", "k0 AS (SELECT 0.0::DOUBLE AS cut WHERE false)"]
    for i in range(levels):
        ctes += [
            f"s{i} AS (SELECT *, (SELECT count(*) FROM k{i} WHERE cut <= v) AS seg FROM c)",
            f"r{i} AS (SELECT *, sum(n0) OVER w AS l0, sum(n1) OVER w AS l1, sum(n0) OVER (PARTITION BY seg) AS t0, sum(n1) OVER (PARTITION BY seg) AS t1, lead(v) OVER w AS nv, lead(n0) OVER w AS m0, lead(n1) OVER w AS m1 FROM s{i} WINDOW w AS (PARTITION BY seg ORDER BY v))",
            f"g{i} AS (SELECT seg, (v + nv) / 2 AS cut, {gain} AS gain, {gain} > (log2({n} - 1) + {delta}) / {n} AS ok FROM r{i} WHERE nv IS NOT NULL AND (n0 > 0 AND m1 > 0 OR n1 > 0 AND m0 > 0))",
            f"b{i} AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY seg ORDER BY gain DESC, cut) AS place FROM g{i}) WHERE place = 1 AND ok)",
            f"k{i + 1} AS (SELECT cut FROM k{i} UNION SELECT cut FROM b{i})",
        ]
    return f"WITH {', '.join(ctes)} SELECT p_partkey, (SELECT count(*) FROM k{levels} WHERE cut <= v)::INT AS bin FROM t"


@query("mdlp_discretize", _mdlp_sql(4))
def mdlp_discretize(s, d):
    """Two true cuts in noise, found on two levels; the stopping rule ends the third."""
    df = read(s, d, "part").withColumn("y", (C("p_size").between(16, 35) != (C("p_partkey") % 20 == 0)).cast("int"))
    return df.select("p_partkey", dz.segment_of(C("p_size"), dz.mdlp_cuts(df, "p_size", "y")).alias("bin"))


@query("cluster_transform")
def cluster_transform(s, d):
    """KMeans label of one column and the distances to all centres."""
    from pyspark.ml.clustering import KMeans

    df = read(s, d, "customer")
    vectors = lambda rows: rk.assembled(rows.withColumn("__zero", F.lit(0)), ["c_acctbal"], "__zero")
    model = sm.fit_even(df, ["c_acctbal"], lambda rows: KMeans(k=10, seed=42, maxIter=10).fit(vectors(rows)))
    centres = [float(c[0]) for c in model.clusterCenters()]
    return model.transform(vectors(df)).select("c_custkey", C("prediction").alias("cluster"), *[F.abs(C("c_acctbal") - F.lit(c)).alias(f"d{i}") for i, c in enumerate(centres)])


def _traversal(how):
    def run(s, d):
        return co.traverse(lines(s, d), FEATURES, "label", "row_id", how, 2).select("key", "complexity", r6(C("score"), "score"), "step")

    return run


for _how in ("best", "depth", "harmonic"):
    query(f"traverse_{_how}_first")(_traversal(_how))


@query("info_gain_greedy")
def info_gain_greedy(s, d):
    return co.info_gain_greedy(lines(s, d), FEATURES, "label", "row_id")


@query("feature_spaces", "WITH raw AS (SELECT count(*) AS n FROM (DESCRIBE SELECT * FROM {lines}) WHERE column_type = 'DOUBLE') SELECT 'autofeat' AS space, 6::BIGINT * n AS unary, n * (n - 1) AS binary FROM raw UNION ALL SELECT 'explorekit', 2 * n, n * (n - 1) * 3 FROM raw")
def feature_spaces(s, d):
    raw = cg.raw_catalog(s, sorted(c for c, t in lines(s, d).dtypes if t == "double"))
    out = None
    for name in ("autofeat", "explorekit"):
        unary, binary = co.SPACES[name]
        u = cg.generate_unary(raw, 2, unary).agg(F.count("*").alias("unary"))
        b = cg.generate_binary(raw, 3, binary).agg(F.count("*").alias("binary"))
        one = u.join(F.broadcast(b)).select(F.lit(name).alias("space"), "unary", "binary")
        out = one if out is None else out.unionByName(one)
    return out


@query("best_transform_per_column", "WITH u AS (" + " UNION ALL ".join(f"SELECT '{f}' AS feature, 'raw' AS op, corr({f}, label) AS c FROM {{lines}} UNION ALL SELECT '{f}', 'square', corr({f} * {f}, label) FROM {{lines}} UNION ALL SELECT '{f}', 'sigmoid', corr(1 / (1 + exp(-{f} / 100)), label) FROM {{lines}}" for f in ("discount", "tax", "quantity")) + ") SELECT feature, arg_max(op, (round(abs(c), 9), op)) AS op FROM u GROUP BY 1")
def best_transform_per_column(s, d):
    ops = {"raw": lambda c: c, "square": num.UNARY["square"], "sigmoid": lambda c: num.UNARY["sigmoid"](c / 100)}
    names = ("discount", "tax", "quantity")
    row = lines(s, d).agg(*[F.corr(f(C(n)), C("label")).alias(f"{n}|{o}") for n in names for o, f in ops.items()])
    each = F.array(*[F.struct(F.lit(n).alias("feature"), F.lit(o).alias("op"), F.round(F.abs(C(f"{n}|{o}")), 9).alias("c")) for n in names for o in ops])
    return row.select(F.explode(each).alias("p")).select("p.*").groupBy("feature").agg(F.max_by("op", F.struct("c", "op")).alias("op"))


@query("transform_usefulness")
def transform_usefulness(s, d):
    """(feature, op, useful): whether a transformed column tells more about the label than the raw one."""
    df = lines(s, d)
    raw = cg.raw_catalog(s, FEATURES)
    every = raw.unionByName(cg.generate_unary(raw, 2, {"square": "({0} * {0})", "log": "ln({0} + 1D)"}))
    scored = cut(every.join(co.mi_scores(df, every, "label", "row_id"), "key"), "useful")
    return cg.parent_gain(scored).where("op <> 'raw'").select(C("raw")[0].alias("feature"), "op", (C("gain") > 0).alias("useful"))


_OPS = {"square": "{0} * {0}", "log": "ln(abs({0}) + 1D)", "one_div": "try_divide(1D, {0})", "sqrt": "sqrt(abs({0}))", "exp": "exp(-abs({0}) / 50D)"}


def _usefulness(s, d):
    """Examples over the columns of lines: does an operator help to tell where another column lies?"""
    q, p, disc, tax = C("l_quantity"), C("l_extendedprice"), C("l_discount"), C("l_tax")
    columns = {"quantity": q, "price": p, "discount": disc, "tax": tax, "unit": p / q, "net": p * (1 - disc), "gross": p * (1 + tax), "saved": p * disc, "fee": p * tax, "bulk": q * q, "rest": 50 - q, "line": C("l_linenumber").cast("double"), "day": F.dayofmonth("l_shipdate").cast("double"), "month": F.month("l_shipdate").cast("double")}
    targets = {f"t{i}": e.cast("int") for i, e in enumerate([p > 20000, p > 50000, p > 80000, q > 10, q > 40, disc > 0.05, tax > 0.04, p * disc > 1000, p * tax > 3000, p / q > 1500, F.month("l_shipdate") > 6, F.dayofmonth("l_shipdate") < 8, C("l_returnflag") == "R"])}
    df = read(s, d, "lineitem").select(*[e.alias(c) for c, e in columns.items()], *[e.alias(t) for t, e in targets.items()])
    return us.examples(df, list(columns), list(targets), _OPS, 0.001)


@query("usefulness_examples")
def usefulness_examples(s, d):
    """Metafeatures of every column and target, and which operators help."""
    return _usefulness(s, d).select("column", "target", "op", *[F.round(c, 6).alias(c) for c in us.META], "useful")


@query("learned_usefulness")
def learned_usefulness(s, d):
    """Accuracy on held-out columns after each round of labels, against the more frequent answer."""
    every = cut(_usefulness(s, d), "examples")
    held = C("column").isin("net", "fee", "rest", "month")
    return us.active_rounds(every.where(~held), every.where(held), list(_OPS), rounds=6, batch=40, first=60)


@query("construct_then_select", "SELECT row_id, round((qd - (SELECT min(quantity * discount) FROM {lines})) / (SELECT max(quantity * discount) - min(quantity * discount) FROM {lines}), 6) AS c0 FROM (SELECT row_id, quantity * discount AS qd FROM {lines})")
def construct_then_select(s, d):
    made = cg.generate_binary(cg.raw_catalog(s, ["discount", "quantity"]), 3, {"prod": "({0} * {1})"})
    table, names = cg.materialize(lines(s, d), made, ["row_id"])
    cols = [f"c{i}" for i in range(len(names))]
    return table.select("row_id", *[r6(e, c) for c, e in num.fit_minmax(table, cols).items()])


@query("active_learning_rounds")
def active_learning_rounds(s, d):
    """Rounds of uncertainty sampling: fit on what is labelled, take the most uncertain rows of the pool."""
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.functions import vector_to_array

    df = read(s, d, "customer").select("c_custkey", "c_acctbal", C("c_nationkey").cast("double").alias("nation"), (C("c_mktsegment") == "BUILDING").cast("int").alias("label"))
    known = cut(sm.sample_per_class(df, "c_custkey", "label", 20), "known")
    rows = []
    for step in range(3):
        model = LogisticRegression(labelCol="__y", maxIter=10).fit(rk.assembled(known, ["c_acctbal", "nation"], "label"))
        pool = rk.assembled(df.join(known.select("c_custkey"), "c_custkey", "left_anti"), ["c_acctbal", "nation"], "label")
        scored = model.transform(pool).withColumn("u", sm.uncertainty(vector_to_array("probability")))
        hit = scored.agg(F.avg((C("prediction") == C("__y")).cast("double"))).first()[0]
        rows.append((step, known.count(), float(hit)))
        known = cut(known.unionByName(scored.orderBy(F.desc("u"), "c_custkey").limit(20).select(*known.columns)), "known")
    return s.createDataFrame(rows, "step int, labelled long, accuracy double")


@query("streaming_feature_stats", "SELECT event_type, count(*) AS n, round(sum(value), 2) AS s, round(sum(value * value), 1) AS ss FROM events GROUP BY 1")
def streaming_feature_stats(s, d):
    from ..streaming.stats import run_once

    return run_once(s, f"{d}/events.parquet", shared_path(s, "stream")).select("event_type", "n", F.round("s", 2).alias("s"), F.round("ss", 1).alias("ss"))
