"""Queries over feature rankings and information measures."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import rank as rk
from ..registry import FEATURES, lines, query, r6, read

C = F.col
_LONG = "SELECT row_id, label, grp, f.feature, f.value FROM (SELECT *, unnest([" + ", ".join(f"{{'feature': '{f}', 'value': {f}}}" for f in FEATURES) + "]) AS f FROM {lines})"
_STATS = f"WITH l AS ({_LONG}), st AS (SELECT feature, label, count(*) AS n, sum(value) AS s, sum(value * value) AS ss FROM l GROUP BY ALL), t AS (SELECT *, sum(n) OVER w AS nn, sum(s) OVER w AS sn FROM st WINDOW w AS (PARTITION BY feature))"
_BW = _STATS + ", x AS (SELECT feature, sum(n * pow(s / n - sn / nn, 2)) AS b, sum(ss - s * s / n) AS w, count(*) AS k, sum(n) AS n FROM t GROUP BY 1)"


def scored(df, places=6):
    return df.select("feature", F.round("score", places).alias("score"))


@query("rank_variance", f"SELECT feature, round(var_pop(value), 4) AS score FROM ({_LONG}) GROUP BY 1")
def rank_variance(s, d):
    return scored(rk.rank_variance(lines(s, d), FEATURES), 4)


@query("classwise_stats", f"SELECT label, feature, count(*) AS n, round(sum(value), 2) AS s, round(sum(value * value), 1) AS ss FROM ({_LONG}) GROUP BY 1, 2")
def classwise_stats(s, d):
    return rk.classwise_stats(lines(s, d), FEATURES, "label").select("label", "feature", "n", F.round("s", 2).alias("s"), F.round("ss", 1).alias("ss"))


@query("rank_chi2", _STATS + " SELECT feature, round(sum(pow(s - sn * n / nn, 2) / (sn * n / nn)), 4) AS score FROM t GROUP BY 1")
def rank_chi2(s, d):
    return scored(rk.rank_chi2(lines(s, d), FEATURES, "label"), 4)


@query("rank_anova_f", _BW + " SELECT feature, round((b / (k - 1)) / (w / (n - k)), 5) AS score FROM x")
def rank_anova_f(s, d):
    return scored(rk.rank_anova_f(lines(s, d), FEATURES, "label"), 5)


@query("rank_fisher", _BW + " SELECT feature, round(b / w, 9) AS score FROM x")
def rank_fisher(s, d):
    return scored(rk.rank_fisher(lines(s, d), FEATURES, "label"), 9)


def _info(source):
    h = lambda keys, over: f"(SELECT feature, log2(sum(n)) - sum(n * log2(n)) / sum(n) AS h FROM (SELECT feature, {keys}, sum(n) AS n FROM vc GROUP BY ALL) GROUP BY 1)"
    return f"""WITH l AS ({source}), vc AS (SELECT feature, value, label, count(*) AS n FROM l GROUP BY ALL),
        i AS (SELECT x.feature, x.h AS hx, y.h AS hy, z.h AS hxy, x.h + y.h - z.h AS mi, 2 * (x.h + y.h - z.h) / (x.h + y.h) AS su
              FROM {h('value', 0)} x JOIN {h('label', 0)} y USING (feature) JOIN {h('value, label', 0)} z USING (feature))"""


_BINNED = f"SELECT row_id, label, feature, least(floor((value - lo) / ((hi - lo) / 10.0::DOUBLE)), 9) AS value FROM (SELECT *, min(value) OVER w AS lo, max(value) OVER w AS hi FROM ({_LONG}) WINDOW w AS (PARTITION BY feature))"


@query("entropy", _info(_LONG) + " SELECT feature, round(hx, 6) AS bits, round(hx * ln(2), 6) AS nats, round(hx * log10(2), 6) AS digits FROM i")
def entropy(s, d):
    x = rk.information(lines(s, d), FEATURES, "label")
    return x.select("feature", r6(C("hx"), "bits"), r6(C("hx") * F.ln(F.lit(2.0)), "nats"), r6(C("hx") * F.log10(F.lit(2.0)), "digits"))


@query("conditional_entropy", _info(_LONG) + " SELECT feature, round(hxy - hy, 6) AS h FROM i")
def conditional_entropy(s, d):
    return rk.information(lines(s, d), FEATURES, "label").select("feature", r6(C("h_x_given_y"), "h"))


@query("mutual_information", _info(_LONG) + " SELECT feature, round(mi, 6) AS mi FROM i")
def mutual_information(s, d):
    return rk.information(lines(s, d), FEATURES, "label").select("feature", r6(C("mi"), "mi"))


@query("symmetrical_uncertainty", _info(_LONG) + " SELECT feature, round(su, 6) AS su FROM i")
def symmetrical_uncertainty(s, d):
    return rk.information(lines(s, d), FEATURES, "label").select("feature", r6(C("su"), "su"))


@query("c_correlation", _info(_BINNED) + " SELECT feature, round(su, 6) AS score FROM i")
def c_correlation(s, d):
    return rk.information(rk.binned(lines(s, d), FEATURES), FEATURES, "label").select("feature", r6(C("su"), "score"))


@query("rank_mutual_info", _info(_BINNED) + " SELECT feature, round(mi, 6) AS score FROM i")
def rank_mutual_info(s, d):
    return scored(rk.rank_mutual_info(lines(s, d), FEATURES, "label"))


@query("binned_mutual_info", """WITH t AS (SELECT * FROM {lines}), b AS (SELECT least(floor((quantity - (SELECT min(quantity) FROM t)) / ((SELECT max(quantity) - min(quantity) FROM t) / 5.0::DOUBLE)), 4) AS x, least(floor((price - (SELECT min(price) FROM t)) / ((SELECT max(price) - min(price) FROM t) / 5.0::DOUBLE)), 4) AS y FROM t),
    h AS (SELECT x, y, count(*) AS n FROM b GROUP BY ALL), e AS (SELECT log2(sum(n)) - sum(n * log2(n)) / sum(n) AS v FROM h)
    SELECT round((SELECT log2(sum(n)) - sum(n * log2(n)) / sum(n) FROM (SELECT x, sum(n) AS n FROM h GROUP BY 1)) + (SELECT log2(sum(n)) - sum(n * log2(n)) / sum(n) FROM (SELECT y, sum(n) AS n FROM h GROUP BY 1)) - v, 6) AS mi FROM e""")
def binned_mutual_info(s, d):
    return rk.binned_mutual_info(lines(s, d), "quantity", "price", 5).select(r6(C("mi"), "mi"))


@query("rank_fcbf", _info(_BINNED) + " SELECT feature, round(su, 6) AS score FROM i WHERE su > (SELECT min(su) FROM i)")
def rank_fcbf(s, d):
    return scored(rk.rank_fcbf(rk.binned(lines(s, d), FEATURES), FEATURES, "label"))


@query("rank_fcbf_redundancy")
def rank_fcbf_redundancy(s, d):
    df = lines(s, d).withColumn("quantity2", C("quantity") * 2)
    return scored(rk.rank_fcbf(rk.binned(df, [*FEATURES, "quantity2"]), [*FEATURES, "quantity2"], "label", redundancy=True))


@query("rank_relieff")
def rank_relieff(s, d):
    """Every row is an anchor; no SQL, which would compare all rows with all rows. Tests hold it to brute force."""
    return scored(rk.rank_relieff(lines(s, d), FEATURES, "label", "row_id"))


query("rank_relieff_all")(rank_relieff)


@query("rank_model_importance")
def rank_model_importance(s, d):
    return scored(rk.rank_model_importance(lines(s, d), FEATURES, "label"))


@query("rank_model_coefficients")
def rank_model_coefficients(s, d):
    return scored(rk.rank_model_importance(lines(s, d), FEATURES, "label", "logistic"))


@query("rank_fairness")
def rank_fairness(s, d):
    return scored(rk.rank_fairness(lines(s, d), [*FEATURES, "grp"], "grp"))


@query("rank_permutation_importance")
def rank_permutation_importance(s, d):
    df = read(s, d, "orders").select("o_orderkey", "o_totalprice", F.dayofyear("o_orderdate").alias("day"), (C("o_totalprice") > 250000).cast("int").alias("label"))
    return scored(rk.rank_permutation_importance(df, ["o_totalprice", "day"], "label", "o_orderkey"))


@query("consistency", "SELECT round(sum(CASE WHEN lo = hi THEN n ELSE 0 END) / sum(n), 6) AS consistency FROM (SELECT count(*) AS n, min(label) AS lo, max(label) AS hi FROM {lines} GROUP BY quantity, discount, tax)")
def consistency(s, d):
    return rk.consistency(lines(s, d), ["quantity", "discount", "tax"], "label").select(r6(C("consistency"), "consistency"))


@query("consistent_rows", "SELECT row_id, min(label) OVER w = max(label) OVER w AS consistent FROM {lines} WINDOW w AS (PARTITION BY quantity, discount, tax)")
def consistent_rows(s, d):
    return rk.consistent_rows(lines(s, d), ["quantity", "discount", "tax"], "label").select("row_id", "consistent")


@query("traceability", "WITH c AS (SELECT quantity, discount, quantity * discount AS v, count(*) AS n FROM {lines} GROUP BY 1, 2) SELECT round(avg(n / o), 6) AS traceability FROM (SELECT n, sum(n) OVER (PARTITION BY v) AS o FROM c)")
def traceability(s, d):
    df = lines(s, d).withColumn("v", C("quantity") * C("discount"))
    return rk.traceability(df, ["quantity", "discount"], "v").select(r6(C("traceability"), "traceability"))


_PAIRS = [(a, b) for i, a in enumerate(FEATURES) for b in FEATURES[i + 1 :]]


@query("feature_correlations", " UNION ALL ".join(f"SELECT '{a}' AS a, '{b}' AS b, round(corr({a}, {b}), 6) AS corr, round(regr_r2({a}, {b}), 6) AS r2 FROM {{lines}}" for a, b in _PAIRS))
def feature_correlations(s, d):
    return rk.feature_correlations(lines(s, d), FEATURES).select("a", "b", r6(C("corr"), "corr"), r6(C("r2"), "r2"))


_F5 = [*FEATURES, "total"]


def _r2_sql():
    """R2 of each feature from all others as 1 - 1 / (inverse of the correlation matrix), the inverse by cofactors."""
    c = {(a, b): "1.0::DOUBLE" if a == b else f"c_{min(a, b)}_{max(a, b)}" for a in range(5) for b in range(5)}

    def det(rows, cols):
        if len(rows) == 1:
            return c[rows[0], cols[0]]
        return "(" + " ".join(f"{'+' if j % 2 == 0 else '-'} {c[rows[0], x]} * {det(rows[1:], [*cols[:j], *cols[j + 1 :]])}" for j, x in enumerate(cols)) + ")"

    every = list(range(5))
    corr = ", ".join(f"corr({_F5[a]}, {_F5[b]}) AS c_{a}_{b}" for a in every for b in every if a < b)
    each = " UNION ALL ".join(f"SELECT '{f}' AS feature, 1 - {det(every, every)} / {det([x for x in every if x != i], [x for x in every if x != i])} AS r2 FROM k" for i, f in enumerate(_F5))
    return f"WITH t AS (SELECT *, price * (1 - discount) AS total FROM {{lines}}), k AS (SELECT {corr} FROM t) SELECT feature, round(r2, 6) AS r2, r2 > 0.5 AS keep FROM ({each})"


@query("redundancy_r2", _r2_sql())
def redundancy_r2(s, d):
    df = lines(s, d).withColumn("total", C("price") * (1 - C("discount")))
    return rk.redundancy_r2(df, [*FEATURES, "total"], 0.5).select("feature", r6(C("r2"), "r2"), "keep")
