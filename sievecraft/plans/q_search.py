"""Queries over mask-search strategies."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import rank as rk
from ..operators import search as se
from ..operators.evaluate import Constraints
from ..operators.select import select_k_best
from ..registry import FEATURES, lines, query, r6, read
from .q_evaluate import LIMITS, _LOSS, _MET, MASKS, parts

C = F.col


def _search(s, d, limits=LIMITS):
    train, valid, _ = parts(s, d)
    return se.Search(train, valid, FEATURES, "label", "grp", limits)


def _table(search):
    return search.table().select("seq", "batch", "mask", "size", *[r6(C(c), c) for c in ("accuracy", "f1", "fairness", "loss")], "satisfied")


#: Constraints that no mask meets, so that a strategy goes through all its steps.
HARD = Constraints(accuracy=0.99, fairness=0.9)


def select_features(s, d):
    """The flagship: profile, rank, search and verify; names of the chosen features with their scores."""
    train, valid, test = parts(s, d)
    ranking = rk.rank_chi2(train, FEATURES, "label")
    best = [r.feature for r in select_k_best(ranking, len(FEATURES)).collect()]
    names, trials = se.query(train, valid, test, FEATURES, "label", "grp", Constraints(0.5, 0.6, None, 0.75), lambda x: se.ranking_k(x, best))
    return ranking.withColumn("selected", C("feature").isin(names) if names else F.lit(False))


@query("select_features")
def select_features_query(s, d):
    return select_features(s, d).select("feature", F.round("score", 4).alias("score"), "selected")


def _strategy(name):
    def run(s, d):
        search = _search(s, d, HARD)
        se.STRATEGIES[name](search)
        return _table(search)

    return run


_ALL = _MET.replace(str(MASKS), str(list(range(1, 16))))


def _greedy_sql(sizes, within, order):
    """Trials of a greedy search as SQL: each step's masks are those of its size around the best of the step before."""
    hard = "pow(greatest(0, 0.99 - accuracy), 2) + pow(greatest(0, 0.9 - fairness), 2)"
    ctes = [f"e AS (SELECT mask::BIGINT AS mask, size::INT AS size, accuracy, f1, fairness, {hard} AS loss FROM m)"]
    for k, size in enumerate(sizes):
        near = "" if not k else f" AND {within.format(b=f'(SELECT mask FROM b{k - 1})')}"
        ctes += [f"c{k} AS (SELECT {k}::INT AS batch, * FROM e WHERE size = {size}{near})", f"b{k} AS (SELECT mask FROM c{k} ORDER BY loss, size, mask LIMIT 1)"]
    steps = " UNION ALL ".join(f"SELECT * FROM c{k}" for k in range(len(sizes)))
    return f"{_ALL}, {', '.join(ctes)} SELECT (row_number() OVER (ORDER BY batch, mask {order}) - 1)::INT AS seq, batch, mask, size, round(accuracy, 6) AS accuracy, round(f1, 6) AS f1, round(fairness, 6) AS fairness, round(loss, 6) AS loss, false AS satisfied FROM ({steps})"


_FULL = _MET.replace(str(MASKS), "[15]") + " SELECT 0::INT AS seq, 0::INT AS batch, mask::BIGINT AS mask, size::INT AS size, round(accuracy, 6) AS accuracy, round(f1, 6) AS f1, round(fairness, 6) AS fairness, round(pow(greatest(0, 0.99 - accuracy), 2) + pow(greatest(0, 0.9 - fairness), 2), 6) AS loss, false AS satisfied FROM m"
_GREEDY = {"full_set": _FULL, "forward": _greedy_sql((1, 2, 3, 4), "(mask & {b}) = {b}", ""), "backward": _greedy_sql((3, 2, 1), "(mask & {b}) = mask", "DESC")}

#: Searches of a few dozen trials run over sixteen features, so over far fewer masks than there are.
SAMPLED = ("tpe_masks", "annealing_masks", "nsga2_masks", "surrogate_masks")


def wide_parts(s, d):
    """Train and validation part of the labelled table with sixteen features, and their names."""
    t = read(s, d, "lineitem")
    q, p, disc, tax = C("l_quantity"), C("l_extendedprice"), C("l_discount"), C("l_tax")
    made = {"quantity": q, "price": p, "discount": disc, "tax": tax, "quantity2": q * q, "price2": p * p, "discount2": disc * disc, "tax2": tax * tax, "unit": p / q, "net": p * (1 - disc), "gross": p * (1 + tax), "both": disc * tax, "line": C("l_linenumber").cast("double"), "day": F.dayofmonth("l_shipdate").cast("double"), "month": F.month("l_shipdate").cast("double"), "year": F.year("l_shipdate").cast("double")}
    df = t.select((C("l_orderkey") * 10 + C("l_linenumber")).alias("row_id"), *[e.cast("double").alias(c) for c, e in made.items()], (C("l_returnflag") == "R").cast("int").alias("label"), (C("l_linestatus") == "F").cast("int").alias("grp"))
    k = C("row_id") % 5
    return df.where(k < 3), df.where(k == 3), list(made)


def _sampled(name):
    def run(s, d):
        train, valid, names = wide_parts(s, d)
        search = se.Search(train, valid, names, "label", "grp", HARD)
        se.STRATEGIES[name](search)
        return _table(search)

    return run


for _name in se.STRATEGIES:
    if _name != "exhaustive":
        query(f"strategy_{_name}", _GREEDY.get(_name))(_sampled(_name) if _name in SAMPLED else _strategy(_name))


@query("strategy_exhaustive", _ALL + " SELECT mask::BIGINT AS mask, size::INT AS size, round(accuracy, 6) AS accuracy, round(f1, 6) AS f1, round(fairness, 6) AS fairness, round(pow(greatest(0, 0.99 - accuracy), 2) + pow(greatest(0, 0.9 - fairness), 2), 6) AS loss FROM m")
def strategy_exhaustive(s, d):
    search = _search(s, d, HARD)
    se.exhaustive(search)
    return _table(search).select("mask", "size", "accuracy", "f1", "fairness", "loss")


@query("strategy_ranking_k", _MET.replace(str(MASKS), str([2, 3, 7, 15])) + " SELECT mask::BIGINT AS mask, round(accuracy, 6) AS accuracy, round(fairness, 6) AS fairness FROM m")
def strategy_ranking_k(s, d):
    search = _search(s, d, HARD)
    se.ranking_k(search, ["price", "quantity", "discount", "tax"])
    return _table(search).select("mask", "accuracy", "fairness")


@query("strategy_rfe")
def strategy_rfe(s, d):
    search = _search(s, d, HARD)
    se.rfe(search, lambda names: {r.feature: r.score for r in rk.rank_model_importance(search.train, names, "label", "logistic").collect()})
    return _table(search)


@query("select_k_best_curve", _MET.replace(str(MASKS), str([1, 3, 7, 15])) + " SELECT size::INT AS k, round(accuracy, 6) AS accuracy, round(f1, 6) AS f1 FROM m")
def select_k_best_curve(s, d):
    search = _search(s, d, HARD)
    se.ranking_k(search, FEATURES)
    return _table(search).select(C("size").alias("k"), "accuracy", "f1")


def _folds(s, d):
    df = lines(s, d).withColumn("fold", C("row_id") % 3)
    return [se.Search(df.where(C("fold") != k), df.where(C("fold") == k), FEATURES, "label", "grp", HARD) for k in range(3)]


def _cv_sql(sizes, within):
    """Accuracy of all masks as the mean of three folds, and the greedy path over it."""
    folds = []
    for k in range(3):
        one = _ALL.replace("row_id % 5 < 3", f"row_id % 3 <> {k}").replace("row_id % 5 = 3", f"row_id % 3 = {k}")
        folds.append(f"SELECT * FROM ({one} SELECT mask::BIGINT AS mask, size::INT AS size, accuracy FROM m)")
    ctes = [f"e AS (SELECT mask, size, avg(accuracy) AS accuracy FROM ({' UNION ALL '.join(folds)}) GROUP BY 1, 2)"]
    for k, size in enumerate(sizes):
        near = "" if not k else f" AND {within.format(b=f'(SELECT mask FROM b{k - 1})')}"
        ctes.append(f"b{k} AS (SELECT * FROM e WHERE size = {size}{near} ORDER BY round(accuracy, 9) DESC, mask LIMIT 1)")
    return f"WITH {', '.join(ctes)} " + " UNION ALL ".join(f"SELECT size, mask, round(accuracy, 6) AS accuracy FROM b{k}" for k in range(len(sizes)))


@query("forward_cv", _cv_sql((1, 2, 3, 4), "(mask & {b}) = {b}"))
def forward_cv(s, d):
    """Forward selection with accuracy averaged over three folds: each step scores all folds' batches."""
    rows = se.cross_validated(_folds(s, d), len(FEATURES))
    return s.createDataFrame(rows, "size int, mask long, accuracy double").withColumn("accuracy", r6(C("accuracy")))


@query("backward_cv", _cv_sql((3, 2, 1), "(mask & {b}) = mask"))
def backward_cv(s, d):
    """Backward selection with accuracy averaged over three folds."""
    rows = se.cross_validated(_folds(s, d), len(FEATURES) - 1, backward=True)
    return s.createDataFrame(rows, "size int, mask long, accuracy double").withColumn("accuracy", r6(C("accuracy")))


def _wide_rankings(train, names):
    every = [rk.rank_anova_f(train, names, "label"), rk.rank_fisher(train, names, "label"), rk.rank_variance(train, names)]
    return [{r.feature: r.score or 0.0 for r in x.collect()} for x in every]


@query("strategy_ranking_weights")
def strategy_ranking_weights(s, d):
    """Weights of three rankings and the number of features, searched together over sixteen features."""
    train, valid, names = wide_parts(s, d)
    search = se.Search(train, valid, names, "label", "grp", HARD)
    se.ranking_weights(search, _wide_rankings(train, names))
    return _table(search)


@query("kbest_tpe")
def kbest_tpe(s, d):
    """The number of best features by ANOVA F, searched over sixteen features."""
    train, valid, names = wide_parts(s, d)
    search = se.Search(train, valid, names, "label", "grp", HARD)
    score = _wide_rankings(train, names)[0]
    se.kbest_tpe(search, sorted(names, key=lambda f: (-score[f], f)))
    return _table(search)


@query("constrained_query")
def constrained_query(s, d):
    """Trials of a floating forward search, and whether each mask's names are the answer."""
    train, valid, test = parts(s, d)
    names, trials = se.query(train, valid, test, FEATURES, "label", "grp", Constraints(0.6, 0.8, None, 0.5))
    mask = sum(1 << FEATURES.index(f) for f in names)
    return trials.withColumn("answer", C("mask") == mask)
