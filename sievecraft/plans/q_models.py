"""Queries over models that are fitted for many masks at once, boosting, and strategies over sixteen features with them."""

from __future__ import annotations

import functools

from pyspark.sql import functions as F

from ..operators import boosting as bo
from ..operators import mask_models as mm
from ..operators import rank as rk
from ..operators import search as se
from ..operators.evaluate import Constraints, evaluate_masks, metrics
from ..registry import FEATURES, query, r6
from .q_evaluate import _LOSS, _MET, LIMITS, MASKS, parts
from .q_search import HARD, wide_parts

C = F.col
ALL = list(range(1, 16))
_T = "t AS (SELECT * FROM {lines}), tr AS (SELECT * FROM t WHERE row_id % 5 < 3), va AS (SELECT *, row_number() OVER () AS rid FROM t WHERE row_id % 5 = 3)"
#: Accuracy, F1 and fairness per mask from predictions pr (mask, label, grp, pred).
_MEASURES = "avg((label = pred)::INT) AS accuracy, coalesce(2 * sum(label * pred) / nullif(sum(label) + sum(pred), 0), 0) AS f1, 1 - abs(sum(label * pred * (1 - grp)) / sum(1 - grp) - sum(label * pred * grp) / sum(grp)) AS fairness"
_ROUNDED = "round(accuracy, 6) AS accuracy, round(f1, 6) AS f1, round(fairness, 6) AS fairness"


def _scores(fitted, valid, masks, names=FEATURES, limits=LIMITS, scorer="accuracy"):
    out = mm.evaluate(fitted, valid, names, "grp", masks, limits, scorer)
    return out.select("mask", "setting", "size", *[r6(C(c), c) for c in ("accuracy", "f1", "fairness", "loss")], "satisfied")


_SHARE = " + ".join(f"((mask >> {i}) % 2) * CASE WHEN {f} > 0.05 THEN ln(p_{f}) ELSE ln(1 - p_{f}) END" for i, f in enumerate(FEATURES))


@query(
    "evaluate_masks_bernoulli",
    f"WITH {_T}, st AS (SELECT label AS c, count(*) AS n, {', '.join(f'(count(*) FILTER (WHERE {f} > 0.05) + 1) / (count(*) + 2) AS p_{f}' for f in FEATURES)} FROM tr GROUP BY 1), mk AS (SELECT unnest(range(1, 16)) AS mask), "
    f"pr AS (SELECT mask, rid, any_value(label) AS label, any_value(grp) AS grp, arg_max(c, round(ln(n / (SELECT sum(n) FROM st)) + {_SHARE}, 9) - 1e-12 * c) AS pred FROM va, st, mk GROUP BY 1, 2), m AS (SELECT mask, {_MEASURES} FROM pr GROUP BY 1) SELECT mask, {_ROUNDED} FROM m",
)
def evaluate_masks_bernoulli(s, d):
    """All masks by Bernoulli naive Bayes on values above 0.05."""
    train, valid, _ = parts(s, d)
    return _scores(mm.BernoulliMasks(threshold=0.05).prepare(train, FEATURES, "label"), valid, ALL).select("mask", "accuracy", "f1", "fairness")


_EDGES = " UNION ALL ".join(f"SELECT {i} AS f, unnest(list_distinct(quantile_cont({c}, [{', '.join(f'{k}/16.0' for k in range(1, 16))}]))) AS e FROM tr" for i, c in enumerate(FEATURES))
_VALUES = " UNION ALL ".join(f"SELECT {i} AS f, rid, {c} AS x, label, grp FROM va" for i, c in enumerate(FEATURES))
_LEFT = " UNION ALL ".join(f"SELECT {i} AS f, e, count(*) FILTER (WHERE {c} <= e AND label = 0) AS l0, count(*) FILTER (WHERE {c} <= e AND label = 1) AS l1 FROM tr, edges WHERE f = {i} GROUP BY e" for i, c in enumerate(FEATURES))


def _stumps_sql():
    """Best split of each feature by balanced Gini impurity, then of each mask, and how the two sides predict."""
    purity = lambda a, b: f"coalesce((pow({a}, 2) + pow({b}, 2)) / nullif({a} + {b}, 0), 0)"
    return (
        f"WITH {_T}, edges AS ({_EDGES}), n AS (SELECT count(*) FILTER (WHERE label = 0) AS n0, count(*) FILTER (WHERE label = 1) AS n1, count(*) AS n FROM tr), "
        f"side AS (SELECT f, e, l0 * (n / (2.0 * n0)) AS a0, l1 * (n / (2.0 * n1)) AS a1, (n0 - l0) * (n / (2.0 * n0)) AS b0, (n1 - l1) * (n / (2.0 * n1)) AS b1, n FROM ({_LEFT}), n WHERE l0 + l1 > 0 AND l0 + l1 < n), "
        f"gain AS (SELECT f, e, a0, a1, b0, b1, round(({purity('a0', 'a1')} + {purity('b0', 'b1')} - {purity('(a0 + b0)', '(a1 + b1)')}) / n, 12) AS g FROM side), "
        "best AS (SELECT * FROM gain WHERE g > 0 QUALIFY row_number() OVER (PARTITION BY f ORDER BY g DESC, e) = 1), "
        "stump AS (SELECT mask, best.* FROM (SELECT unnest(range(1, 16)) AS mask), best WHERE (mask >> f) % 2 = 1 QUALIFY row_number() OVER (PARTITION BY mask ORDER BY g DESC, f) = 1), "
        f"v AS ({_VALUES}), pr AS (SELECT mask, label, grp, CASE WHEN x <= e THEN (round(a1, 9) > round(a0, 9))::INT ELSE (round(b1, 9) > round(b0, 9))::INT END AS pred FROM stump JOIN v USING (f)), "
        f"m AS (SELECT mask, {_MEASURES} FROM pr GROUP BY 1) SELECT mask, {_ROUNDED} FROM m"
    )


@query("evaluate_masks_stumps", _stumps_sql())
def evaluate_masks_stumps(s, d):
    """All masks by trees of depth 1 over 16 quantile bins."""
    train, valid, _ = parts(s, d)
    return _scores(mm.TreeMasks((1,), 16).prepare(train, FEATURES, "label"), valid, ALL).select("mask", "accuracy", "f1", "fairness")


@query("evaluate_masks_trees")
def evaluate_masks_trees(s, d):
    """All masks by trees of depth 1 to 7, the depth chosen by accuracy."""
    train, valid, _ = parts(s, d)
    return _scores(mm.TreeMasks().prepare(train, FEATURES, "label"), valid, ALL)


@query("evaluate_masks_logistic")
def evaluate_masks_logistic(s, d):
    """All masks by balanced logistic regression with C from 0.001 to 1000, C chosen by accuracy."""
    train, valid, _ = parts(s, d)
    return _scores(mm.LogisticMasks().prepare(train, FEATURES, "label"), valid, ALL)


@query("logistic_coefficients")
def logistic_coefficients(s, d):
    """Coefficients of every mask on standardised features, at C = 1."""
    train, _, _ = parts(s, d)
    got = mm.LogisticMasks((1.0,)).prepare(train, FEATURES, "label").fit(ALL)
    rows = [(m, f, float(got[m][0][i])) for m in ALL for i, f in enumerate([*FEATURES, "intercept"]) if f == "intercept" or (m >> i) & 1]
    return s.createDataFrame(rows, "mask long, feature string, coefficient double")


def _balanced(tp, fp, fn, tn):
    """Balanced accuracy, a scorer of a user's own."""
    return (F.try_divide(tp, tp + fn) + F.try_divide(tn, tn + fp)) / 2


@query("evaluate_masks_custom_scorer")
def evaluate_masks_custom_scorer(s, d):
    """Trees of depth 1 to 4 whose depth balanced accuracy chooses."""
    train, valid, _ = parts(s, d)
    out = mm.evaluate(mm.TreeMasks((1, 2, 3, 4), 16).prepare(train, FEATURES, "label"), valid, FEATURES, "grp", ALL, LIMITS, _balanced)
    return out.select("mask", "setting", r6(C("score"), "score"), r6(C("loss"), "loss"), "satisfied")


_BOOST = bo.Boosting(trees=10, depth=3, rate=0.3)


@query("boosting")
def boosting(s, d):
    """Accuracy, F1 and fairness of ten second-order boosted trees."""
    train, valid, _ = parts(s, d)
    model = bo.fit_boosting(train, FEATURES, "label", _BOOST, "row_id")
    return metrics(model.confusion(valid, FEATURES, "label", "grp", 15), ["mask"]).select(*[r6(C(c), c) for c in ("accuracy", "f1", "fairness")], "rows")


@query("boosting_scores")
def boosting_scores(s, d):
    """Probability of each row of the test part, from trees that see seven tenths of the rows and half of the features each."""
    train, _, test = parts(s, d)
    model = bo.fit_boosting(train, FEATURES, "label", bo.Boosting(trees=4, depth=3, rows=0.7, columns=0.5), "row_id")
    return model.score(test.select("row_id", *FEATURES)).select("row_id", r6(C("probability"), "probability"))


def _boosting_stump_sql():
    """A single tree of depth 1 from margin 0: gradients 1/2 - label, Hessians 1/4."""
    part = lambda g, h: f"pow({g}, 2) / ({h} + 1)"
    return (
        f"WITH {_T}, edges AS ({_EDGES}), whole AS (SELECT sum(0.5::DOUBLE - label) AS g, 0.25::DOUBLE * count(*) AS h FROM tr), "
        f"side AS (SELECT f, e, 0.5::DOUBLE * (l0 - l1) AS gl, 0.25::DOUBLE * (l0 + l1) AS hl, g, h FROM ({_LEFT}), whole), "
        f"gain AS (SELECT *, round(0.5 * ({part('gl', 'hl')} + {part('(g - gl)', '(h - hl)')} - {part('g', 'h')}), 9) AS gain FROM side WHERE least(hl, h - hl) >= 1), "
        "best AS (SELECT * FROM gain ORDER BY gain DESC, f, e LIMIT 1) "
        f"SELECT {FEATURES!r}[f + 1] AS feature, round(e, 6) AS edge, round(-0.3 * gl / (hl + 1), 6) AS left_value, round(-0.3 * (g - gl) / (h - hl + 1), 6) AS right_value FROM best"
    )


@query("boosting_stump", _boosting_stump_sql())
def boosting_stump(s, d):
    """Split and leaf values of the first boosted tree, of depth 1."""
    train, _, _ = parts(s, d)
    model = bo.fit_boosting(train, FEATURES, "label", bo.Boosting(trees=1, depth=1, bins=16), "row_id")
    (tree,) = model.trees
    left, right = tree.split[0]
    node = tree.nodes[left]
    row = (FEATURES[node.feature], float(model.bins.edges[node.feature][node.code]), float(tree.value[left]), float(tree.value[right]))
    out = s.createDataFrame([row], "feature string, edge double, left_value double, right_value double")
    return out.select("feature", *[r6(C(c), c) for c in ("edge", "left_value", "right_value")])


# strategies over sixteen features

MODELS = {"nb": mm.GaussianMasks(), "logistic": mm.LogisticMasks((1.0,), tolerance=1e-6), "tree": mm.TreeMasks((3,), 16)}
#: At most four of sixteen features, and no mask that satisfies, so that a search goes through all its steps.
FOUR = Constraints(accuracy=0.99, fairness=0.9, complexity=0.25)


def _wide(name, model, limits):
    def run(s, d):
        train, valid, names = wide_parts(s, d)
        search = se.Search(train, valid, names, "label", "grp", limits, model=MODELS[model])
        if name == "rfe":
            score = functools.cache(lambda: {r.feature: r.score for r in rk.rank_anova_f(train, names, "label").collect()})
            se.rfe(search, lambda left: score())  # a feature's F is the same whatever others are left
        else:
            se.STRATEGIES[name](search)
        return search.table().select("seq", "batch", "mask", "size", *[r6(C(c), c) for c in ("accuracy", "f1", "fairness", "loss")], "satisfied")

    return run


_WIDE = {"quantity": "l_quantity", "price": "l_extendedprice", "discount": "l_discount", "tax": "l_tax", "quantity2": "l_quantity * l_quantity", "price2": "l_extendedprice * l_extendedprice", "discount2": "l_discount * l_discount", "tax2": "l_tax * l_tax", "unit": "l_extendedprice / l_quantity", "net": "l_extendedprice * (1 - l_discount)", "gross": "l_extendedprice * (1 + l_tax)", "both_": "l_discount * l_tax", "line": "l_linenumber::DOUBLE", "day_": "day(l_shipdate)::DOUBLE", "month_": "month(l_shipdate)::DOUBLE", "year_": "year(l_shipdate)::DOUBLE"}


def _wide_nb_sql(sizes, first, step):
    """Trials of a greedy search over sixteen features by naive Bayes: the masks of each step around the best of the step before."""
    f = list(_WIDE)
    ll = " + ".join(f"((mask >> {i}) % 2) * -0.5 * (ln(2 * pi() * v_{x}) + pow({x} - m_{x}, 2) / v_{x})" for i, x in enumerate(f))
    ctes = [
        f"t AS MATERIALIZED (SELECT l_orderkey * 10 + l_linenumber AS row_id, {', '.join(f'{e} AS {x}' for x, e in _WIDE.items())}, (l_returnflag = 'R')::INT AS label, (l_linestatus = 'F')::INT AS grp FROM lineitem)",
        "tr AS (SELECT * FROM t WHERE row_id % 5 < 3)",
        "va AS MATERIALIZED (SELECT *, row_number() OVER () AS rid FROM t WHERE row_id % 5 = 3)",
        f"g AS MATERIALIZED (SELECT 1e-9 * greatest({', '.join(f'sum({x} * {x}) / count(*) - pow(sum({x}) / count(*), 2)' for x in f)}) AS s FROM tr)",
        f"st AS MATERIALIZED (SELECT label AS c, count(*) AS n, {', '.join(f'avg({x}) AS m_{x}, sum({x} * {x}) / count(*) - pow(sum({x}) / count(*), 2) + (SELECT s FROM g) AS v_{x}' for x in f)} FROM tr GROUP BY 1)",
    ]
    for k, size in enumerate(sizes):
        masks = first if not k else step.format(b=f"(SELECT mask FROM b{k - 1})")
        ctes += [
            f"k{k} AS MATERIALIZED ({masks})",
            f"p{k} AS (SELECT mask, rid, any_value(label) AS label, any_value(grp) AS grp, arg_max(c, ln(n / (SELECT sum(n) FROM st)) + {ll}) AS pred FROM va, st, k{k} GROUP BY 1, 2)",
            f"e{k} AS MATERIALIZED (SELECT mask, {size}::INT AS size, {k}::INT AS batch, {_MEASURES} FROM p{k} GROUP BY 1)",
            f"l{k} AS MATERIALIZED (SELECT *, pow(greatest(0, 0.99 - accuracy), 2) + pow(greatest(0, 0.9 - fairness), 2) + pow(greatest(0, {size} / 16.0 - 0.25), 2) AS loss FROM e{k})",
            f"b{k} AS MATERIALIZED (SELECT mask FROM l{k} ORDER BY loss, mask LIMIT 1)",
        ]
    every = " UNION ALL ".join(f"SELECT * FROM l{k}" for k in range(len(sizes)))
    return f"WITH {', '.join(ctes)} SELECT (row_number() OVER (ORDER BY batch, mask) - 1)::INT AS seq, batch, mask, size, {_ROUNDED}, round(loss, 6) AS loss, false AS satisfied FROM ({every})"


_BITS = "SELECT 1::BIGINT << i AS mask FROM (SELECT unnest(range(16)) AS i)"
_MORE = "SELECT {b} | (1::BIGINT << i) AS mask FROM (SELECT unnest(range(16)) AS i) WHERE ({b} >> i) % 2 = 0"
_WIDE_SQL = {("forward", "nb"): _wide_nb_sql((1, 2, 3, 4), _BITS, _MORE)}

for _model in MODELS:
    for _name in ("forward", "forward_floating", "rfe"):
        query(f"strategy16_{_name}_{_model}", _WIDE_SQL.get((_name, _model)))(_wide(_name, _model, HARD if _name == "rfe" else FOUR))
for _name in ("backward", "backward_floating"):
    query(f"strategy16_{_name}")(_wide(_name, "nb", HARD))


@query("evaluate_masks_100")
def evaluate_masks_100(s, d):
    """A hundred masks over sixteen features by logistic regression, a job a Newton step for all of them."""
    train, valid, names = wide_parts(s, d)
    masks = [(k * 40503 + 977) % 65535 + 1 for k in range(100)]
    return _scores(MODELS["logistic"].prepare(train, names, "label"), valid, list(dict.fromkeys(masks)), names, FOUR)


def _grid_sql():
    """Naive Bayes of each smoothing; per mask the first of highest accuracy, with its loss."""
    each = " UNION ALL ".join(f"SELECT {i} AS setting, * FROM ({_MET.replace(str(MASKS), str(ALL)).replace('1e-9 * greatest', f'1e-{k} * greatest')} SELECT * FROM m)" for i, k in enumerate(range(12, 5, -1)))
    return f"SELECT mask::BIGINT AS mask, size::INT AS size, {_ROUNDED}, round({_LOSS}, 6) AS loss, accuracy >= 0.66 AND fairness >= 0.9 AND size <= 2 AS satisfied FROM ({each}) QUALIFY row_number() OVER (PARTITION BY mask ORDER BY accuracy DESC, setting) = 1"


@query("evaluate_masks_grid", _grid_sql())
def evaluate_masks_grid(s, d):
    """Naive Bayes with the seven smoothings of the grid, chosen by accuracy."""
    train, valid, _ = parts(s, d)
    out = evaluate_masks(train, valid, FEATURES, "label", "grp", ALL, LIMITS, [10.0**-k for k in range(12, 5, -1)])
    return out.select("mask", "size", *[r6(C(c), c) for c in ("accuracy", "f1", "fairness", "loss")], "satisfied")
