"""Models over batches of masks and boosting, against one fit at a time in plain numpy."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from sievecraft.operators import boosting as bo
from sievecraft.operators import mask_models as mm
from sievecraft.operators.evaluate import Constraints, evaluate_masks
from sievecraft.operators.search import STRATEGIES, Search, query, rfe

NAMES = ["a", "b", "c", "d", "e"]
MASKS = [1, 2, 4, 8, 16, 3, 12, 21, 31, 27]


@pytest.fixture(scope="module")
def table():
    rng = np.random.default_rng(5)
    x = rng.standard_normal((600, 5))
    x[:, 1] = np.round(x[:, 1])
    x[:, 3] = x[:, 0] * 100 + 7  # linked with a
    x[:, 4] = np.abs(x[:, 4]) > 1
    y = (x[:, 0] + x[:, 1] ** 2 + 0.5 * rng.standard_normal(600) > 0.9).astype(int)
    missing = rng.random((600, 5)) < 0.04
    missing[:, [1, 3]] = False
    return np.where(missing, np.nan, x), y, rng.integers(0, 2, 600)


@pytest.fixture(scope="module")
def frames(spark, table):
    x, y, g = table
    rows = [(i, *[None if np.isnan(v) else float(v) for v in r], int(y[i]), int(g[i])) for i, r in enumerate(x)]
    df = spark.createDataFrame(rows, "row_id long, a double, b double, c double, d double, e double, label int, grp int").repartition(3).cache()
    return df.where("row_id < 400"), df.where("row_id >= 400")


def on(mask):
    return [i for i in range(5) if (mask >> i) & 1]


def counted(df):
    return sorted((r.mask, r.setting, r.label, r.pred, r.grp, r.n) for r in df.collect())


def counts(mask, setting, y, p, g):
    keys, n = np.unique(np.stack([y, p, g], axis=1), axis=0, return_counts=True)
    return [(mask, setting, *map(int, k), int(c)) for k, c in zip(keys, n)]


@pytest.mark.parametrize("balanced", [True, False])
def test_logistic(frames, table, balanced):
    x, y, g = table
    train, valid = frames
    cs = (0.01, 1.0, 100.0)
    mean, std = np.nanmean(x[:400], axis=0), np.nanstd(x[:400], axis=0)
    z = np.c_[np.nan_to_num((x - mean) / std), np.ones(600)]
    w = np.where(y[:400] == 1, 200 / y[:400].sum(), 200 / (400 - y[:400].sum())) if balanced else np.ones(400)
    fitted = mm.LogisticMasks(cs, balanced).prepare(train, NAMES, "label")
    got = fitted.fit(MASKS)
    want = []
    for m in MASKS:
        at = [*on(m), 5]
        for k, c in enumerate(cs):
            beta, penalty = np.zeros(len(at)), np.r_[np.ones(len(at) - 1), 0] / c
            for _ in range(60):
                p = 1 / (1 + np.exp(-z[:400, at] @ beta))
                grad = z[:400, at].T @ (w * (p - y[:400])) + penalty * beta
                beta = beta - np.linalg.solve((z[:400, at] * (w * p * (1 - p))[:, None]).T @ z[:400, at] + np.diag(penalty), grad)
            assert np.abs(got[m][k][at] - beta).max() < 1e-6 and not got[m][k][[i for i in range(5) if i not in at]].any()
            want += counts(m, k, y[400:], (z[400:, at] @ beta > 0).astype(int), g[400:])
    assert counted(fitted.confusion(valid, "grp", MASKS)) == sorted(want)
    bound = mm.LogisticMasks((0.01, 1.0), balanced, exact=0).prepare(train, NAMES, "label").fit([3, 31])
    assert all(np.abs(bound[m] - got[m][:2]).max() < 1e-5 for m in (3, 31))


def test_logistic_of_separable_rows(spark):
    """Full Newton steps would overshoot where the classes are far apart; halved ones don't."""
    rows = [(float(v), int(v > 0), 0) for v in [-50, -49, -1, 1, 2, 300]]
    df = spark.createDataFrame(rows, "a double, label int, grp int")
    got = mm.LogisticMasks((1000.0,)).prepare(df, ["a"], "label").fit([1])[1]
    assert np.isfinite(got).all() and got[0, 0] > 0
    with pytest.raises(ValueError):
        mm.LogisticMasks().prepare(df.where("label = 1"), ["a"], "label")


def grown(codes, y, weights, names, depth, size):
    """A tree on the same codes by recursion; gives the predictions of rows, by their codes."""
    n = np.array([(y == k).sum() for k in (0, 1)])
    vote = int(np.round(n * weights, 9).argmax())
    best = None
    if depth and (n > 0).all():
        purity = lambda m: ((m * weights) ** 2).sum() / (m * weights).sum() if m.sum() else 0.0
        for f in names:
            for code in range(size - 2):
                left = codes[:, f] <= code
                a = np.array([(left & (y == k)).sum() for k in (0, 1)])
                if 0 < left.sum() < len(y):
                    gain = round((purity(a) + purity(n - a) - purity(n)) / (n * weights).sum(), 12)
                    if gain > 0 and (best is None or gain > best[0]):
                        best = (gain, f, code)
    if best is None:
        return lambda c: np.full(len(c), vote)
    _, f, code = best
    left = codes[:, f] <= code
    a, b = grown(codes[left], y[left], weights, names, depth - 1, size), grown(codes[~left], y[~left], weights, names, depth - 1, size)
    return lambda c: np.where(c[:, f] <= code, a(c), b(c))


def test_trees(frames, table):
    import pandas as pd

    x, y, g = table
    train, valid = frames
    model = mm.TreeMasks((1, 2, 5), bins=12)
    fitted = model.prepare(train, NAMES, "label")
    got = counted(fitted.confusion(valid, "grp", MASKS))
    codes = fitted.bins.codes(pd.DataFrame(x, columns=NAMES)).astype(int)
    n = np.array([(y[:400] == k).sum() for k in (0, 1)])
    want = []
    for m in MASKS:
        for k, d in enumerate(model.depths):
            tree = grown(codes[:400], y[:400], 400 / (2 * n), on(m), d, fitted.bins.size)
            want += counts(m, k, y[400:], tree(codes[400:]), g[400:])
    assert got == sorted(want)
    # trees of many masks share nodes
    assert len(fitted.nodes) < sum(len(t) * 2 + 1 for t in fitted.trees.values())


def test_tree_passes(frames, monkeypatch):
    """The same trees where a pass holds only a few nodes."""
    train, valid = frames
    whole = counted(mm.TreeMasks((1, 3), bins=8).prepare(train, NAMES, "label").confusion(valid, "grp", [7, 31]))
    monkeypatch.setattr(mm, "PASS_NUMBERS", 200)
    assert counted(mm.TreeMasks((1, 3), bins=8).prepare(train, NAMES, "label").confusion(valid, "grp", [7, 31])) == whole


def test_bernoulli(frames, table):
    x, y, g = table
    train, valid = frames
    rows = train.na.fill(0.0), valid.na.fill(0.0)
    x = np.nan_to_num(x) > 0.5
    fitted = mm.BernoulliMasks((1.0, 5.0), 0.5).prepare(rows[0], NAMES, "label")
    want = []
    for m in MASKS:
        for k, a in enumerate((1.0, 5.0)):
            score = []
            for c in (0, 1):
                own = x[:400][y[:400] == c]
                p = (own.sum(axis=0) + a) / (len(own) + 2 * a)
                score.append(np.log(len(own) / 400) + np.where(x[400:], np.log(p), np.log(1 - p))[:, on(m)].sum(axis=1))
            want += counts(m, k, y[400:], (score[1] > score[0]).astype(int), g[400:])
    assert counted(fitted.confusion(rows[1], "grp", MASKS)) == sorted(want)


def test_labels_that_training_lacks(frames):
    train, valid = frames
    odd = valid.withColumn("label", F.when(F.col("row_id") % 10 == 0, 7).otherwise(F.col("label")))
    n = odd.where("label = 7").count()
    for model in (mm.TreeMasks((2,)), mm.LogisticMasks((1.0,))):
        rows = counted(model.prepare(train, NAMES, "label").confusion(odd, "grp", [31]))
        assert sum(r[5] for r in rows) == 200 and sum(r[5] for r in rows if r[2] == -1) == n


@pytest.mark.parametrize("options", [{}, {"penalty": 0.0, "least_gain": 0.3, "least_child": 2.0, "rate": 0.1}])
def test_boosting(frames, table, options):
    """Trees, margins and predictions as recursion over the rows makes them, with missing values on the side of more gain."""
    import pandas as pd

    x, y, _ = table
    train, valid = frames
    s = bo.Boosting(trees=11, depth=3, bins=10, **options)  # more trees than are added up again in a pass
    model = bo.fit_boosting(train, NAMES, "label", s, "row_id")
    bins = model.bins
    codes = bins.codes(pd.DataFrame(x, columns=NAMES)).astype(int)

    def grow(rows, g, h, depth):
        part = lambda at: g[at].sum() ** 2 / (h[at].sum() + s.penalty)
        best = None
        for f in range(5) if depth else ():
            for side in (False, True):
                for code in range(bins.size - 1):
                    left = codes[rows, f] <= code
                    if side:
                        left |= codes[rows, f] == bins.missing
                    a, b = rows[left], rows[~left]
                    if min(h[a].sum(), h[b].sum()) < max(s.least_child - 1e-9, 1e-12):
                        continue
                    gain = round(0.5 * (part(a) + part(b) - part(rows)) - s.least_gain, 9)
                    if gain > 0 and (best is None or gain > best[0]):
                        best = (gain, f, code, side)
        if best is None:
            value = -s.rate * g[rows].sum() / (h[rows].sum() + s.penalty)
            return lambda c: np.full(len(c), value)
        _, f, code, side = best
        goes = lambda c: (c[:, f] <= code) | (side & (c[:, f] == bins.missing))
        left = goes(codes[rows])
        a, b = grow(rows[left], g, h, depth - 1), grow(rows[~left], g, h, depth - 1)
        return lambda c: np.where(goes(c), a(c), b(c))

    margin = np.zeros(600)
    for _ in range(s.trees):
        p = 1 / (1 + np.exp(-margin))
        margin = margin + grow(np.arange(400), p - y, p * (1 - p), s.depth)(codes)
    assert np.abs(model.margins(pd.DataFrame(x, columns=NAMES)) - margin).max() < 1e-9
    got = {r.row_id: r.probability for r in model.score(valid).select("row_id", "probability").collect()}
    assert max(abs(got[i] - 1 / (1 + np.exp(-margin[i]))) for i in range(400, 600)) < 1e-9
    assert np.mean((margin[400:] > 0) == y[400:]) > 0.8


def test_boosting_shares(frames):
    """Shares of rows and features leave a model that still learns, the same one each time."""
    train, valid = frames
    s = bo.Boosting(trees=6, depth=3, bins=10, rows=0.7, columns=0.6, seed=3)
    a, b = (bo.fit_boosting(train, NAMES, "label", s, "row_id") for _ in range(2))
    assert [t.split for t in a.trees] == [t.split for t in b.trees]
    assert len({tuple(sorted({n.feature for n in t.nodes[1:]})) for t in a.trees}) > 1
    hit = sum(r.n for r in a.confusion(valid, NAMES, "label", "grp", 31).collect() if r.label == r.pred)
    assert hit > 150
    assert bo.fit_boosting(train, NAMES, "label", bo.Boosting(trees=2, depth=2, least_gain=1e9)).trees[1].split == {}


def test_spread_is_even():
    x = bo._spread(np.arange(20_000), 3)
    assert abs((x < 0.3).mean() - 0.3) < 0.02 and abs(np.corrcoef(x, bo._spread(np.arange(20_000), 4))[0, 1]) < 0.03


def test_search_takes_models_and_scorers(frames):
    train, valid = frames
    train, valid = train.na.fill(0.0), valid.na.fill(0.0)
    hard = Constraints(accuracy=0.99, fairness=0.9)
    plain = Search(train, valid, NAMES, "label", "grp", hard)
    STRATEGIES["forward"](plain)
    rows = {r.mask: r for r in evaluate_masks(train, valid, NAMES, "label", "grp", list(plain.trials), hard).collect()}
    assert all(rows[m].loss == t["loss"] for m, t in plain.trials.items())
    balance = lambda tp, fp, fn, tn: (tp / (tp + fn) + tn / (tn + fp)) / 2
    for model in (mm.TreeMasks((1, 2, 3), 8), mm.LogisticMasks((0.1, 10.0)), mm.BernoulliMasks(), bo.BoostingMasks((bo.Boosting(trees=2, depth=2, bins=6),))):
        for scorer in ("f1", balance):
            s = Search(train, valid, NAMES[:3], "label", "grp", Constraints(accuracy=0.99, fairness=0.9), model=model, scorer=scorer)
            STRATEGIES["forward_floating" if scorer == "f1" else "full_set"](s)
            for t in s.trials.values():
                score = t["f1"] if scorer == "f1" else t["score"]
                assert abs(t["loss"] - max(0, 0.99 - score) ** 2 - max(0, 0.9 - t["fairness"]) ** 2) < 1e-9
            assert s.table().count() == len(s.trials)
    names, trials = query(train, valid, valid, NAMES[:3], "label", "grp", Constraints(accuracy=0.6), "forward", mm.TreeMasks((2,), 8))
    assert names and trials.count() == 3
    s = Search(train, valid, NAMES, "label", "grp", hard, model=mm.TreeMasks((3,), 8))
    rfe(s, lambda names: {f: NAMES.index(f) for f in names})
    assert sorted(s.trials) == [16, 24, 28, 30, 31]
