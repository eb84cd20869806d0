"""Queries without SQL cover all of their rows, classes and strategies."""

import inspect
import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from sievecraft.operators import discretize, neighbours, search
from sievecraft.operators.rank import rank_permutation_importance, rank_relieff
from sievecraft.operators.select import nearest
from sievecraft.operators.sample import oversample_minority
from sievecraft.plans import q_runlog

SF = "/root/testdata/sf0.001"
tables = pytest.mark.skipif(not os.path.isdir(SF), reason="no tables")


@tables
def test_all_strategies_are_planned(spark):
    runs = spark.read.parquet(f"{SF}/events.parquet")
    names = {r[0] for r in runs.select("event_type").distinct().collect()}
    scenarios = runs.selectExpr("user_id % 40 AS s").distinct().count()
    assert len(names) == 5
    planned = q_runlog.plan_strategies(spark, SF).collect()
    assert len(planned) == scenarios * len(names) and {r.strategy for r in planned} == names
    best = {}
    for r in planned:
        best[r.scenario] = max(best.get(r.scenario, (-1.0, "")), (r.probability, r.strategy))
    assert {r.scenario: (r.probability, r.strategy) for r in q_runlog.choose_strategy(spark, SF).collect()} == best
    assert {r.strategy for r in q_runlog.explain_choice(spark, SF).collect()} == names


def points(spark, n, seed=5):
    """Rows with many equal ones, and their arrays."""
    rng = np.random.default_rng(seed)
    x = np.column_stack([rng.integers(0, 8, n).astype(float), rng.integers(0, 30, n) / 10, rng.random(n).round(2)])
    x[: n // 4] = x[0]
    y = rng.integers(0, 3, n) // 2
    rows = [(int(i) * 7 % (n * 7 + 1), int(c), *map(float, v)) for i, (c, v) in enumerate(zip(y, x))]
    return spark.createDataFrame(rows, "row_id long, label int, a double, b double, c double"), rows


def near(rows, of, k, power, group=None):
    diffs = [[abs(of[2 + j] - r[2 + j]) for j in range(3)] for r in rows]
    length = (lambda d: d[0] + d[1] + d[2]) if power == 1 else (lambda d: np.sqrt(d[0] * d[0] + d[1] * d[1] + d[2] * d[2]))
    return sorted((length(d), r[0], d) for d, r in zip(diffs, rows) if r[0] != of[0] and (group is None or r[1] == group))[:k]


@pytest.mark.parametrize("box,top", [(2000, 4096), (20, 4096), (20, 4), (20, 1), (4, 2)])
def test_every_row_has_its_nearest(spark, monkeypatch, box, top):
    monkeypatch.setattr(neighbours, "BOX", box)
    monkeypatch.setattr(neighbours, "TOP", top)
    df, rows = points(spark, 300)
    got = {}
    for r in nearest(df, None, ["a", "b", "c"], "row_id", 4).collect():
        got[r.anchor, r["rank"]] = (r.id, r.dist)
    want = {(r[0], i + 1): (id, d) for r in rows for i, (d, id, _) in enumerate(near(rows, r, 4, 2))}
    assert got == want


def test_what_the_driver_holds_of_the_boxes_is_bounded(spark, monkeypatch):
    """Small boxes in few top boxes: the sample and the rows of reaches stay those of the top boxes."""
    monkeypatch.setattr(neighbours, "BOX", 10)
    monkeypatch.setattr(neighbours, "TOP", 4)
    seen = []
    boxes = neighbours.Boxes
    monkeypatch.setattr(neighbours, "Boxes", lambda sample, leaves: seen.append((len(sample), leaves)) or boxes(sample, leaves))
    df = spark.range(5000).selectExpr("id", "cast(id % 71 as double) AS a", "cast(id as double) AS b")
    nearest(df, None, ["a", "b"], "id", 3)
    assert seen[0][1] == 4 and seen[0][0] <= 2 * neighbours.PER_BOX * 4


def test_a_box_with_fewer_rows_than_wanted_is_bounded_by_the_sample(spark):
    """Anchors far from all rows, more neighbours than a box of theirs holds, and anchors without any row near."""
    rng = np.random.default_rng(3)
    x = np.concatenate([rng.normal(0, 1, (300, 2)), rng.normal(50, 1, (3, 2))])
    rows = spark.createDataFrame([(i, *map(float, v)) for i, v in enumerate(x)], "id long, a double, b double")
    far = [(1000 + i, 200.0 + i, -70.0) for i in range(3)]
    anchors = spark.createDataFrame([(i, *map(float, v)) for i, v in enumerate(x) if i % 7 == 0 or i >= 300] + far, "id long, a double, b double")
    with pytest.MonkeyPatch.context() as m:
        m.setattr(neighbours, "BOX", 1)
        got = {(r.anchor, r["rank"]): r.id for r in nearest(rows, anchors, ["a", "b"], "id", 6).collect()}
    for a in anchors.collect():
        d = np.sqrt((x[:, 0] - a.a) ** 2 + (x[:, 1] - a.b) ** 2)
        want = [int(i) for i in np.lexsort((np.arange(len(x)), d)) if i != a.id][:6]
        assert [got[a.id, j] for j in range(1, 7)] == want


@pytest.mark.parametrize("box,top", [(2000, 4096), (20, 4096), (20, 2)])
def test_relieff_of_every_row(spark, monkeypatch, box, top):
    monkeypatch.setattr(neighbours, "BOX", box)
    monkeypatch.setattr(neighbours, "TOP", top)
    df, rows = points(spark, 300)
    x = np.array([r[2:] for r in rows])
    scaled = [(*r[:2], *v) for r, v in zip(rows, (x - x.min(0)) / (x.max(0) - x.min(0)))]
    share = {c: np.mean([r[1] == c for r in rows]) for c in (0, 1)}
    want = np.zeros(3)
    for r in scaled:
        for c in (0, 1):
            weight = -1.0 if r[1] == c else share[c] / (1 - share[r[1]])
            want += weight * np.sum([d for _, _, d in near(scaled, r, 5, 1, c)], axis=0) / (5 * len(rows))
    got = {r.feature: r.score for r in rank_relieff(df, ["a", "b", "c"], "label", "row_id", k=5).collect()}
    assert np.allclose([got[f] for f in "abc"], want, rtol=1e-9, atol=1e-12)


def test_relieff_of_some_anchors(spark):
    df, rows = points(spark, 300)
    x = np.array([r[2:] for r in rows])
    scaled = [(*r[:2], *v) for r, v in zip(rows, (x - x.min(0)) / (x.max(0) - x.min(0)))]
    share = {c: np.mean([r[1] == c for r in rows]) for c in (0, 1)}
    some = [r for r in scaled if r[0] % 3 == 0]
    want = np.zeros(3)
    for r in some:
        for c in (0, 1):
            weight = -1.0 if r[1] == c else share[c] / (1 - share[r[1]])
            want += weight * np.sum([d for _, _, d in near(scaled, r, 5, 1, c)], axis=0) / (5 * len(some))
    out = rank_relieff(df, ["a", "b", "c"], "label", "row_id", anchors=F.col("row_id") % 3 == 0, k=5)
    assert np.allclose([{r.feature: r.score for r in out.collect()}[f] for f in "abc"], want, rtol=1e-9, atol=1e-12)


def test_every_minority_row_gets_synthetic_rows(spark):
    df = spark.range(4000).selectExpr("id", "cast(id % 97 as double) AS a", "cast(id as double) AS b", "cast(id % 3 = 0 as int) AS y")
    minority = df.where("y = 1").count()
    for rows in (minority + 10, 4000 - 2 * minority, 7 * minority + 1):
        out = oversample_minority(df, ["a", "b"], "y", "id", 1, rows=rows).collect()
        per = {}
        for r in out:
            per[r.anchor] = per.get(r.anchor, 0) + 1
        assert len(out) == rows and len(per) == min(rows, minority) and max(per.values()) - min(per.values()) <= 1
        assert all(r.anchor % 3 == 0 and r.id % 3 == 0 and r.anchor != r.id and min(r.anchor, r.id) <= r.b <= max(r.anchor, r.id) for r in out)
    assert len(set(out)) > 0.9 * len(out)
    assert len(oversample_minority(df, ["a", "b"], "y", "id", 1, 3).collect()) == 3 * minority


class Tried:
    def __init__(self, *args):
        self.trials = {m: {"mask": m, "loss": m, "size": 1, "satisfied": True} for m in range(1, 101)}

    def table(self):
        return None


@pytest.mark.parametrize("passing,names", [(33, ["f0", "f5"]), (100, ["f2", "f5", "f6"]), (1, ["f0"]), (0, [])])
def test_query_verifies_until_a_mask_passes(monkeypatch, passing, names):
    class Held(list):
        collect = list.copy

    monkeypatch.setattr(search, "Search", Tried)
    monkeypatch.setattr(search, "evaluate_masks", lambda *a: Held({"mask": m, "satisfied": m == passing} for m in a[5]))
    assert search.query(None, None, None, [f"f{i}" for i in range(7)], "y", "g", None, lambda s: None)[0] == names


def test_cuts_have_no_level_limit(spark, monkeypatch):
    df = spark.createDataFrame([(float(i), i % 2) for i in range(30)], "v double, y int")
    level = iter(range(30))
    step = lambda *_: spark.sql(f"SELECT 0 AS segment, {(i := next(level))}.5D AS cut, 1D AS gain, {i < 20} AS accepted")
    monkeypatch.setattr(discretize, "cut_gains", step)
    assert discretize.mdlp_cuts(df, "v", "y") == [i + 0.5 for i in range(20)]


def test_permutation_importance_is_a_mean_of_five():
    assert inspect.signature(rank_permutation_importance).parameters["repeats"].default == 5


def test_relieff_searches_equal_rows_once(spark, monkeypatch):
    """Forty copies of each row: as many queries as there are rows of a class with different features, and the brute-force result."""
    few, _ = points(spark, 60)
    df = few.crossJoin(spark.range(40).withColumnRenamed("id", "copy")).selectExpr("row_id + 1000 * copy AS row_id", "label", "a", "b", "c").cache()
    rows = [tuple(r) for r in df.collect()]
    x = np.array([r[2:] for r in rows])
    x = (x - x.min(0)) / (x.max(0) - x.min(0))
    y, ids = np.array([r[1] for r in rows]), np.array([r[0] for r in rows])
    want = np.zeros(3)
    for i in range(len(rows)):
        diff = np.abs(x - x[i])
        dist = diff[:, 0] + diff[:, 1] + diff[:, 2]
        for c in (0, 1):
            near = [j for j in np.lexsort((ids, dist)) if y[j] == c and j != i][:5]
            weight = -1.0 if y[i] == c else np.mean(y == c) / (1 - np.mean(y == y[i]))
            want += weight * diff[near].sum(axis=0) / (5 * len(rows))
    asked, search = [], neighbours.each_box
    monkeypatch.setattr(neighbours, "each_box", lambda queries, *more: asked.append(queries.count()) or search(queries, *more))
    got = {r.feature: r.score for r in rank_relieff(df, ["a", "b", "c"], "label", "row_id", k=5).collect()}
    assert asked == [few.select("label", "a", "b", "c").distinct().count()] * 2
    assert np.allclose([got[f] for f in "abc"], want, rtol=1e-9, atol=1e-12)
