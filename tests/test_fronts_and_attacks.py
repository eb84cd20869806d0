"""Skylines, private trees and the boundary attack against plain numpy."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from sievecraft.operators import attack as at
from sievecraft.operators import evaluate as ev
from sievecraft.operators import private_trees as pt
from sievecraft.operators import select as sel


def dominated(x, by):
    out = np.zeros(len(x), dtype=bool)
    for i in range(0, len(x), 500):
        part = x[i : i + 500, None]
        out[i : i + 500] = ((by[None] >= part).all(axis=2) & (by[None] > part).any(axis=2)).any(axis=1)
    return out


@pytest.mark.parametrize("axes", [3, 4])
def test_small_fronts(spark, axes):
    rng = np.random.default_rng(axes)
    x = rng.integers(0, 9, (400, axes)).astype(float)
    names = [f"x{i}" for i in range(axes)]
    rows = [(i, *map(float, r)) for i, r in enumerate(x)] + [(1000, None, *[99.0] * (axes - 1)), (1001, float("nan"), *[99.0] * (axes - 1)), (1002, *map(float, x[0]))]
    df = spark.createDataFrame(rows, "id long, " + ", ".join(f"{n} double" for n in names)).repartition(5)
    got = sorted(r.id for r in sel.pareto_front(df, "id", names).collect())
    keep = ~dominated(x, x)
    assert got == sorted([*np.flatnonzero(keep).tolist(), 1000, 1001, *([1002] if keep[0] else [])])
    assert sel.pareto_front(df.where("false"), "id", names).count() == 0
    assert sel.pareto_front(df.where("id = 3"), "id", names).count() == 1


def test_front_of_many_points(spark):
    """A hundred thousand points near a sphere, of which thousands stay; no nested-loop join in the plan."""
    rng = np.random.default_rng(4)
    x = np.abs(rng.standard_normal((100_000, 3)))
    x = np.round(x / np.linalg.norm(x, axis=1, keepdims=True) * rng.uniform(0.97, 1, (100_000, 1)), 4)
    df = spark.createDataFrame([tuple(map(float, r)) for r in x], "a double, b double, c double").repartition(4)
    front = sel.pareto_front(df, "a", ["a", "b", "c"])
    assert "NestedLoop" not in front._jdf.queryExecution().toString()
    got = np.array([tuple(r) for r in front.collect()])
    assert len(got) > 1000 and not dominated(np.unique(got, axis=0), got).any()
    kept = {tuple(r) for r in got}
    rest = np.array([r for r in np.unique(x, axis=0) if tuple(r) not in kept])
    assert len(rest) + len(kept) == len(np.unique(x, axis=0)) and dominated(rest, got).all()


def test_private_trees(spark):
    rng = np.random.default_rng(6)
    x, y = rng.uniform(0, 1, (500, 3)), rng.integers(0, 3, 500)
    rows = [(i, *map(float, r), int(c), 0) for i, (r, c) in enumerate(zip(x, y))] + [(900, None, 0.5, 0.5, 1, 1), (901, 0.1, 0.5, 0.5, None, 1)]
    df = spark.createDataFrame(rows, "row_id long, a double, b double, c double, y int, grp int").repartition(3)
    domains = {"a": (0.0, 1.0), "b": (0.0, 1.0), "c": (0.0, 1.0)}
    f = pt.fit_private_trees(df, ["a", "b", "c"], "y", domains, 0.5, trees=4, depth=3)
    of = {r.row_id: r.t for r in df.select("row_id", F.pmod(F.xxhash64("row_id"), F.lit(4)).alias("t")).collect()}
    counts = np.zeros((4, 8, 3), dtype=int)
    for r in rows:
        if r[4] is None:
            continue
        node, t = 0, of[r[0]]
        for _ in range(3):
            v = r[1 + f.trees.feature[t, node]]
            node = 2 * node + (1 if v is not None and v <= f.trees.point[t, node] else 2)
        counts[t, node - 7, r[4]] += 1
    assert (f.counts == counts).all() and f.counts.sum() == 501
    # splits lie in what is left of the domain: no leaf's region is empty
    for t in range(4):
        stack = [(0, dict(enumerate(domains.values())))]
        while stack:
            node, box = stack.pop()
            if node < 7:
                j, p = int(f.trees.feature[t, node]), f.trees.point[t, node]
                assert box[j][0] < p < box[j][1]
                stack += [(2 * node + 1, box | {j: (box[j][0], p)}), (2 * node + 2, box | {j: (p, box[j][1])})]
    rows = f.table(spark).collect()
    assert len(rows) == 32 and all(r.majority in (0, 1, 2) for r in rows)
    total = sum(r.n for r in f.confusion(df.where("y IS NOT NULL"), "y", "grp").collect())
    assert total == 501


def test_exponential_mechanism():
    draws = (np.arange(20_000) + 0.5) / 20_000
    share = lambda counts, e: np.bincount([pt.exponential_majority(np.array(counts), e, d) for d in draws], minlength=len(counts)) / len(draws)
    s = np.exp(-2 * 0.5)
    assert abs(share([5, 3, 0], 0.5)[0] - np.exp(0.25 / s) / (np.exp(0.25 / s) + 2)) < 1e-3
    assert np.allclose(share([0, 0], 0.5), 0.5, atol=1e-3) and share([1000, 0], 0.5)[0] > 0.9999
    assert np.allclose(share([4, 4, 1], 1e-9), 1 / 3, atol=1e-3)


def test_boundary_attack(spark):
    """Every walk ends at another prediction, nearer than the search along one line; the table gives what numpy gives."""
    rng = np.random.default_rng(2)
    x = rng.standard_normal((600, 3)) * [1, 5, 0.2]
    y = (x @ [1, 0.4, 5] > 0.3).astype(int)
    df = spark.createDataFrame([(i, *map(float, r), int(c), 0) for i, (r, c) in enumerate(zip(x, y))], "row_id long, a double, b double, c double, y int, grp int").repartition(3)
    names = ["a", "b", "c"]
    nb = ev.fit_nb(df, names, "y")
    predict = lambda v: (nb.log_likelihoods(v).sum(axis=2) + np.log(nb.prior)).argmax(axis=1)
    width = x.std(axis=0)
    points, far, found = at.boundary_points(x, np.arange(600), x[:100], predict, width)
    assert found.all() and (predict(points) != predict(x)).all()
    # along random lines, as far as the first of ten steps that turns the prediction
    way = rng.standard_normal((600, 3))
    way /= np.linalg.norm(way, axis=1, keepdims=True)
    line = np.full(600, np.inf)
    for k in range(10, 0, -1):
        line = np.where(predict(x + way * width * 0.4 * k) != predict(x), 0.4 * k, line)
    both = np.isfinite(line)
    assert both.sum() > 100 and far[both].mean() < line[both].mean()
    more = at.boundary_points(x, np.arange(600), x[:100], predict, width, queries=40)[1]
    assert more.mean() < far.mean()
    # the same whatever the batch
    again = np.concatenate([at.boundary_points(x[i : i + 7], np.arange(600)[i : i + 7], x[:100], predict, width)[0] for i in range(0, 600, 7)])
    assert np.array_equal(again, points)
    scale = dict(zip(names, width.tolist()))
    row = at.boundary_attack(df, names, "y", "row_id", predict, nb.labels, scale).first()
    ids = np.array([r.h for r in df.orderBy("row_id").select(F.xxhash64("row_id").alias("h")).collect()])
    pool = x[np.argsort(ids)[:256]]
    points, far, _ = at.boundary_points(x, ids, pool, predict, width)
    assert row.rows == 600 and abs(row.clean - (predict(x) == y).mean()) < 1e-12 and abs(row.attacked - (predict(points) == y).mean()) < 1e-12 and abs(row.distance - far.mean()) < 1e-9
    one = at.boundary_attack(df.where("y = 5"), names, "y", "row_id", predict, nb.labels, scale).first()
    assert one.safety is None
    flat = at.boundary_attack(df, names, "y", "row_id", lambda v: np.zeros(len(v), dtype=int), nb.labels, scale).first()
    assert flat.clean == flat.attacked and flat.distance is None
