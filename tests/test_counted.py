"""Equal rows are gone through once, with their number, and change no result."""

import numpy as np
import pytest

from sievecraft.operators import boosting as bo
from sievecraft.operators import mask_models as mm
from sievecraft.operators import usefulness as us
from sievecraft.scratch import ROWS

NAMES = ["a", "b"]


@pytest.fixture(scope="module")
def tables(spark):
    few = spark.range(150).selectExpr("cast(id % 13 as double) AS a", "cast(id * id % 29 as double) AS b", "cast(id % 13 + id * id % 29 > 20 as int) AS label", "cast(id % 2 as int) AS grp")
    return few.cache(), few.crossJoin(spark.range(8).withColumnRenamed("id", "copy")).drop("copy").cache()


def counts(df, by):
    return {(r.mask, r.setting, r.label, r.pred, r.grp): by * r.n for r in df.collect()}


@pytest.mark.parametrize("model", [mm.TreeMasks((1, 3), 8), mm.LogisticMasks((1e6,))])
def test_models_of_masks(tables, model):
    few, many = tables
    one, other = model.prepare(few, NAMES, "label"), model.prepare(many, NAMES, "label")
    if isinstance(model, mm.LogisticMasks):  # C weighs the sum of all rows
        other.model = mm.LogisticMasks((1e6 / 8,))
    read = other.coded if isinstance(model, mm.TreeMasks) else other.train
    assert read.count() <= few.select(*NAMES, "label").distinct().count() and read.agg({ROWS: "sum"}).first()[0] == many.count()
    assert counts(other.confusion(many, "grp", [1, 2, 3]), 1) == counts(one.confusion(few, "grp", [1, 2, 3]), 8)
    assert other.held[1].count() <= few.distinct().count()


def test_boosting_of_copies(tables, monkeypatch):
    few, many = tables
    seen, counted = [], bo.counted
    monkeypatch.setattr(bo, "counted", lambda *a: seen.append(counted(*a)) or seen[-1])
    # sums are eight times as large, so the penalty is as well
    one = bo.fit_boosting(few, NAMES, "label", bo.Boosting(3, 2, penalty=1.0, bins=8))
    monkeypatch.setattr(bo, "discard", lambda df: None)
    other = bo.fit_boosting(many, NAMES, "label", bo.Boosting(3, 2, penalty=8.0, least_child=8.0, bins=8))
    assert seen[-1].count() <= few.select(*NAMES, "label").distinct().count()
    assert counts(other.confusion(many, NAMES, "label", "grp", 3), 1) == counts(one.confusion(few, NAMES, "label", "grp", 3), 8)


def test_gains_of_copies(tables, monkeypatch):
    few, many = tables
    read, found = [], us._correlations
    monkeypatch.setattr(us, "_correlations", lambda df, *more: read.append(df.count()) or found(df, *more))
    ops = {"square": "{0} * {0}", "log": "ln({0})"}
    rows = lambda df: {(r.column, r.target, r.op): (r.gain, r.correlation) for r in us.examples(df, NAMES, ["label"], ops).collect()}
    got, want = rows(many), rows(few)
    assert few.select(*NAMES, "label").distinct().count() in read
    assert got.keys() == want.keys() and all(np.allclose(got[k], want[k], atol=1e-9) for k in got)
