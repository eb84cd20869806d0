"""What trees and quantiles read of a table with copies: different rows."""

import numpy as np
import pytest

from sievecraft.functions import window
from sievecraft.operators import mask_models as mm
from sievecraft.scratch import counted

@pytest.fixture(scope="module")
def few(spark):
    rng = np.random.default_rng(11)
    x = np.round(rng.normal(size=(120, 2)), 1)
    rows = [(float(a), float(b) if b < 1.5 else None, int(a > b), i % 2) for i, (a, b) in enumerate(x)]
    return spark.createDataFrame(rows, "a double, b double, label int, grp int")


def test_quantiles_of_counted_rows(spark, few):
    shares = [0.0, 0.1, 0.37, 0.5, 0.9, 1.0]
    uneven = few.unionByName(few.where("a > 0")).unionByName(few.where("b < 0.3"))
    assert window.exact_quantiles(counted(uneven), ["a", "b"], shares) == window.exact_quantiles(uneven, ["a", "b"], shares)


def test_trees_read_different_rows(spark, few, monkeypatch):
    many = few.crossJoin(spark.range(5).withColumnRenamed("id", "copy"))
    seen, of = [], mm.Bins.of.__func__
    monkeypatch.setattr(mm.Bins, "of", classmethod(lambda cls, df, *more: seen.append(df.count()) or of(cls, df, *more)))
    model = mm.TreeMasks((2, 3), 8)
    rows = []
    for table, times in ((few, 1), (many, 5)):
        fitted = model.prepare(table, ["a", "b"], "label")
        rows.append(sorted((r.mask, r.setting, r.label, r.pred, r.grp, r.n / times) for r in fitted.confusion(table, "grp", [1, 2, 3]).collect()))
    assert seen == [few.select("a", "b", "label").distinct().count()] * 2 and rows[0] == rows[1]
