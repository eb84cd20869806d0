"""Tasks compute known operators from the features and give what Spark gives; other operators and types are computed by Spark."""

import numpy as np
import pytest

from sievecraft.operators import frontier as fr

OPS = ({"minus": "(-{0})", "log": "ln({0})", "one_div": "try_divide(1D, {0})", "square": "({0} * {0})"}, {"sum": "({0} + {1})", "prod": "({0} * {1})", "subtract": "({0} - {1})", "divide": "try_divide({0}, {1})"})


@pytest.fixture(scope="module")
def table(spark):
    rng = np.random.default_rng(3)
    x = np.round(rng.uniform(-2, 4, (400, 2)), 2)
    x[::13, 0] = 0
    rows = [(*map(float, r), int(r[0] * r[1] > 1), i) for i, r in enumerate(x)] + [(None, float("nan"), 1, 3), (float("inf"), -1.0, 0, 4)]
    return spark.createDataFrame(rows, "`a b` double, c double, label int, whole bigint").cache()


def test_arrays_give_what_spark_gives(table, monkeypatch):
    steps = []
    scored = fr.mutual_informations

    def watched(df, *more):
        steps.append(len(more) > 4 and more[5])
        return scored(df, *more)

    monkeypatch.setattr(fr, "mutual_informations", watched)
    rows = lambda: {r.key: (r.step, r.score) for r in fr.expand(table, ["a b", "c"], "label", *OPS, "best", 2, 4).collect()}
    got = rows()
    assert steps and all(steps)  # no round had its expressions computed by Spark
    monkeypatch.setattr(fr, "ARRAYS", {})
    plain = rows()
    assert not any(steps[-2:])
    assert got.keys() == plain.keys() and len(got) > 40
    assert all(got[k][0] == plain[k][0] and abs(got[k][1] - plain[k][1]) < 1e-9 for k in got)


def test_other_types_and_operators_stay_with_spark(table):
    raw = [fr.Step(f, "", ()) for f in ("c", "whole")]
    known = {x.key: x for x in raw}
    made = lambda template, *parents: fr.Step("made", template, parents)
    assert fr.array_steps([made("ln({0})", "c")], known, table)
    assert fr.array_steps([made("ln({0})", "whole")], known, table) is None
    assert fr.array_steps([made("abs({0})", "c")], known, table) is None
    assert fr.array_steps([made("ln({0})", "unknown")], known, table) is None


def test_logarithms_are_those_of_spark_to_the_last_bit(spark):
    rng = np.random.default_rng(5)
    x = np.r_[rng.uniform(0, 2, 20000), np.exp(rng.uniform(-700, 700, 20000)), 1 + rng.uniform(-1e-5, 1e-5, 5000), np.arange(1, 3000) / 100, 2.0 ** np.arange(-1074, 1024), np.sqrt(0.5) + np.arange(-50, 50) * 2.0**-53]
    rows = spark.createDataFrame([(float(v),) for v in x], "x double").selectExpr("x", "ln(x) AS y").toPandas()
    assert (fr.ln(rows["x"].to_numpy()) == rows["y"].to_numpy()).all()
    with np.errstate(all="ignore"):
        rest = fr.ln(np.array([0.0, -0.0, -1.0, np.nan, -np.inf, np.inf]))
    assert np.isnan(rest[:5]).all() and rest[5] == np.inf
