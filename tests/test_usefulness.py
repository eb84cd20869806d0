"""Learned usefulness of transformations: gains by hand, and accuracy on columns that weren't learned from."""

import numpy as np
from pyspark.sql import functions as F

from sievecraft.operators import usefulness as us

OPS = {"square": "{0} * {0}", "log": "ln({0})", "one_div": "try_divide(1D, {0})"}


def test_gains_and_metafeatures_by_hand(spark):
    rng = np.random.default_rng(1)
    x = rng.uniform(-1, 5, (500, 2))
    x[::9, 1] = 0
    y = (x[:, 0] ** 2 > 4).astype(int)
    rows = [(float(a), None if i % 50 == 0 else float(b), int(c), 1) for i, ((a, b), c) in enumerate(zip(x, y))]
    df = spark.createDataFrame(rows, "a double, b double, y int, z int").repartition(3)
    values = {"a": x[:, 0], "b": np.array([np.nan if r[1] is None else r[1] for r in rows])}
    with np.errstate(all="ignore"):
        after = {"square": lambda v: v * v, "log": np.log, "one_div": lambda v: 1 / v}

        def corr(v, t):
            ok = np.isfinite(v)
            return abs(np.corrcoef(v[ok], t[ok])[0, 1])

        want = {(c, o): corr(f(values[c]), y) - corr(values[c], y) for c in values for o, f in after.items()}
    got = {(r.column, r.op, r.target): r.gain for r in us.gains(df, ["a", "b"], ["y", "z"], OPS).collect()}
    assert all(abs(got[c, o, "y"] - v) < 1e-9 for (c, o), v in want.items()) and all(got[c, o, "z"] == 0 for c, o in want)
    meta = {(r.column, r.target): r for r in us.metafeatures(df, ["a", "b"], ["y", "z"]).collect()}
    b = values["b"][~np.isnan(values["b"])]
    m = meta["b", "y"]
    assert abs(m.mean - b.mean()) < 1e-9 and abs(m.zeros - (b == 0).mean()) < 1e-9 and abs(m.negative - (b < 0).mean()) < 1e-9 and abs(m.correlation - corr(values["b"], y)) < 1e-9
    assert meta["a", "z"].correlation == 0 and meta["a", "z"].positives == 1
    found = {(r.column, r.op): r.useful for r in us.examples(df, ["a", "b"], ["y"], OPS, 0.01).collect()}
    assert found == {k: int(v > 0.01) for k, v in want.items()}


def test_rounds_learn(spark):
    """Columns of two shapes: the logarithm helps the skewed ones. Ten labels a round beat the more frequent answer on held-out columns."""
    rng = np.random.default_rng(2)
    n, names = 400, [f"x{i}" for i in range(24)]
    base = rng.standard_normal((n, len(names)))
    x = np.where(np.arange(len(names)) % 2 == 0, np.exp(1.5 * base), base + 6)
    ts = (base + 0.3 * rng.standard_normal((n, len(names))) > 0).astype(int)
    parts = []
    for i, c in enumerate(names):
        df = spark.createDataFrame([(float(a), int(b)) for a, b in zip(x[:, i], ts[:, i])], f"{c} double, t{i} int")
        parts.append([tuple(r) for r in us.examples(df, [c], [f"t{i}"], {"log": "ln({0})", "square": "{0} * {0}"}, 0.01).collect()])
    schema = "column string, target string, " + ", ".join(f"{m} double" for m in us.META) + ", op string, gain double, useful int"
    every = spark.createDataFrame([r for p in parts for r in p], schema)
    held = F.substring("column", 2, 9).cast("int") >= 16
    asked = []

    def label(df):
        asked.append(df.count())
        return df.drop("useful").join(every.select("column", "target", "op", "useful"), ["column", "target", "op"])

    out = us.active_rounds(every.where(~held), every.where(held), ["log", "square"], rounds=3, batch=6, first=8, label=label).orderBy("round").collect()
    assert [r.labelled for r in out] == [8, 14, 20] and asked == [8, 6, 6, 6]
    assert out[-1].accuracy > out[-1].majority and out[-1].accuracy >= 0.9
