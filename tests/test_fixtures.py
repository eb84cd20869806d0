"""Small inputs with known results."""

import math

import pytest
from pyspark.sql import functions as F

from sievecraft.functions import categorical as cat
from sievecraft.functions import numeric as num
from sievecraft.functions import text as txt
from sievecraft.functions import window as win
from sievecraft.operators import catalog as cg
from sievecraft.operators import discretize as dz
from sievecraft.operators import evaluate as ev
from sievecraft.operators import rank as rk
from sievecraft.operators import sample as sm
from sievecraft.operators import select as sel

FAIR = [
    ([("good", "good", "m"), ("bad", "bad", "m"), ("good", "bad", "f"), ("bad", "bad", "f")], 0.5),
    ([("good", "good", "m"), ("bad", "bad", "m"), ("good", "good", "f"), ("bad", "bad", "f")], 0.0),
    ([("good", "good", "m"), ("bad", "good", "m"), ("good", "good", "f"), ("bad", "good", "f")], 0.0),
    ([("good", "bad", "m"), ("bad", "bad", "m"), ("good", "bad", "f"), ("bad", "bad", "f")], 0.0),
    ([("good", "good", "m"), ("bad", "bad", "m"), ("good", "bad", "m"), ("bad", "bad", "m")], 0.0),
    ([("good", "bad", "m"), ("bad", "bad", "m"), ("good", "good", "f"), ("bad", "bad", "f")], 0.5),
    ([("good", "bad", "m"), ("bad", "bad", "m"), ("bad", "bad", "m"), ("good", "good", "f"), ("bad", "bad", "f"), ("bad", "bad", "f")], 1 / 3),
]


@pytest.mark.parametrize("rows,gap", FAIR)
def test_fairness(spark, rows, gap):
    df = spark.createDataFrame([(int(y == "good"), int(p == "good"), int(g == "f")) for y, p, g in rows], "label int, pred int, grp int")
    got = ev.metrics(df.groupBy("label", "pred", "grp").agg(F.count("*").alias("n")), []).first().fairness
    assert math.isclose(1 - got, gap, abs_tol=1e-12)


def column(spark, values, kind="double"):
    return spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, x {kind}")


def values(df, expr):
    return [r[0] for r in df.orderBy("i").select(expr).collect()]


def test_unary(spark):
    df = column(spark, [-1.0, 1.0, 0.0, 1.0, 3.0, -100.0])
    assert values(df, num.UNARY["binarize"](F.col("x"))) == [0, 1, 0, 1, 1, 0]
    df = column(spark, [-1.0, 1.0, None, 1.0, 3.0, -100.0])
    assert math.isclose(values(df, num.fit_impute(df, ["x"])["x"])[2], -19.2)
    x = num.filled(F.col("x"))
    assert values(df, F.array(F.lit(1.0), x, x * x))[2] == [1, -1, 1]


def test_bins(spark):
    df = column(spark, [1.0] * 8 + [222.0] * 2)
    assert values(df, num.fit_equi_width(df, ["x"])["x"]) == [0] * 8 + [9] * 2


def test_parse_numbers(spark):
    df = column(spark, ["12m", "12:33p.m.", "12 oz", "12.03.1990", None], "string")
    assert values(df, txt.parse_numbers(F.col("x"))) == [[12, 0, 0, 0, 0], [12, 33, 0, 0, 0], [12, 0, 0, 0, 0], [12, 3, 1990, 0, 0], [0] * 5]


def test_group_by_then(spark):
    df = spark.createDataFrame([(float(i), "ab"[(i + 1) % 2]) for i in range(1, 7)], "v double, k string")
    got = cat.group_by_then(df, df, "v", "k", "max", "m").orderBy("v").collect()
    assert [r.m for r in got] == [5, 6, 5, 6, 5, 6]
    unseen = cat.group_by_then(df.where("k = 'a'"), df, "v", "k", "std", "m").where("k = 'b'").collect()
    assert {r.m for r in unseen} == {0.0}


def test_binned_mi(spark):
    df = spark.createDataFrame([(i, (i + 1) // 2) for i in range(1, 11)], "a int, b int")
    assert math.isclose(rk.binned_mutual_info(df, "a", "b", 5).first().mi, math.log2(5))


def test_scale_twice(spark):
    df = column(spark, [float((i * 37) % 101) for i in range(200)])
    once = df.select("i", num.fit_minmax(df, ["x"])["x"].alias("x"))
    twice = once.select("i", num.fit_minmax(once, ["x"])["x"].alias("x"))
    assert values(once, "x") == values(twice, "x")
    flat = column(spark, [4.0, 4.0, None])
    assert values(flat, num.fit_minmax(flat, ["x"])["x"]) == [0.0, 0.0, None]


def test_keys(spark):
    df = spark.range(1)
    key = lambda f: df.select(cg.canonical_groups(F.lit(f))).first()[0]
    assert key("min(min(x;y);y)") == "min(x;y)" and key("std(min(x;y);y)") == "0"
    assert df.select(cg.canonical(F.lit("minus"), F.lit("minus(x)"))).first()[0] == "x"


def test_splits_are_disjoint_and_exact(spark):
    df = spark.range(1000).select("id", (F.col("id") % 4 == 0).cast("int").alias("y"))
    got = sm.split(df, "id", "y").groupBy("y", "split").count().collect()
    assert {(r.y, r.split): r["count"] for r in got} == {(0, "train"): 450, (0, "valid"): 150, (0, "test"): 150, (1, "train"): 150, (1, "valid"): 50, (1, "test"): 50}
    folds = sm.kfold(df, "id", 5, "y").groupBy("fold").count().collect()
    assert {r["count"] for r in folds} == {200}


def test_ranks_with_ties_and_nulls(spark):
    df = column(spark, [3.0, 1.0, 3.0, None, 2.0])
    got = {r.i: r.r for r in win.rankdata(df, "x", "r").collect()}
    assert got == {0: 3.5, 1: 1.0, 2: 3.5, 3: None, 4: 2.0}


def test_mdlp_finds_the_step(spark):
    df = spark.range(200).select(F.col("id").cast("double").alias("x"), (F.col("id") >= 120).cast("int").alias("y"))
    assert dz.mdlp_cuts(df, "x", "y") == [119.5]


def test_cover_and_agreement(spark):
    covers = spark.createDataFrame([("a", 1), ("a", 2), ("b", 2), ("b", 3), ("b", 4), ("c", 4)], "feature string, row_id int")
    assert [(r.feature, r.newly) for r in sel.set_cover(covers, 3).orderBy("step").collect()] == [("b", 3), ("a", 1)]


def test_loss_of_an_empty_mask(spark):
    c = ev.Constraints(accuracy=0.9)
    got = spark.range(1).select(ev.constraint_loss(c, F.lit(0.5), F.lit(1.0), F.lit(0.0)), ev.constraint_loss(c, F.lit(0.5), F.lit(1.0), F.lit(0.5))).first()
    assert got[0] == 4.0 and math.isclose(got[1], 0.16)
