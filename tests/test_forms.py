"""Prints of forms against evaluation, and searches over them against a plain loop."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from sievecraft.operators import forms as fm
from sievecraft.operators import frontier as fr

NAMES = ["a", "b", "c"]


def pairs(x, y, ops):
    """All forms op(x, y) of two tables of forms."""
    node = lambda p: F.struct("key", "op", "args", "expr", "complexity", "raw", "print").alias(p)
    each = F.explode(F.array(*[F.struct(F.lit(o).alias("op"), F.lit(t).alias("template")) for o, t in ops.items()]))
    both = x.select(node("a")).crossJoin(y.select(node("b"))).select("a", "b", each.alias("o"))
    return both.select(*fm._pair("a", "b"))


BINARY = {"sum": "({0} + {1})", "prod": "({0} * {1})", "subtract": "({0} - {1})", "divide": "try_divide({0}, {1})", "max": "greatest({0}, {1})"}
UNARY = {"minus": "(-{0})", "square": "({0} * {0})", "one_div": "try_divide(1D, {0})", "log": "ln(abs({0}) + 1D)"}


def test_shapes_that_meet(spark):
    raw = fm.raw_forms(spark, NAMES)
    two = pairs(raw, raw, {k: BINARY[k] for k in ("sum", "prod")}).cache()
    three = pairs(two, raw, {k: BINARY[k] for k in ("sum", "prod")}).unionByName(pairs(raw, two, {k: BINARY[k] for k in ("sum", "prod")}))
    four = pairs(two, two, {"sum": BINARY["sum"]})
    rows = {(tuple(r.parents), r.op): r for r in three.unionByName(four).collect()}
    a = rows[("a", "sum(b,c)"), "sum"]
    b = rows[("sum(a,c)", "b"), "sum"]
    assert a.key == b.key == "sum(a,b,c)" and a.print == b.print
    c = rows[("prod(a,b)", "prod(a,c)"), "sum"]
    d = rows[("a", "sum(b,c)"), "prod"]
    assert c.key == "sum(prod(a,b),prod(a,c))" and d.key == "prod(a,sum(b,c))" and c.print == d.print != a.print


def test_prints_against_evaluation(spark):
    """Forms share a print just when they have the same values at random points."""
    raw = fm.raw_forms(spark, NAMES)
    one = raw.unionByName(fm.unary_forms(raw, UNARY)).unionByName(pairs(raw, raw, BINARY))
    two = one.unionByName(fm.unary_forms(one, UNARY)).unionByName(pairs(one, raw, BINARY)).where("print IS NOT NULL").dropDuplicates(["key"])
    rows = two.collect()
    assert len(rows) > 400
    rng = np.random.default_rng(3)
    df = spark.createDataFrame([tuple(map(float, r)) for r in rng.uniform(0.5, 3, (7, 3))], "a double, b double, c double")
    values = np.array(df.select(*[F.expr(r.expr).alias(f"x{i}") for i, r in enumerate(rows)]).collect(), dtype=float)
    assert not np.isnan(values).any()
    by_print, by_value = {}, {}
    for i, r in enumerate(rows):
        by_print.setdefault(tuple(r.print), []).append(r.key)
    order = np.lexsort(np.round(values, 7)[::-1])
    groups, last = [], None
    for i in order:
        if last is not None and np.allclose(values[:, i], values[:, last], rtol=1e-9, atol=1e-9):
            groups[-1].append(rows[i].key)
        else:
            groups.append([rows[i].key])
        last = i
    # max(a,a) is a for values, a random function for prints: such forms may be told apart, never the other way round
    at = {k: i for i, g in enumerate(groups) for k in g}
    assert all(len({at[k] for k in g}) == 1 for g in by_print.values())
    plain = lambda k: "max" not in k and "log" not in k
    where = {k: i for i, g in enumerate(by_print.values()) for k in g}
    assert all(len({where[k] for k in g if plain(k)}) <= 1 for g in groups)


def test_division_by_zero_and_constants(spark):
    raw = fm.raw_forms(spark, NAMES)
    zero = pairs(raw, raw, {"subtract": BINARY["subtract"]}).where("key = 'subtract(a,a)'")
    assert set(zero.first().print) == {0}
    assert fm.unary_forms(zero, {"one_div": UNARY["one_div"]}).first().print is None
    one = pairs(raw, raw, {"divide": BINARY["divide"]}).where("key = 'divide(b,b)'")
    assert set(one.first().print) == {1}
    both = fm.new_forms(zero.unionByName(one).unionByName(fm.unary_forms(zero, UNARY)).unionByName(fm.unary_forms(raw, {"minus": UNARY["minus"]})), raw)
    assert sorted(r.key for r in both.collect()) == ["minus(a)", "minus(b)", "minus(c)"]
    back = fm.unary_forms(fm.unary_forms(raw, {"minus": UNARY["minus"]}), {"minus": UNARY["minus"]})
    assert fm.new_forms(back, raw).count() == 0
    twice = fm.unary_forms(fm.unary_forms(raw, {"scale": "{0}"}), {"scale": "{0}"})
    assert {tuple(r.print) for r in twice.collect()} == {tuple(r.print) for r in fm.unary_forms(raw, {"scale": "{0}"}).collect()}


@pytest.fixture(scope="module")
def table(spark):
    rng = np.random.default_rng(8)
    x = np.round(rng.uniform(-2, 4, (300, 3)), 2)
    x[::17, 1] = 0
    y = (x[:, 0] * x[:, 1] + x[:, 2] > 2).astype(int)
    rows = [(*map(float, r), int(k)) for r, k in zip(x, y)] + [(None, float("nan"), float("inf"), 1)]
    return spark.createDataFrame(rows, "a double, b double, c double, label int").repartition(3).cache()


def information(values, labels, bins=10):
    """Mutual information by the definition."""
    x = np.array([v if v is not None and math.isfinite(v) else np.nan for v in values])
    ok = ~np.isnan(x)
    lo, hi = x[ok].min(), x[ok].max()
    b = np.where(ok, np.clip(np.floor((np.where(ok, x, lo) - lo) / ((hi - lo) / bins if hi > lo else 1)), 0, bins - 1), bins)
    n, total = len(x), 0.0
    for i in set(b):
        for k in set(labels):
            p = np.mean((b == i) & (labels == k))
            if p:
                total += p * np.log2(p / (np.mean(b == i) * np.mean(labels == k)))
    return total if n else 0.0


OPS = ({"minus": UNARY["minus"], "log": "ln({0})"}, {k: BINARY[k] for k in ("sum", "prod", "subtract", "divide")})


@pytest.mark.parametrize("how", ["best", "depth", "harmonic"])
def test_expansions_against_a_plain_loop(table, how):
    """Three rounds of one node each: the same nodes, forms and scores as a loop over lists makes."""
    got = {r.key: r for r in fr.expand(table, NAMES, "label", *OPS, how, 3, 1).collect()}
    labels = np.array([r.label for r in table.collect()])
    score = lambda e: information([r[0] for r in table.select(F.expr(e).cast("double")).collect()], labels)
    nodes = {f: dict(expr=f, complexity=1, step=0, score=score(f), op="raw", args=[f]) for f in NAMES}
    done = set()
    for step in (1, 2, 3):
        top = max(n["score"] for n in nodes.values())
        value = {"best": lambda n: (n["score"],), "depth": lambda n: (n["step"], n["score"]), "harmonic": lambda n: (2 * (n["score"] / top) / n["complexity"] / (n["score"] / top + 1 / n["complexity"]),)}[how]
        key = min((k for k in nodes if k not in done), key=lambda k: (*[-round(v, 9) for v in value(nodes[k])], nodes[k]["complexity"], k))
        done.add(key)
        node = nodes[key]
        made = {f"{o}({key})": dict(expr=t.replace("{0}", node["expr"]), complexity=node["complexity"] + 1, op=o, args=[key]) for o, t in OPS[0].items()}
        for f in NAMES:
            if f == key:
                continue
            for o, t in OPS[1].items():
                inner = node["args"] if node["op"] == o else [key]
                if o in ("sum", "prod"):
                    args = sorted([*inner, f])
                    made[f"{o}({','.join(args)})"] = dict(expr=t.replace("{0}", node["expr"]).replace("{1}", f), complexity=node["complexity"] + 2, op=o, args=args)
                else:
                    made[f"{o}({key},{f})"] = dict(expr=t.replace("{0}", node["expr"]).replace("{1}", f), complexity=node["complexity"] + 2, op=o, args=[key, f])
                    made[f"{o}({f},{key})"] = dict(expr=t.replace("{0}", f).replace("{1}", node["expr"]), complexity=node["complexity"] + 2, op=o, args=[f, key])
        for k, n in made.items():
            if k in got and k not in nodes:
                nodes[k] = n | {"step": step, "score": score(n["expr"])}
    assert set(nodes) == set(got)
    for k, n in nodes.items():
        assert (got[k].step, got[k].complexity) == (n["step"], n["complexity"]) and abs(got[k].score - n["score"]) < 1e-9
    assert max(r.step for r in got.values()) == 3


def test_chunks_and_ends(table, monkeypatch):
    whole = {r.key: r.score for r in fr.expand(table, NAMES, "label", *OPS, "best", 2, 3).collect()}
    raw = fm.raw_forms(table.sparkSession, NAMES)
    a = {r.key: r.score for r in fr.score_forms(table, raw, "label", chunk=2).collect()}
    assert all(abs(a[k] - whole[k]) < 1e-12 for k in NAMES)
    # nothing is left to expand after the raw features
    assert fr.expand(table, NAMES, "label", {}, {}, "best", 5, 2).count() == 3


def test_equal_rows_are_scored_once(spark, monkeypatch):
    """Copies of rows change no score, and are one row of what the rounds read."""
    few = spark.range(200).selectExpr("cast(id % 23 as double) AS a", "cast(id * id % 31 as double) AS b", "cast(id % 23 + id * id % 31 > 25 as int) AS label")
    many = few.crossJoin(spark.range(12).withColumnRenamed("id", "copy")).drop("copy")
    read, scored = [], fr.mutual_informations
    monkeypatch.setattr(fr, "mutual_informations", lambda df, *more: read.append(df.count()) or scored(df, *more))
    ops = ({"log": "ln({0})"}, {"sum": "({0} + {1})", "divide": "try_divide({0}, {1})"})
    rows = lambda df: {r.key: (r.step, round(r.score, 9)) for r in fr.expand(df, ["a", "b"], "label", *ops, "best", 2, 2).collect()}
    got = rows(many)
    assert set(read) == {few.distinct().count()} and got == rows(few)
    raw = scored(many, ["`a`", "`b`"], "label", [0, 1])
    assert np.allclose([got["a"][1], got["b"][1]], raw, atol=1e-8)
