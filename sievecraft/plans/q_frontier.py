"""Queries over normal forms and construction searches with a table as frontier."""

from __future__ import annotations

from itertools import combinations, permutations

from pyspark.sql import functions as F

from ..operators import construct as co
from ..operators import forms as fm
from ..operators import frontier as fr
from ..registry import FEATURES, lines, query, r6

C = F.col


def _first_round_sql(bins=10):
    """Mutual information of the raw features and of all forms of one step; those of the best raw feature stay."""
    forms = {f: (1, [], f) for f in FEATURES}
    for f in FEATURES:
        forms |= {f"minus({f})": (2, [f], f"-{f}"), f"log({f})": (2, [f], f"CASE WHEN {f} > 0 THEN ln({f}) END")}
    for a, b in combinations(sorted(FEATURES), 2):
        forms |= {f"sum({a},{b})": (3, [a, b], f"{a} + {b}"), f"prod({a},{b})": (3, [a, b], f"{a} * {b}")}
    for a, b in permutations(FEATURES, 2):
        forms |= {f"divide({a},{b})": (3, [a, b], f"{a} / nullif({b}, 0)"), f"subtract({a},{b})": (3, [a, b], f"{a} - {b}")}
    values = ", ".join(f"{{'key': '{k}', 'x': ({e})::DOUBLE}}" for k, (_, _, e) in forms.items())
    info = ", ".join(f"('{k}', {c}, {p!r}::VARCHAR[])" for k, (c, p, _) in forms.items())
    h = lambda by: f"(SELECT key, log2(sum(n)) - sum(n * log2(n)) / sum(n) AS e FROM (SELECT key, {by}, sum(n) AS n FROM counts GROUP BY key, {by}) GROUP BY key)"
    return (
        f"WITH v AS (SELECT label, s.key AS key, s.x AS x FROM (SELECT label, unnest([{values}]) AS s FROM {{lines}})), "
        "r AS (SELECT key, min(x) AS lo, max(x) AS hi FROM v GROUP BY 1), "
        f"counts AS (SELECT key, CASE WHEN x IS NULL THEN {bins} WHEN hi > lo THEN least(floor((x - lo) / ((hi - lo) / {bins}.0::DOUBLE)), {bins - 1}) ELSE 0 END AS b, label, count(*) AS n FROM v JOIN r USING (key) GROUP BY 1, 2, 3), "
        f"m AS (SELECT key, x.e + y.e - z.e AS score FROM {h('b')} x JOIN {h('label')} y USING (key) JOIN {h('b, label')} z USING (key)), "
        f"f AS (SELECT * FROM (VALUES {info}) AS f(key, complexity, parents)), "
        "best AS (SELECT key FROM m JOIN f USING (key) WHERE complexity = 1 ORDER BY round(score, 9) DESC, key LIMIT 1) "
        "SELECT key, complexity::INT AS complexity, round(score, 6) AS score, (complexity > 1)::INT AS step FROM m JOIN f USING (key) WHERE complexity = 1 OR list_contains(parents, (SELECT key FROM best))"
    )


@query("frontier_first_round", _first_round_sql())
def frontier_first_round(s, d):
    """Raw features, and the forms of the best of them."""
    out = fr.expand(lines(s, d), FEATURES, "label", *co.SPACES["explorekit"], "best", 1, 1)
    return out.select("key", "complexity", r6(C("score"), "score"), "step")


#: Operators whose forms often are equal: sums and products in any order, logarithms and reciprocals of them.
_FEW = ({"log": "ln({0})", "one_div": "try_divide(1D, {0})"}, {"sum": "({0} + {1})", "prod": "({0} * {1})"})


def _frontier(how, rounds, width, ops):
    def run(s, d):
        out = fr.expand(lines(s, d), FEATURES, "label", *ops, how, rounds, width)
        return out.select("key", "op", "complexity", r6(C("score"), "score"), "step")

    return run


#: Two hundred expansions from the best, forty from the deepest and by harmonic mean.
for _how, _rounds, _width, _ops in (("best", 8, 25, _FEW), ("depth", 4, 10, co.SPACES["explorekit"]), ("harmonic", 4, 10, co.SPACES["explorekit"])):
    query(f"frontier_{_how}")(_frontier(_how, _rounds, _width, _ops))


_SUMS = {"sum": "({0} + {1})", "subtract": "({0} - {1})"}


def _sums_sql():
    """Sums and differences of two steps as SQL; forms are equal if their values in all rows are."""
    level = {f: (f, "raw", [f]) for f in sorted(FEATURES)}
    every = dict(level)
    for _ in range(2):
        made = {}
        for k, (e, op, args) in level.items():
            for f in sorted(FEATURES):
                if f != k:
                    flat = sorted([*(args if op == "sum" else [k]), f])
                    made[f"sum({','.join(flat)})"] = (f"({e} + {f})", "sum", flat)
                    made[f"subtract({k},{f})"] = (f"({e} - {f})", "subtract", [k, f])
                    made[f"subtract({f},{k})"] = (f"({f} - {e})", "subtract", [f, k])
        every |= made
        level = made
    values = ", ".join(f"{{'key': '{k}', 'x': round({e}, 6) + 0.0}}" for k, (e, _, _) in every.items())
    return (
        f"WITH v AS (SELECT row_id, s.key AS key, s.x AS x FROM (SELECT row_id, unnest([{values}]) AS s FROM {{lines}})), "
        "p AS (SELECT key, sum(hash(row_id, CAST(round(x * 1000000) AS BIGINT))::HUGEINT % 1000000007) AS p, min(x) < max(x) AS varies FROM v GROUP BY 1) "
        "SELECT key, min(key) OVER (PARTITION BY p) AS same_as FROM p WHERE varies"
    )


@query("equal_forms", _sums_sql())
def equal_forms(s, d):
    """Sums and differences of two steps over the numeric columns, each with the first form that is equal to it."""
    raw = fm.raw_forms(s, sorted(c for c, t in lines(s, d).dtypes if t == "double"))
    names = [r.key for r in raw.collect()]
    level, every = raw, raw
    for _ in range(2):
        level = fm.binary_forms(level, names, _SUMS).dropDuplicates(["key"])
        every = every.unionByName(level)
    same = every.where("size(array_distinct(print)) > 1").dropDuplicates(["key"])
    first = same.groupBy("print").agg(F.min("key").alias("same_as"))
    return same.join(first, "print").select("key", "same_as")
