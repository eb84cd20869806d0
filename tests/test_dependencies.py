"""Functional dependencies against brute force."""

from collections import Counter, defaultdict
from itertools import combinations

import numpy as np
import pytest

from sievecraft.operators import dependencies as dp

NAMES = ["a", "b", "c", "d", "e", "f"]


@pytest.fixture(scope="module")
def rows():
    rng = np.random.default_rng(9)
    out = []
    for i in range(240):
        r = [int(v) for v in rng.integers(0, [3, 4, 5, 2, 6, 7])]
        out.append((*[None if rng.random() < 0.1 else v for v in r], (r[0] * 5 + r[2]) % 4 if rng.random() > 0.02 else None))
    return out + out[:20]


def brute(rows, error):
    """Errors of all sets without a smaller one that holds."""
    n, found, out = len(rows), [], {}
    lost = {}
    for size in range(1, 7):
        for s in combinations(range(6), size):
            classes = defaultdict(Counter)
            for r in rows:
                classes[tuple(r[i] for i in s)][r[6]] += 1
            lost[s] = sum(sum(c.values()) - max(c.values()) for c in classes.values()) / n
    for s in sorted(lost, key=len):
        if not any(set(f) < set(s) for f in found) and (len(s) == 1 or lost[tuple(range(6))] <= error + 1e-12):
            out[",".join(NAMES[i] for i in s)] = lost[s]
            if lost[s] <= error + 1e-12:
                found.append(s)
    return out


@pytest.mark.parametrize("error", [0.0, 0.02, 0.1, 0.3])
def test_against_brute_force(spark, rows, error):
    df = spark.createDataFrame(rows, ", ".join(f"{c} int" for c in [*NAMES, "y"]))
    got = {r.lhs: r for r in dp.functional_dependencies(df, NAMES, "y", error=error).collect()}
    want = brute(rows, error)
    assert set(got) == set(want)
    for k, e in want.items():
        assert abs(got[k].error - e) < 1e-12 and got[k].holds == (e <= error + 1e-12) and got[k].size == k.count(",") + 1


def test_ends(spark, rows):
    df = spark.createDataFrame(rows, ", ".join(f"{c} int" for c in [*NAMES, "y"]))
    assert {r["size"] for r in dp.functional_dependencies(df, NAMES, "y", most=2, error=0.15).collect()} <= {1, 2}
    assert all(r.holds for r in dp.functional_dependencies(df.where("false"), NAMES, "y").collect())
    found = spark.createDataFrame([("a,b", 2, 0.0, True), ("c", 1, 0.0, True), ("d", 1, 0.5, False)], "lhs string, size int, error double, holds boolean")
    scores = spark.createDataFrame([("a", 1, 0.9), ("b", 1, 0.7), ("c", 3, 0.5), ("d", 1, 1.0)], "feature string, complexity int, score double")
    assert {r.goal: r.lhs for r in dp.best_dependencies(found, scores).collect()} == {"complexity": "a,b", "score": "a,b"}
