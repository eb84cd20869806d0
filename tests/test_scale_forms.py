"""Forms that need no single task or buffer for a column give what the plain statement gives; wide masks; search parts."""

import math
from statistics import NormalDist

import numpy as np
import pytest
from pyspark.sql import functions as F

from sievecraft.functions import categorical, numeric, window
from sievecraft.operators import catalog, discretize, evaluate, search
from sievecraft.operators.select import pareto_front, top_per_group

rng = np.random.default_rng(11)


@pytest.fixture(params=[1, 7])
def ranges(spark, request):
    """With one range, and with more than a task or two."""
    old = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", str(request.param))
    yield request.param
    spark.conf.set("spark.sql.shuffle.partitions", old)


def table(spark, n=400):
    x = np.round(rng.normal(size=n) * 5, 1)
    y = rng.random(n)
    return spark.createDataFrame([(i, None if i % 17 == 0 else float(a), float(b)) for i, (a, b) in enumerate(zip(x, y))], "id long, a double, b double"), x, y


def test_exact_quantiles(spark, ranges):
    df, x, y = table(spark)
    x = np.array([v for i, v in enumerate(x) if i % 17])
    shares = [0.0, 0.1, 0.25, 0.5, 0.77, 1.0]
    got = window.exact_quantiles(df.withColumn("none", F.lit(None).cast("double")), ["a", "b", "none"], shares)
    assert np.allclose(got["a"], np.quantile(x, shares)) and np.allclose(got["b"], np.quantile(y, shares)) and got["none"] == [None] * 6
    assert window.exact_quantiles(df.where("false"), ["a"], [0.5]) == {"a": [None]}


def test_ranks_and_codes(spark, ranges):
    df, x, _ = table(spark)
    real = sorted(v for i, v in enumerate(x) if i % 17)
    for r in window.value_ranks(df, "a").collect():
        assert (r.before, r.n) == (sum(v < r.value for v in real), real.count(r.value))
    words = spark.createDataFrame([(w,) for w in ["b", "a", "ä", "c", "a", None, "zz"]], "w string")
    assert {r.w: r.code for r in categorical.ordinal_codes(words, "w", "code").collect()} == {"a": 0, "b": 1, "c": 2, "zz": 3, "ä": 4}


def test_histogram_density(spark, ranges):
    df, x, _ = table(spark)
    real = np.array([v for i, v in enumerate(x) if i % 17])
    q = np.quantile(real, [0.25, 0.75])
    h = 1.2 * (q[1] - q[0]) / len(real) ** 0.2
    for r in window.histogram_density(df, "a", "d").collect():
        if r.a is None:
            assert r.d is None
        else:
            assert math.isclose(r.d, ((real >= r.a - h) & (real <= r.a + h)).sum() / (2 * len(real) * h))
    same = spark.createDataFrame([(1.0,), (1.0,)], "a double")
    assert [r.d for r in window.histogram_density(same, "a", "d").collect()] == [None, None]


def test_normal_scores(spark):
    df, x, _ = table(spark, 60)
    real = sorted(v for i, v in enumerate(x) if i % 17)
    for r in window.normal_scores(df, "a", "z").collect():
        if r.a is None:
            assert r.z is None
        else:
            share = (real.index(r.a) + (real.count(r.a) - 1) / 2) / (len(real) - 1)
            assert math.isclose(r.z, NormalDist().inv_cdf(min(max(share, 1e-7), 1 - 1e-7)), rel_tol=1e-9, abs_tol=1e-12)


def test_winsorize_and_robust(spark):
    df, _, y = table(spark)
    lo, hi = np.quantile(y, [0.05, 0.9])
    got = [r.w for r in df.select("id", numeric.fit_winsorize(df, "b", 0.05, 0.1).alias("w")).orderBy("id").collect()]
    assert np.allclose(got, np.clip(y, lo, hi))


@pytest.mark.parametrize("axes", [2, 3])
def test_pareto_front(spark, ranges, axes):
    v = rng.integers(0, 12, (300, axes))
    names = list("xyz")[:axes]
    rows = [(i, *map(int, r)) for i, r in enumerate(v)]
    df = spark.createDataFrame(rows, "id long, " + ", ".join(f"{n} int" for n in names)).repartition(5)
    want = {r[0] for r in rows if not any(all(o[1 + j] >= r[1 + j] for j in range(axes)) and o[1:] != r[1:] for o in rows)}
    assert {r.id for r in pareto_front(df, "id", names).collect()} == want


def entropy(y):
    p = np.bincount(y, minlength=2) / max(1, len(y))
    return -sum(q * math.log2(q) for q in p if q)


def brute_mdlp(v, y):
    cuts = []

    def split(mask):
        vs = np.unique(v[mask])
        best = None
        for a, b in zip(vs, vs[1:]):
            ya, yb = y[mask & (v == a)], y[mask & (v == b)]
            if not ((0 in ya and 1 in yb) or (1 in ya and 0 in yb)):
                continue
            c = (a + b) / 2
            left, right = mask & (v < c), mask & (v >= c)
            n = mask.sum()
            gain = entropy(y[mask]) - left.sum() / n * entropy(y[left]) - right.sum() / n * entropy(y[right])
            if best is None or gain > best[0] + 1e-12:
                best = (gain, c, left, right)
        if best is None:
            return
        gain, c, left, right = best
        n, k = mask.sum(), lambda m: len(set(y[m].tolist()))
        delta = math.log2(3 ** k(mask)) - (k(mask) * entropy(y[mask]) - k(left) * entropy(y[left]) - k(right) * entropy(y[right]))
        if gain > (math.log2(n - 1) + delta) / n:
            cuts.append(c)
            split(left)
            split(right)

    split(np.ones(len(v), dtype=bool))
    return sorted(cuts)


def test_mdlp_goes_through_all_levels(spark, ranges):
    v = rng.integers(0, 60, 1500).astype(float)
    y = ((v // 13) % 2).astype(int)
    noise = rng.random(1500) < 0.03
    y[noise] = 1 - y[noise]
    df = spark.createDataFrame([(float(a), int(b)) for a, b in zip(v, y)], "v double, y int")
    want = brute_mdlp(v, y)
    assert len(want) >= 3 and np.allclose(discretize.mdlp_cuts(df, "v", "y"), want)


def test_aicc_is_undefined_with_too_few_rows(spark):
    df = spark.createDataFrame([(4, 5, 10.0), (4, 4, 10.0), (2, 50, 10.0)], "k int, n int, rss double")
    got = [r[0] for r in df.select(catalog.aicc(F.col("k"), F.col("n"), F.col("rss"))).collect()]
    assert got[:2] == [math.inf] * 2 and math.isclose(got[2], 4 + 50 * math.log(0.2) + 12 / 47)


def test_equal_prints_are_compared_by_value(spark):
    df = spark.createDataFrame([(i, float(i), float(i), float(-i)) for i in range(9)], "id long, c0 double, c1 double, c2 double")
    prints = spark.createDataFrame([("a", 0.0, 8.0, 7), ("b", 0.0, 8.0, 7), ("c", -8.0, 0.0, 7), ("d", -8.0, 0.0, 7)], "key string, lo double, hi double, print int")
    size = spark.createDataFrame([("a", 2, "c0"), ("b", 1, "c1"), ("c", 3, "c2"), ("d", 4, "c2")], "key string, complexity int, expr string")
    for chunk in (1, 2, 100):
        assert {r.key for r in catalog.drop_equivalent(prints, size, df, chunk).collect()} == {"b", "c"}


def test_candidates_go_through_in_chunks(spark, monkeypatch):
    df = spark.range(50).selectExpr("id", "cast(id AS double) AS x")
    made = spark.createDataFrame([(f"k{i:02}", f"(x * {i}D)", i) for i in range(23)] + [("twice", "(x + x)", 9), ("nothing", "CAST(NULL AS double)", 1)], "key string, expr string, complexity int")
    whole = {tuple(r) for r in catalog.candidate_prints(df, made, "id", 1000).collect()}
    asked = []
    plain = catalog.fingerprints
    monkeypatch.setattr(catalog, "fingerprints", lambda t, cols, names, row: asked.append(len(cols)) or plain(t, cols, names, row))
    prints = catalog.candidate_prints(df, made, "id", 5)
    assert {tuple(r) for r in prints.collect()} == whole and len(whole) == 25 and asked == [5] * 5
    assert {r.key for r in catalog.drop_constant(prints).collect()} == {f"k{i:02}" for i in range(1, 23)} | {"twice"}
    assert {r.key for r in catalog.drop_equivalent(prints, made, df, 4).collect()} == {f"k{i:02}" for i in range(23)} | {"nothing"}
    assert catalog.candidate_prints(df, made.limit(0), "id").count() == 0


def test_pairs_are_those_of_all_salts(spark):
    raw = catalog.raw_catalog(spark, [f"f{i}" for i in range(9)])
    got = [r.key for r in catalog.generate_binary(raw, 3, {"prod": "({0} * {1})", "divide": "try_divide({0}, {1})"}).collect()]
    assert len(got) == len(set(got)) == 9 * 8 // 2 + 9 * 8


def test_top_per_group(spark):
    df = spark.createDataFrame([("g", "a", 1.0), ("g", "b", 2.0), ("g", "c", 2.0), ("h", "a", 0.0)], "grp string, feature string, score double")
    assert {(r.grp, r.feature, r.place) for r in top_per_group(df, "grp", 2).collect()} == {("g", "b", 1), ("g", "c", 2), ("h", "a", 1)}


def wide(spark, n_features, rows=400):
    x = rng.normal(size=(rows, n_features))
    y = (x[:, 1] + x[:, 3] + 0.3 * rng.normal(size=rows) > 0).astype(int)
    names = [f"f{i}" for i in range(n_features)]
    df = spark.createDataFrame([(*map(float, r), int(c), int(i % 2)) for i, (r, c) in enumerate(zip(x, y))], ", ".join(f"{c} double" for c in names) + ", label int, grp int").repartition(4).cache()
    return df, names


def test_masks_of_eighty_features(spark):
    df, names = wide(spark, 80)
    s = search.Search(df, df, names, "label", "grp", evaluate.Constraints(accuracy=0.85, complexity=0.05))
    search.ranking_k(s, ["f1", "f3", *[n for n in names if n not in ("f1", "f3")]])
    s.score([(1 << 80) - 1, 1 << 79])
    t = {r.mask: r for r in s.table().collect()}
    assert t["0101" + "0" * 76]["size"] == 2 and t["0101" + "0" * 76].satisfied and t["1" * 80]["size"] == 80 and t["0" * 79 + "1"]["size"] == 1
    assert s.answer()[:2] == ["f1", "f3"]
    few = search.Search(df, df, names[:8], "label", "grp", evaluate.Constraints(accuracy=0.85))
    search.ranking_k(few, ["f1", "f3", *[n for n in names[:8] if n not in ("f1", "f3")]])
    assert math.isclose(few.trials[10]["accuracy"], s.trials[10]["accuracy"])
    got, _ = search.query(df, df, df, names, "label", "grp", s.constraints, lambda x: search.ranking_k(x, ["f1", "f3", *names[4:]]))
    assert got == ["f1", "f3"] or set(got) > {"f1", "f3"}


@pytest.mark.parametrize("name", ["tpe_masks", "annealing_masks", "nsga2_masks", "surrogate_masks"])
def test_sampled_searches_come_near_the_best(spark, name):
    """On few trials of 4,095 masks, against all masks."""
    df, names = wide(spark, 12, 300)
    s = search.Search(df, df, names, "label", "grp", evaluate.Constraints(accuracy=0.99))
    search.STRATEGIES[name](s)
    assert 20 <= len(s.trials) < 150
    every = search.Search(df, df, names, "label", "grp", s.constraints)
    every.score(range(1, 1 << 12))
    best = max(t["accuracy"] for t in every.trials.values())
    assert max(t["accuracy"] for t in s.trials.values()) > best - 0.08
    assert all(s.trials[m]["accuracy"] == every.trials[m]["accuracy"] for m in s.trials)


def test_fronts_and_crowding():
    points = [(1.0, 5.0), (5.0, 1.0), (3.0, 3.0), (2.0, 2.0), (4.0, 3.0), (1.0, 1.0)]
    assert search.fronts(points) == [[0, 1, 4], [2], [3], [5]]
    far = search.crowding([(0.0, 4.0), (1.0, 3.0), (4.0, 0.0)])
    assert far[0] == far[2] == math.inf and math.isclose(far[1], 2.0)


def test_profile_counts_distinct_values_a_column_at_a_time(spark):
    """No copy of every row per column: the plan of a profile has no Expand."""
    from sievecraft.operators import profile

    df = spark.range(60).selectExpr("id", "if(id % 3 = 0, null, cast(id % 7 as double)) AS a", "cast(id % 5 as string) AS b")
    out = profile.profile(df)
    assert {r.col: (r.n, r.missing, r.n_distinct) for r in out.collect()} == {"id": (60, 0, 60), "a": (60, 20, 7), "b": (60, 0, 5)}
    assert "Expand" not in out._jdf.queryExecution().toString()


def test_vectors_of_frequent_words_are_broadcast(spark, monkeypatch):
    """Whichever way vectors are joined, means are those of all tokens; frequent words never meet a shuffle."""
    from pyspark.sql import functions as F

    from sievecraft.functions import text

    df = spark.range(300).selectExpr("id", "array('common', 'common', concat('w', id % 250)) AS words")
    vectors = spark.range(260).selectExpr("if(id = 259, 'common', concat('w', id)) AS word", "array(cast(id as double), 1D, 5D) AS v")
    want = {i: (259.0 * 2 + i % 250) / 3 for i in range(300)}
    for most in (500_000, 10):
        monkeypatch.setattr(text, "BROADCAST_TERMS", most)
        out = text.average_vectors(df, "id", F.col("words"), vectors, "word", "v", 1)
        assert "BroadcastHashJoin" in out._jdf.queryExecution().executedPlan().toString()
        got = {r.id: r.v0 for r in out.collect()}
        assert got.keys() == want.keys() and all(abs(got[i] - want[i]) < 1e-9 for i in want)


def test_shadows_of_a_repeat_come_in_one_order(spark):
    """A row's values stay together, each is dealt once, and the order is that of the ids' hashes."""
    from pyspark.sql import functions as F

    from sievecraft.operators import rank

    df = spark.range(500).selectExpr("id", "id * 3 AS a", "id * 5 AS b")
    rows = rank.permuted(rank.hash_places(df, "id"), ["a", "b"], "id", 11).collect()
    by = lambda *seed: [r.id for r in df.orderBy(F.xxhash64("id", *seed), "id").collect()]
    want = dict(zip(by(), by(F.lit(11))))
    assert len(rows) == 500 and all(r.shadow_a == 3 * want[r.id] and r.shadow_b == 5 * want[r.id] for r in rows)
