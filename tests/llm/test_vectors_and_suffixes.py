"""Hard negatives, suffix dedup and centroid clustering against brute force and their SQL."""

import hashlib
import math
from collections import defaultdict

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from sievecraft.llm import centroid_clustering, hard_negatives, suffix_dedup
from sievecraft.llm.queries import QUERIES, SQL

SF = "/root/testdata/sf0.001"
VECTORS = "vec_id long, embedding array<float>, label int, cluster string, rank double"


@pytest.mark.parametrize("name", ["op11_hard_negatives", "op12_suffix_dedup", "op13_centroid_clustering"])
def test_against_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "embeddings"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    want = con.sql(SQL[name])
    df = QUERIES[name](spark, SF)
    names = sorted(df.columns)
    assert names == sorted(want.columns)
    at = [want.columns.index(c) for c in names]
    assert sorted(tuple(r[c] for c in names) for r in df.collect()) == sorted(tuple(r[i] for i in at) for r in want.fetchall())


# suffix dedup


def removed(rows, window):
    """Which bytes go, by brute force; rows: (id, hash of the text, text)."""
    first = {}
    for d, k, t in sorted(rows):
        for i in range(len(t) - window + 1):
            first.setdefault(t[i : i + window], (d, k, i))
    out = {}
    for d, k, t in rows:
        gone = np.zeros(len(t), dtype=bool)
        for i in range(len(t) - window + 1):
            if first[t[i : i + window]] < (d, k, i):
                gone[i : i + window] = True
        out[d, t] = gone
    return out


def suffix_texts():
    rng = np.random.default_rng(4)
    line = "".join(rng.choice(list("abcdefghij klm né"), 400))
    other = "".join(rng.choice(list("nopqrstuvw xyz"), 700))
    texts = [None, "", "short", line, line, line[40:300] + other[:200], "Ü" * 180, "ab" * 300, other, other[:99], other[:100], other[3:103] + "!", "".join(rng.choice(list("ab"), 5000)), line[:150] + other[10:140] + line[200:390]]
    return list(enumerate(texts)) + [(3, line), (3, other[50:250]), (None, line), (40, "z" * 120_000)]


@pytest.mark.parametrize("window,gram,share", [(100, 16, 1 / 2000), (100, 16, 0.05), (32, 8, 1 / 2000)])
def test_suffix_dedup(spark, window, gram, share):
    texts = [r for r in suffix_texts() if window == 100 or r[0] != 40]
    df = spark.createDataFrame([(i, t, 1, "x") for i, t in texts], "doc_id long, text string, n_bytes int, kept string")
    key = {r.text: r.k for r in df.select("text", F.xxhash64("text").alias("k")).collect() if r.text is not None}
    want = removed([(i, key[t], t.encode()) for i, t in set(texts) if i is not None and t], window)
    rows = suffix_dedup.suffix_dedup(df, window, gram, hot_share=share).collect()
    left = defaultdict(list)
    for i, t in texts:
        b = (t or "").encode()
        gone = want.get((i, b), np.zeros(len(b), dtype=bool))
        spans = int(gone[:1].sum()) + int((gone[1:] & ~gone[:-1]).sum())
        left[i].append((len(b), int(gone.sum()), spans, np.frombuffer(b, np.uint8)[~gone].tobytes()))
    got = defaultdict(list)
    for r in rows:
        got[r.doc_id].append((r.n_bytes, r.n_removed, r.n_spans, bytes(r.kept)))
    assert {i: sorted(v) for i, v in got.items()} == {i: sorted(v) for i, v in left.items()}
    assert suffix_dedup.suffix_dedup(df.where("false"), window, gram).count() == 0


def test_suffix_pieces():
    """Texts longer than what is looked at together are cut into pieces that overlap; nothing is lost or counted twice."""
    rng = np.random.default_rng(6)
    a = bytes(rng.integers(97, 123, 3000, dtype=np.uint8))
    rows = [(1, 5, a + b"0" * 50), (2, 6, b"__" + a[700:2500] + a[:300]), (3, 7, a[2900:] + a)]
    import pandas as pd

    from sievecraft.llm.common import Buckets

    for most in (150, 1000, 1 << 20):
        batch = pd.DataFrame([(d, k, t.decode()) for d, k, t in rows], columns=["doc_id", "key", "text"])
        blocks = pd.concat(suffix_dedup.deal(100, 16, np.zeros(0, np.uint64), Buckets(3, 2), most)(iter([batch]))).sort_values(["part", "sub"])
        gone = {d: np.zeros(len(t), dtype=bool) for d, _, t in rows}
        for m in suffix_dedup.compare(100)(iter([blocks])):
            for d, _, start, n in m.itertuples(index=False):
                gone[d][start : start + n + 99] = True
        want = removed(rows, 100)
        assert all((gone[d] == want[d, t]).all() for d, _, t in rows)


def test_refined_is_suffix_order():
    """Pointers give the order of the suffixes as far as a window, and buckets of equal windows."""
    rng = np.random.default_rng(7)
    strings = [bytes(rng.integers(97, 99, 60, dtype=np.uint8)) for _ in range(20)]
    strings += strings[:3]
    size = np.array([len(s) for s in strings])
    places, new = suffix_dedup.refined(np.frombuffer(b"".join(strings) + bytes(8), np.uint8), size, 20)
    text = b"".join(strings)
    windows = [text[p : p + 20] for p in places]
    assert windows == sorted(windows) and [a != b for a, b in zip(windows[1:], windows[:-1])] == new[1:].tolist()
    every = [s[i : i + 20] for s in strings for i in range(41)]
    assert len(places) == sum(every.count(w) > 1 for w in every)


# vectors


def ints(v):
    return [math.floor(256.0 * float(np.float32(x))) for x in v]


def vectors(n=300, dim=16, seed=1):
    rng = np.random.default_rng(seed)
    centre = rng.standard_normal((6, dim))
    x = centre[rng.integers(0, 6, n)] + 0.7 * rng.standard_normal((n, dim))
    x[5], x[6], x[7] = x[4], 0, np.round(x[7])
    rows = [(i, [float(np.float32(v)) for v in r], int(rng.integers(0, 3)), "c", 0.5) for i, r in enumerate(x)]
    nan, inf = float("nan"), float("inf")
    rows += [(None, rows[0][1], 1, "c", 0.5), (900, None, 1, "c", 0.5), (901, [], 1, "c", 0.5), (902, [1.0] * (dim - 1), 1, "c", 0.5), (903, [nan] * dim, 1, "c", 0.5), (904, [inf] * dim, 1, "c", 0.5), (905, [None] * dim, 1, "c", 0.5)]
    rows += [(906, rows[1][1], None, "c", 0.5), (907, [1e30] * dim, 1, "c", 0.5), (950, [3.0, 1.0], 1, "c", 0.5), (951, [2.0, 1.0], 1, "c", 0.5), (952, [2.5, 1.0], 2, "c", 0.5), (953, [1.5, 1.0], 2, "c", 0.5)]
    return rows


def usable(r):
    return r[0] is not None and r[1] and all(v is not None and math.isfinite(v) and abs(v) < 2**27 / 256 for v in r[1])


def test_hard_negatives(spark):
    rows = vectors()
    rows += [rows[10]]  # a repeated row
    df = spark.createDataFrame(rows, VECTORS)
    sound = [(r[0], ints(r[1]), r[2]) for r in rows if usable(r) and r[2] is not None]
    want = []
    for a, (i, x, label) in enumerate(sound):
        if i % 5:
            continue
        score = lambda y: sum(p * q for p, q in zip(x, y))
        near = sorted((-score(y), j) for b, (j, y, m) in enumerate(sound) if b != a and m == label and len(y) == len(x))[:5]
        for s, j in near:
            ok = sorted((-score(y), k) for k, y, m in sound if m != label and len(y) == len(x) and 50 * -s <= 100 * score(y) <= 95 * -s)[:3]
            want += [(i, j, n + 1, k, -s, -t) for n, (t, k) in enumerate(ok)]
    for part_rows in (40, 1 << 15):
        got = hard_negatives.hard_negatives(df, F.col("vec_id") % 5 == 0, part_rows=part_rows).collect()
        assert sorted(tuple(r) for r in got) == sorted(want)
    assert hard_negatives.hard_negatives(df.where("false"), F.col("vec_id") % 5 == 0).count() == 0
    assert hard_negatives.hard_negatives(df, F.lit(None).cast("boolean")).count() == 0


@pytest.mark.parametrize("dim", [2, 64, 100])
def test_intervals_hold(dim):
    """Every product lies in its interval, and the intervals leave out most pairs of unrelated vectors."""
    rng = np.random.default_rng(dim)
    x = np.floor(256 * rng.standard_normal((400, dim))).astype(np.int64)
    x[0], x[1] = 0, x[2]
    codes = hard_negatives.Codes()
    low, high = hard_negatives.intervals(codes.planes_of(x[:50]), codes.encode(x))
    exact = x[:50] @ x.T
    assert (low <= exact).all() and (exact <= high).all()
    norm = np.sqrt((x.astype(float) ** 2).sum(axis=1))
    if dim == 64:
        assert ((high - low) / np.maximum(norm[:50, None] * norm[None], 1)).mean() < 0.9


def test_cluster_vectors(spark):
    rows = vectors(dim=16) + [vectors(dim=16)[3]]
    df = spark.createDataFrame(rows, VECTORS)
    kept = [(r[0], np.array(ints(r[1]), dtype=object)) for r in rows if usable(r) and len(r[1]) == 16]
    for k, rounds in ((7, 4), (1000, 2)):
        first = sorted(kept, key=lambda r: (hashlib.sha256(f"2:{r[0]}".encode()).hexdigest(), r[1].tolist()))[:k]
        centres = [list(x) for _, x in first]

        def nearest(x):
            return min((sum((a - b) ** 2 for a, b in zip(x, c)), j) for j, c in enumerate(centres))

        for _ in range(rounds):
            at = defaultdict(list)
            for _, x in kept:
                at[nearest(x)[1]].append(x)
            for j, xs in at.items():
                centres[j] = [int(s) // len(xs) for s in sum(xs)]
        final = [(i, *nearest(x)) for i, x in kept]
        inertia = defaultdict(int)
        for _, d, j in final:
            inertia[j] += d
        got = centroid_clustering.cluster_vectors(df, dim=16, centroids=k, rounds=rounds).collect()
        assert sorted((r.vec_id, r.distance, r.cluster, r.cluster_inertia, r.inertia, r.centroid) for r in got) == sorted((i, d, j, inertia[j], sum(inertia.values()), centres[j]) for i, d, j in final)
    assert centroid_clustering.cluster_vectors(df.where("false"), dim=16).count() == 0
    assert centroid_clustering.cluster_vectors(df, dim=17).count() == 0


def test_simplex_bounds():
    """Apex distances enclose the true ones, also where pivots coincide or points lie in a plane; the bounds drop most centroids of clustered vectors."""
    rng = np.random.default_rng(2)
    plane = rng.integers(-300, 300, (50, 2)) @ rng.integers(-3, 3, (2, 20))
    groups = rng.integers(-200, 200, (8, 20))
    clustered = groups[rng.integers(0, 8, 400)] + rng.integers(-15, 15, (400, 20))
    for points in (rng.integers(-500, 500, (200, 20)), np.repeat(rng.integers(-9, 9, (3, 20)), 20, axis=0), plane, np.zeros((5, 20), dtype=np.int64), clustered):
        points = points.astype(np.int64)
        s = centroid_clustering.Simplex.of(points[:40])
        at = s.apex_of(points)
        exact = centroid_clustering.squared_distances(points, points[:30]).astype(float)
        gap = ((at[:, None, :-1] - at[None, :30, :-1]) ** 2).sum(axis=2)
        slack = 1e-6 * (1 + exact.max())
        assert (gap + (at[:, None, -1] - at[None, :30, -1]) ** 2 <= exact + slack).all()
        assert (exact <= gap + (at[:, None, -1] + at[None, :30, -1]) ** 2 + slack).all()
        who, far = centroid_clustering.nearest(points, at, points[:30], s.apex_of(points[:30]))
        assert (far == exact.min(axis=1)).all() and (who == exact.argmin(axis=1)).all()
    assert centroid_clustering.candidates(at, s.apex_of(groups)).mean() < 0.3
