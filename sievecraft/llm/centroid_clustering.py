"""Centroid clustering of integer vectors, filtered by the n-simplex projection.

A few vectors serve as pivots. Their distances to each other build a simplex; the distances of any vector to the pivots
then are the coordinates of one more corner, its apex, of which all but the last lie in the simplex's space and the last
is the height above it. Of two apexes, the distance is a lower bound of the distance of the vectors, and the
distance with one height turned down an upper bound. Apexes of all vectors are computed once and kept; in each
round a vector is compared, in exact integers, with those centroids only whose lower bound isn't above the smallest
upper bound.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..scratch import cut, discard
from .common import table

#: Components beyond this have squared distances that don't fit a long at 64 of them; such vectors take no part.
MOST = 1 << 27
PIVOTS = 12


def int_components(vec: Column, dim: int | None = None) -> Column:
    """floor(256 * x) of all components as longs; null for vectors that are null, of another length than ``dim``, or hold components that are null, not finite or too large."""
    v = vec.cast("array<double>")
    sound = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(MOST / 256.0)))
    if dim is not None:
        sound &= F.size(v) == dim
    return F.when(sound, F.transform(v, lambda x: F.floor(x * 256.0).cast("long")))


@dataclass(frozen=True)
class Simplex:
    """pivots: rows of integer components. base: the pivots' own coordinates, a triangular matrix with a row per pivot."""

    pivots: np.ndarray
    base: np.ndarray

    @classmethod
    def of(cls, points: np.ndarray, most: int = PIVOTS) -> Simplex:
        """Picks pivots among ``points`` so that each stands far above the simplex of those before; at most ``most``, fewer where points don't differ enough."""
        x = points.astype(np.float64)
        height = ((x - x[0]) ** 2).sum(axis=1)  # squared height of each point above the simplex so far
        coords = np.zeros((len(x), 0))
        chosen, rows, scale = [0], [np.zeros(0)], height.max()
        while len(chosen) < min(most, len(x)):
            k = int(height.argmax())
            if height[k] <= 1e-4 * scale or height[k] == 0:
                break
            # the next axis points from the simplex so far to point k
            top = np.sqrt(height[k])
            axis = (((x - x[0]) @ (x[k] - x[0])) - coords @ coords[k]) / top
            coords = np.c_[coords, axis]
            rows.append(coords[k].copy())
            chosen.append(k)
            height = np.maximum(height - axis**2, 0)
        n = len(chosen) - 1
        return cls(points[chosen], np.array([np.r_[r, np.zeros(n - len(r))] for r in rows]).reshape(len(chosen), n))

    def apex(self, squared: np.ndarray) -> np.ndarray:
        """Apex coordinates from squared distances to the pivots (vectors x pivots); the last is the height."""
        d = squared.astype(np.float64)
        n = self.base.shape[1]
        out = np.zeros((len(d), n + 1))
        for j in range(n):
            # pivot j + 1 lies at base[j + 1]; the distance to it fixes coordinate j
            b = self.base[j + 1]
            out[:, j] = (d[:, 0] - d[:, j + 1] + (b**2).sum() - 2 * out[:, :j] @ b[:j]) / (2 * b[j])
        out[:, n] = np.sqrt(np.maximum(d[:, 0] - (out[:, :n] ** 2).sum(axis=1), 0))
        return out

    def apex_of(self, points: np.ndarray) -> np.ndarray:
        return self.apex(squared_distances(points, self.pivots))


def squared_distances(points: np.ndarray, others: np.ndarray, block: int = 1 << 20) -> np.ndarray:
    """Exact squared distances of integer vectors, points x others; longs."""
    out = np.empty((len(points), len(others)), dtype=np.int64)
    step = max(1, block // max(1, others.shape[1]))
    for j, o in enumerate(others):
        for a in range(0, len(points), step):
            gap = points[a : a + step] - o
            out[a : a + step, j] = np.einsum("ij,ij->i", gap, gap)
    return out


def candidates(apex: np.ndarray, centres: np.ndarray) -> np.ndarray:
    """vectors x centroids: which of them the bounds leave. The slack covers rounding, so no nearest centroid is lost."""
    low = (apex[:, :-1] ** 2).sum(axis=1)[:, None] + (centres[:, :-1] ** 2).sum(axis=1)[None] - 2 * apex[:, :-1] @ centres[:, :-1].T
    h, c = apex[:, -1][:, None], centres[:, -1][None]
    upper = low + (h + c) ** 2
    lower = low + (h - c) ** 2
    size = (apex**2).sum(axis=1)[:, None] + (centres**2).sum(axis=1)[None]
    slack = 1e-7 * size + 1e-6
    return lower - slack <= (upper + slack).min(axis=1)[:, None]


def nearest(points: np.ndarray, apex: np.ndarray, centres: np.ndarray, centre_apex: np.ndarray, block: int = 1 << 14) -> tuple[np.ndarray, np.ndarray]:
    """(number, squared distance) of each vector's nearest centroid; of equal distances the smaller number."""
    who, far = np.zeros(len(points), dtype=np.int32), np.zeros(len(points), dtype=np.int64)
    for a in range(0, len(points), block):
        p = points[a : a + block]
        row, col = np.nonzero(candidates(apex[a : a + block], centre_apex))
        d = np.empty(len(row), dtype=np.int64)
        for b in range(0, len(row), block):
            gap = p[row[b : b + block]] - centres[col[b : b + block]]
            d[b : b + block] = np.einsum("ij,ij->i", gap, gap)
        # by row, distance, number: the first of each row is its nearest
        order = np.lexsort((col, d, row))
        first = order[np.r_[True, row[order][1:] != row[order][:-1]]]
        who[a : a + block], far[a : a + block] = col[first], d[first]
    return who, far


def _points(b: pd.DataFrame, column: str) -> np.ndarray:
    return np.stack([np.asarray(v) for v in b[column]])


def assign(kept: DataFrame, centres: np.ndarray, simplex: Simplex) -> DataFrame:
    """``kept`` (x: components, apex) with cluster and distance."""
    at = simplex.apex_of(centres)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            if len(b):
                who, far = nearest(_points(b, "x"), _points(b, "apex"), centres, at)
                yield b.drop(columns=["x", "apex"]).assign(cluster=who, distance=far)

    rest = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kept.schema if f.name not in ("x", "apex"))
    return kept.mapInPandas(run, f"{rest}, cluster int, distance long")


def moved(kept: DataFrame, centres: np.ndarray, simplex: Simplex) -> np.ndarray:
    """Centroids after a round: floor(sum / count) of their vectors per component; those without vectors stay.

    Tasks add up their vectors first, so the shuffle has a row per task and centroid.
    """
    at = simplex.apex_of(centres)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total, count = np.zeros(centres.shape, dtype=object), np.zeros(len(centres), dtype=np.int64)
        for b in batches:
            if not len(b):
                continue
            points = _points(b, "x")
            who, _ = nearest(points, _points(b, "apex"), centres, at)
            part = np.zeros(centres.shape, dtype=np.int64)
            np.add.at(part, who, points)
            total += part.astype(object)
            count += np.bincount(who, minlength=len(centres))
        some = np.flatnonzero(count)
        yield pd.DataFrame({"cluster": some.astype(np.int32), "n": count[some], "s": [[str(v) for v in total[k]] for k in some]})

    parts = kept.select("x", "apex").mapInPandas(run, "cluster int, n long, s array<string>")
    sums = parts.select("cluster", "n", F.posexplode("s").alias("j", "v")).groupBy("cluster", "j").agg(F.sum(F.col("v").cast("decimal(38,0)")).alias("s"), F.sum("n").alias("n"))
    out = centres.copy()
    for r in sums.collect():  # centroids x components
        out[r.cluster, r.j] = int(r.s) // r.n
    return out


def cluster_vectors(vectors: DataFrame, dim: int = 64, centroids: int = 40, rounds: int = 5, seed: int = 2, pivots: int = PIVOTS, vec_col: str = "embedding", id_col: str = "vec_id") -> DataFrame:
    """(id, cluster, distance, cluster_inertia, inertia, centroid): every kept vector with its final centroid.

    Components become floor(256 * x). The first centroids are the ``centroids`` vectors of smallest sha256 of
    ``<seed>:<id>``; each of ``rounds`` rounds assigns all vectors to the nearest centroid (squared distance, of equal ones
    the smaller number) and moves each centroid to the floor of its vectors' mean. Everything is exact integers.
    Vectors that are null, of another length than ``dim``, or hold a component that is null, not finite or of
    2^27 / 256 and more are left out, as are rows without an id. Rows that share an id are vectors each; as first
    centroids they are ordered by their components too. With fewer vectors than ``centroids`` there are as many
    centroids; an empty table gives an empty result. Other columns are left out, whatever their names.
    """
    x = int_components(F.col(vec_col), dim)
    name = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("id").cast("string")), 256)
    ints = vectors.select(F.col(id_col).alias("id"), x.alias("x")).where("id IS NOT NULL AND x IS NOT NULL")
    first = ints.withColumn("h", name).orderBy("h", "x").limit(centroids).collect()
    kind = vectors.schema[id_col].dataType.simpleString()
    if not first:
        return vectors.sparkSession.createDataFrame([], f"id {kind}, cluster int, distance long, cluster_inertia long, inertia long, centroid array<long>").withColumnRenamed("id", id_col)
    centres = np.array([r.x for r in first], dtype=np.int64)
    simplex = Simplex.of(centres, pivots)

    def project(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            if len(b):
                yield b.assign(apex=list(simplex.apex_of(_points(b, "x"))))

    kept = cut(ints.mapInPandas(project, f"id {kind}, x array<long>, apex array<double>"), "apexes")
    for _ in range(rounds):
        centres = moved(kept, centres, simplex)
    done = cut(assign(kept, centres, simplex), "assigned")
    discard(kept)
    per = {r.cluster: int(r.s) for r in done.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("s")).collect()}
    rows = [(k, per.get(k, 0), c.tolist()) for k, c in enumerate(centres)]
    info = vectors.sparkSession.createDataFrame(rows, "cluster int, cluster_inertia long, centroid array<long>")
    # a row per centroid: as many as asked for
    out = done.join(F.broadcast(info), "cluster")
    return out.select(F.col("id").alias(id_col), "cluster", "distance", "cluster_inertia", F.lit(sum(per.values())).cast("long").alias("inertia"), "centroid")


def op13_centroid_clustering(spark: SparkSession, sf_dir: str) -> DataFrame:
    """vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256 for every kept vector of embeddings."""
    out = cluster_vectors(table(spark, sf_dir, "embeddings").select("vec_id", "embedding"))
    return out.select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", F.sha2(F.array_join(F.col("centroid").cast("array<string>"), ","), 256).alias("centroid_sha256"))


def _sql(centroids: int = 40, rounds: int = 5, dim: int = 64) -> str:
    """The rounds one after another, each a comparison of all vectors with all centroids."""
    parts = [
        f"""v AS MATERIALIZED (SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS e FROM embeddings
            WHERE len(embedding) = {dim} AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(CAST(x AS DOUBLE)))) = {dim})""",
        f"""c0 AS MATERIALIZED (SELECT CAST(row_number() OVER (ORDER BY h) - 1 AS INTEGER) AS cluster, e AS c
            FROM (SELECT e, sha256('2:' || vec_id) AS h FROM v ORDER BY h LIMIT {centroids}))""",
    ]
    for k in range(rounds + 1):
        parts.append(f"""a{k} AS MATERIALIZED (SELECT vec_id, e, b.cluster AS cluster, b.d AS distance FROM (
            SELECT vec_id, any_value(e) AS e, min(struct_pack(d := d, cluster := cluster)) AS b FROM (
                SELECT vec_id, e, cluster, CAST(list_sum(list_transform(range(1, {dim + 1}), lambda i: (e[i] - c[i]) * (e[i] - c[i]))) AS BIGINT) AS d FROM v, c{k}) GROUP BY vec_id))""")
        if k < rounds:
            parts.append(f"""c{k + 1} AS MATERIALIZED (SELECT cluster, coalesce(m, c) AS c FROM c{k} LEFT JOIN (
                SELECT cluster, list(CAST(floor_div AS BIGINT) ORDER BY i) AS m FROM (
                    SELECT cluster, i, (s - ((s % n) + n) % n) // n AS floor_div FROM (
                        SELECT cluster, i, CAST(sum(x) AS BIGINT) AS s, count(*) AS n FROM (SELECT cluster, unnest(e) AS x, unnest(range({dim})) AS i FROM a{k}) GROUP BY cluster, i)) GROUP BY cluster) USING (cluster))""")
    k = rounds
    return f"""WITH {", ".join(parts)}
        SELECT vec_id, cluster, distance, CAST(sum(distance) OVER (PARTITION BY cluster) AS BIGINT) AS cluster_inertia, CAST(sum(distance) OVER () AS BIGINT) AS inertia,
               sha256(array_to_string(c, ',')) AS centroid_sha256 FROM a{k} JOIN c{k} USING (cluster)"""


SQL = {"op13_centroid_clustering": _sql()}
