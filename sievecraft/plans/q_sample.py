"""Queries over splits, folds and samples."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import sample as sm
from ..registry import FEATURES, lines, query, r6, read

C = F.col
_CUST = "SELECT c_custkey AS id, c_mktsegment AS seg, c_acctbal AS bal FROM customer"
_RANK = f"r AS (SELECT id, seg, bal, row_number() OVER (PARTITION BY seg ORDER BY md5('0:' || id), id) AS rk, count(*) OVER (PARTITION BY seg) AS n, row_number() OVER (ORDER BY md5('0:' || id), id) AS ra, count(*) OVER () AS na FROM ({_CUST}))"


def _cust(s, d):
    return read(s, d, "customer").select(C("c_custkey").alias("id"), C("c_mktsegment").alias("seg"), C("c_acctbal").alias("bal"))


@query("split_stratified", f"WITH {_RANK} SELECT id, CASE WHEN rk <= 0.6::DOUBLE * n THEN 'train' WHEN rk <= 0.8::DOUBLE * n THEN 'valid' ELSE 'test' END AS split FROM r")
def split_stratified(s, d):
    return sm.split(_cust(s, d), "id", "seg").select("id", "split")


@query("split_random", f"WITH {_RANK} SELECT id, CASE WHEN ra <= 0.6::DOUBLE * na THEN 'train' WHEN ra <= 0.8::DOUBLE * na THEN 'valid' ELSE 'test' END AS split FROM r")
def split_random(s, d):
    return sm.split(_cust(s, d), "id", None).select("id", "split")


@query("stratified_kfold", f"WITH {_RANK} SELECT id, ((rk - 1) % 10)::INT AS fold FROM r")
def stratified_kfold(s, d):
    return sm.kfold(_cust(s, d), "id", 10, "seg").select("id", "fold")


@query("kfold", f"WITH {_RANK} SELECT id, ((ra - 1) % 5)::INT AS fold FROM r")
def kfold(s, d):
    return sm.kfold(_cust(s, d), "id", 5).select("id", "fold")


@query("group_kfold", "WITH g AS (SELECT c_nationkey AS k, (row_number() OVER (ORDER BY count(*) DESC, c_nationkey) - 1) % 5 AS fold FROM customer GROUP BY 1) SELECT c_custkey, fold::INT AS fold FROM customer JOIN g ON k = c_nationkey")
def group_kfold(s, d):
    return sm.group_kfold(read(s, d, "customer"), "c_nationkey", 5).select("c_custkey", "fold")


@query("repeated_cv", f"WITH r AS (SELECT s, id, seg, bal, row_number() OVER (PARTITION BY s, seg ORDER BY md5(s || ':' || id), id) AS rk FROM ({_CUST}), (SELECT unnest(range(3)) AS s)), m AS (SELECT s, (rk - 1) % 5 AS fold, avg(bal) AS m FROM r GROUP BY 1, 2) SELECT s::INT AS seed, round(avg(m), 5) AS mean, round(stddev_pop(m), 5) AS std FROM m GROUP BY 1")
def repeated_cv(s, d):
    out = None
    for seed in range(3):
        folds = sm.kfold(_cust(s, d), "id", 5, "seg", seed).groupBy("fold").agg(F.avg("bal").alias("m"))
        one = folds.agg(F.lit(seed).alias("seed"), F.round(F.avg("m"), 5).alias("mean"), F.round(F.stddev_pop("m"), 5).alias("std"))
        out = one if out is None else out.unionByName(one)
    return out


@query("nested_cv", f"WITH r AS (SELECT id, (row_number() OVER (PARTITION BY seg ORDER BY md5('0:' || id), id) - 1) % 5 AS outer_fold, (row_number() OVER (PARTITION BY seg ORDER BY md5('1:' || id), id) - 1) % 3 AS inner_fold FROM ({_CUST})) SELECT outer_fold::INT AS outer_fold, inner_fold::INT AS inner_fold, count(*) AS n FROM r GROUP BY 1, 2")
def nested_cv(s, d):
    outer = sm.kfold(_cust(s, d), "id", 5, "seg", 0, "outer_fold")
    return sm.kfold(outer, "id", 3, "seg", 1, "inner_fold").groupBy("outer_fold", "inner_fold").agg(F.count("*").alias("n"))


@query("fixed_sample", f"WITH {_RANK} SELECT id FROM r WHERE rk <= round(100.0::DOUBLE * n / na)")
def fixed_sample(s, d):
    return sm.fixed_sample(_cust(s, d), "id", "seg", 100).select("id")


@query("initial_sample", f"WITH {_RANK} SELECT id, seg FROM r WHERE rk <= 7")
def initial_sample(s, d):
    return sm.sample_per_class(_cust(s, d), "id", "seg", 7).select("id", "seg")


_P = "SELECT event_id, [abs(value) % 1, (1 - abs(value) % 1) * 0.7, (1 - abs(value) % 1) * 0.3] AS p FROM events WHERE value IS NOT NULL"


def _probs(s, d):
    v = F.abs("value") % 1
    return read(s, d, "events").where(C("value").isNotNull()).select("event_id", F.array(v, (1 - v) * 0.7, (1 - v) * 0.3).alias("p"))


@query("uncertainty_sample", f"SELECT event_id, round(1 - list_sort(p, 'DESC')[1] - list_sort(p, 'DESC')[2], 6) AS u FROM ({_P}) ORDER BY 1 - list_sort(p, 'DESC')[1] - list_sort(p, 'DESC')[2] DESC, event_id LIMIT 50")
def uncertainty_sample(s, d):
    return _probs(s, d).withColumn("v", sm.uncertainty(C("p"))).orderBy(F.desc("v"), "event_id").limit(50).select("event_id", r6(C("v"), "u"))


@query("record_error_reward", f"SELECT event_id, round(1 - p[event_id % 3 + 1], 6) AS reward FROM ({_P})")
def record_error_reward(s, d):
    return _probs(s, d).select("event_id", r6(1 - F.element_at("p", (C("event_id") % 3 + 1).cast("int")), "reward"))


_ARMS = "SELECT event_type AS arm, count(*) AS n, sum(value) / 100 AS reward FROM events GROUP BY 1"


def _arms(s, d):
    return read(s, d, "events").groupBy(C("event_type").alias("arm")).agg(F.count("*").alias("n"), (F.sum("value") / 100).alias("reward"))


@query("ucb_allocate", f"WITH a AS ({_ARMS}), u AS (SELECT arm, reward / n + 2 * sqrt(2 * ln((SELECT sum(n) FROM a)) / n) AS ucb FROM a), f AS (SELECT arm, ucb, floor(1000 * ucb / (SELECT sum(ucb) FROM u)) AS q FROM u) SELECT arm, round(ucb, 5) AS ucb, (q + (row_number() OVER (ORDER BY ucb DESC, arm) <= 1000 - (SELECT sum(q) FROM f))::INT)::BIGINT AS rows FROM f")
def ucb_allocate(s, d):
    return sm.ucb_allocate(_arms(s, d), 1000, 2.0).select("arm", F.round("ucb", 5).alias("ucb"), C("rows").cast("long").alias("rows"))


@query("round_robin_by_size", f"WITH {_RANK}, o AS (SELECT seg, row_number() OVER (ORDER BY count(*) DESC, seg) AS place FROM r GROUP BY 1) SELECT id, rk AS turn, place::INT AS place FROM r JOIN o USING (seg)")
def round_robin_by_size(s, d):
    return sm.round_robin(_cust(s, d), "seg", "id").select("id", "turn", "place")


@query("cluster_rows")
def cluster_rows(s, d):
    return sm.cluster_rows(lines(s, d), FEATURES, 5).groupBy("cluster").agg(F.count("*").alias("n"))


@query("kmeans_target")
def kmeans_target(s, d):
    return sm.cluster_rows(read(s, d, "customer"), ["c_acctbal"], 10).select("c_custkey", "cluster")


@query("oversample_minority")
def oversample_minority(s, d):
    """As many new rows as the minority lacks."""
    x = _cust(s, d).withColumn("y", (C("seg") == "BUILDING").cast("int")).withColumn("idn", C("id").cast("double"))
    lacks = x.agg(F.sum(1 - 2 * C("y"))).first()[0]
    return sm.oversample_minority(x, ["bal", "idn"], "y", "id", 1, rows=max(0, lacks))
