import pyspark.ml.clustering as mc
import pytest
from pyspark.sql import functions as F

from sievecraft import registry
from sievecraft.operators import sample as sm


@pytest.fixture
def fitted(monkeypatch):
    """Rows by partition of each table that KMeans is fitted on."""
    parts, fit = [], mc.KMeans.fit

    def spy(self, data, params=None):
        parts.append(sorted(r[1] for r in data.groupBy(F.spark_partition_id()).count().collect()))
        return fit(self, data, params)

    monkeypatch.setattr(mc.KMeans, "fit", spy)
    return parts


def test_one_large_split_is_dealt(spark, fitted):
    """A million rows in one split, most of them equal: no partition of the fit holds over 64 MB of vectors, no row is lost."""
    v = F.when(F.col("id") % 10 < 8, 0).otherwise(F.col("id") % 10).cast("double")
    df = spark.range(0, 1_000_000, 1, 1).select("id", *[(v * i).alias(f"f{i}") for i in range(1, 5)])
    out = sm.cluster_rows(df, ["f1", "f2", "f3", "f4"], 3)
    assert sum(fitted[0]) == 1_000_000 and max(fitted[0]) < 64_000_000 / 100
    assert out.columns == ["id", "f1", "f2", "f3", "f4", "cluster"]
    n = {r.f1: (r.n, r.c) for r in out.groupBy("f1").agg(F.count("*").alias("n"), F.collect_set("cluster").alias("c")).collect()}
    assert {k: m for k, (m, _) in n.items()} == {0.0: 800_000, 8.0: 100_000, 9.0: 100_000}
    assert sorted(c for _, cs in n.values() for c in cs) == [0, 1, 2]


@pytest.mark.parametrize("name, most", [("cluster_rows", 80_000), ("kmeans_target", 4_000), ("cluster_transform", 4_000)])
def test_dealt_queries_repeat(spark, fitted, monkeypatch, name, most):
    """All three fits are dealt when a partition is too large, and give the same clusters again."""
    monkeypatch.setattr(sm, "PART_BYTES", most, raising=False)
    registry.load()
    once, again = (sorted(map(tuple, registry.QUERIES[name](spark, "/root/testdata/sf0.001").collect())) for _ in range(2))
    assert once == again
    assert all(max(p) < 1.8 * most / 80 for p in fitted)


def test_small_and_odd_tables_stay(spark, fitted):
    """Rows without a feature get no cluster; small tables keep their partitions."""
    df = spark.createDataFrame([(i, None if i % 5 == 0 else float(i % 2)) for i in range(40)], "id int, f double").repartition(3, "id")
    out = sm.cluster_rows(df, ["f"], 2)
    assert len(fitted[0]) == 3 and out.count() == 32
    assert out.groupBy("f").agg(F.countDistinct("cluster").alias("c")).where("c != 1").count() == 0
