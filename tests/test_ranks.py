"""Ranks of columns in which a value holds a third of the rows."""

import numpy as np
import pytest

from sievecraft.functions import categorical, text, window
from pyspark.sql import functions as F


@pytest.mark.parametrize("hot", [5, 100_000])
def test_rows_of_a_frequent_value_are_numbered_over_tasks(spark, monkeypatch, hot):
    monkeypatch.setattr(window, "HOT_ROWS", hot)
    rows = [(i * 37 % 601, None if i % 10 == 9 else (5.0 if i % 3 == 0 else float(i % 50))) for i in range(601)]
    df = spark.createDataFrame(rows, "id long, value double").withColumn("n", F.lit(1))
    got = {r.id: r.r for r in window.row_ranks(df.withColumnRenamed("value", "x"), "x", "id", "r").collect()}
    order = sorted((v, i) for i, v in rows if v is not None)
    assert got == {i: None for i, v in rows if v is None} | {i: k + 1 for k, (_, i) in enumerate(order)}


def test_a_table_of_one_value_is_numbered_in_several_tasks(spark, monkeypatch):
    monkeypatch.setattr(window, "HOT_ROWS", 10)
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        out = window.row_ranks(spark.range(1000).selectExpr("id", "1.0 AS x"), "x", "id", "r")
        parts = out.withColumn("p", F.spark_partition_id()).groupBy("p").count().collect()
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
    assert out.columns == ["id", "x", "r"] and len(parts) > 1
    assert out.where("r = id + 1").count() == 1000


def test_words_and_ngrams_keep_their_order(spark):
    df = spark.createDataFrame([("a b c",), ("A",), ("",), (None,)], "t string")
    got = [r[0] for r in df.select(text.words_and_ngrams(text.tokens(F.col("t")), 2)).collect()]
    assert got == [["a", "b", "c", "a b", "b c"], ["a"], [], []]


def grouped(spark):
    """A group with half of the rows and many ties, rows without a key, a group without values, one with a single value."""
    rng = np.random.default_rng(2)
    rows = [(i, ["hot", None, "b"][0 if i % 2 else i % 3 % 2 + 1], float(rng.integers(0, 40)) / 4 if i % 11 else None) for i in range(400)]
    rows += [(900, "empty", None), (901, "one", 2.5)]
    groups = {}
    for _, k, v in rows:
        groups.setdefault(k, []).extend([] if v is None else [v])
    return spark.createDataFrame(rows, "id long, k string, v double"), rows, groups


def test_quantiles_of_groups(spark):
    df, _, groups = grouped(spark)
    got = {r.k: (r.low, r.mid, r.top) for r in window.group_quantiles(df, "k", "v", {"low": 0.1, "mid": 0.5, "top": 1.0}).collect()}
    assert set(got) == {k for k, v in groups.items() if v}
    for k, found in got.items():
        assert np.allclose(found, np.quantile(groups[k], [0.1, 0.5, 1.0])), k


@pytest.mark.parametrize("agg,of", [("median", np.median), ("max", max), ("mean", np.mean)])
def test_aggregates_over_the_table_itself(spark, agg, of):
    df, rows, groups = grouped(spark)
    out = categorical.group_by_then_over(df, "v", "k", agg, "x")
    got = {r.id: r.x for r in out.collect()}
    assert out.columns == ["id", "k", "v", "x"] and len(got) == len(rows)
    for i, k, _ in rows:
        assert got[i] is None if not groups[k] else np.isclose(got[i], of(groups[k]))
    assert "Window" not in out._jdf.queryExecution().optimizedPlan().toString() or agg == "median"


def test_unseen_keys_and_groups_without_values(spark):
    df, _, groups = grouped(spark)
    new = spark.createDataFrame([(1, "hot", -1.0), (2, "never", -2.0), (3, "empty", -3.0)], "id long, k string, v double")
    got = {r.id: r.x for r in categorical.group_by_then(df, new, "v", "k", "median", "x").collect()}
    assert got == {1: float(np.median(groups["hot"])), 2: -2.0, 3: -3.0}
