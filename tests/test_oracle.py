"""Every query with SQL gives what DuckDB gives on the small tables; the others give rows."""

import datetime
import decimal
import math
import os

import duckdb
import pytest

from sievecraft import registry

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
registry.load()
SLOW = {"strategy_surrogate_masks", "select_boruta", "train_strategy_models", "model_classes"}


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return c


def norm(v):
    if v is None or isinstance(v, bool):
        return v
    if isinstance(v, (float, decimal.Decimal)):
        v = float(v)
        return None if math.isnan(v) else float(f"{v:.7g}") + 0.0
    if isinstance(v, (list, tuple)):
        return tuple(map(norm, v))
    return str(v) if isinstance(v, datetime.datetime) else v


def rows(names, data):
    at = sorted(range(len(names)), key=lambda i: names[i])
    return sorted((tuple(norm(r[i]) for i in at) for r in data), key=repr)


@pytest.mark.skipif(not os.path.isdir(SF), reason="no tables")
@pytest.mark.parametrize("name", sorted(set(registry.QUERIES) - SLOW))
def test_query(spark, con, name):
    df = registry.QUERIES[name](spark, SF)
    got = rows(df.columns, df.collect())
    if name in registry.ORACLES:
        want = con.sql(registry.ORACLES[name])
        assert sorted(df.columns) == sorted(want.columns)
        assert len(got) == len(expected := rows(want.columns, want.fetchall()))
        for a, b in zip(got, expected):
            for x, y in zip(a, b):
                assert x == y or isinstance(x, float) and math.isclose(x, y, rel_tol=1e-5, abs_tol=1e-6), (a, b)
    else:
        assert got
