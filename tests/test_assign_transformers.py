"""Date columns by their first value, and latitude with longitude only, are among the assigned families."""

import duckdb
import pytest
from pyspark.sql import functions as F

from sievecraft import registry
from sievecraft.operators import profile as pf

registry.load()


def families(df, order="id"):
    out = {}
    for r in pf.assign_transformers(df, order).collect():
        out.setdefault(r.col, set()).add(r.family)
    return out


def test_dates_and_positions(spark):
    rows = [(i, "2020-01-0" + str(i + 1) if i else "3 May 1999", "word" if i else None, "x" if i else "10:30", float(i), float(-i), 200.0 + i) for i in range(8)]
    df = spark.createDataFrame(rows, "id long, day string, none string, first string, lat_a double, Longitude double, lon_far double").repartition(3)
    got = families(df)
    assert {c for c, f in got.items() if "date" in f} == {"day", "first"}
    assert {c for c, f in got.items() if "latitude_longitude" in f} == {"lat_a", "Longitude"}
    alone = families(df.drop("Longitude"))
    assert not any("latitude_longitude" in f for f in alone.values())
    assert "date" not in families(df.withColumn("id", -F.col("id")))["first"]


@pytest.mark.parametrize("value", ["1996-09-13", "1996-09-13 10:11:12", "13/09/1996", "3 May 1999", "May 3, 1999", "19960913", "FURNITURE", "", "a1996-09-13"])
def test_sql_agrees_on_the_first_value(spark, tmp_path, value):
    rows = [(i, f"n{i}", i % 3, float(i), value if i == 4 else "zzz") for i in range(4, 40)]
    df = spark.createDataFrame(rows, "c_custkey long, c_name string, c_nationkey int, c_acctbal double, c_mktsegment string").repartition(2)
    df.write.parquet(str(tmp_path / "customer.parquet"))
    got = {tuple(r) for r in registry.QUERIES["assign_transformers"](spark, str(tmp_path)).collect()}
    con = duckdb.connect()
    con.sql(f"CREATE VIEW customer AS SELECT * FROM '{tmp_path}/customer.parquet/*.parquet'")
    assert got == set(con.sql(registry.ORACLES["assign_transformers"]).fetchall())
    assert (("c_mktsegment", "date") in got) == pf.is_date(value)
