"""All queries over the reference tables, with the SQL that states the same result."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

#: The main labelled table: lines with four numeric features, whether they were returned, and a group flag.
LINES_SQL = """SELECT l_orderkey * 10 + l_linenumber AS row_id, l_quantity AS quantity, l_extendedprice AS price,
    l_discount AS discount, l_tax AS tax, CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END AS label,
    CASE WHEN l_linestatus = 'F' THEN 1 ELSE 0 END AS grp FROM lineitem"""
FEATURES = ["quantity", "price", "discount", "tax"]


def query(name: str, sql: str | None = None):
    """Register a query, and its SQL if there is one. {lines} in the SQL stands for the labelled table."""

    def add(f):
        QUERIES[name] = f
        if sql is not None:
            ORACLES[name] = sql.replace("{lines}", f"({LINES_SQL})")
        return f

    return add


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """row_id, four features, label, grp."""
    c = F.col
    return read(spark, sf_dir, "lineitem").select(
        (c("l_orderkey") * 10 + c("l_linenumber")).alias("row_id"),
        c("l_quantity").alias("quantity"),
        c("l_extendedprice").alias("price"),
        c("l_discount").alias("discount"),
        c("l_tax").alias("tax"),
        F.when(c("l_returnflag") == "R", 1).otherwise(0).alias("label"),
        F.when(c("l_linestatus") == "F", 1).otherwise(0).alias("grp"),
    )


def r6(c, name: str | None = None):
    """Rounded to six places, as both engines state it."""
    out = F.round(c, 6)
    return out.alias(name) if name else out


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .plans.q_search import select_features

    return select_features(spark, sf_dir)


def load() -> None:
    """Import the modules that register queries."""
    from .plans import q_build, q_catalog, q_evaluate, q_extend, q_frontier, q_models, q_profile, q_rank, q_runlog, q_sample, q_search, q_select, q_sources, q_transform  # noqa: F401


