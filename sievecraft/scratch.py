"""The folder that driver and executors share, and tables written there to cut lineage."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Number of equal rows in what ``counted`` makes.
ROWS = "__n"


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir; a temporary folder only where it is unset and Spark runs in one process."""
    path = spark.conf.get("spark.checkpoint.dir", None) or spark.conf.get("spark.sievecraft.scratch", None)
    if not path:
        master = spark.conf.get("spark.master", "")
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        path = tempfile.mkdtemp(prefix="spark-")
        spark.conf.set("spark.sievecraft.scratch", path)
    return path.rstrip("/")


def shared_path(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder."""
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def cut(df: DataFrame, name: str = "table") -> DataFrame:
    """Write a table into the shared folder and read it back, which cuts the lineage; survives lost executors."""
    path = shared_path(df.sparkSession, name)
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._scratch_path = path
    return out


def counted(df: DataFrame, name: str = "counted") -> DataFrame:
    """Different rows of a table with their number, written; for sums over rows that are gone through many times."""
    return cut(df.groupBy(*[f"`{c}`" for c in df.columns]).agg(F.count("*").alias(ROWS)), name)


def discard(df: DataFrame) -> None:
    """Delete what ``cut`` wrote for a table that nothing reads any more."""
    if path := getattr(df, "_scratch_path", None):
        jvm, conf = df.sparkSession._jvm, df.sparkSession.sparkContext._jsc.hadoopConfiguration()
        p = jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(conf).delete(p, True)
