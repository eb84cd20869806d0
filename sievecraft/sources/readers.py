"""Readers that give typed DataFrames, and writers of features and trials. All paths are Spark paths."""

from __future__ import annotations

import json
import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def read_csv(spark: SparkSession, path: str, target: int | None = None, schema: T.StructType | None = None) -> tuple[DataFrame, str | None]:
    """(features, name of the target column): the header names columns; the target is given by position."""
    reader = spark.read.option("header", True)
    df = (reader.schema(schema) if schema else reader.option("inferSchema", True)).csv(path)
    return df, None if target is None else df.columns[target]


def typed(df: DataFrame, categorical: list[str]) -> DataFrame:
    """Columns that aren't flagged as categorical become numbers; what isn't a number becomes NULL."""
    return df.select(*[F.col(c).cast("string").alias(c) if c in categorical else F.col(c).cast("string").try_cast("double").alias(c) for c in df.columns])


def read_schema_json_csv(spark: SparkSession, path: str, schema_json: str) -> DataFrame:
    """A CSV without inference: the schema is Spark's JSON form; the target column is named target."""
    return spark.read.option("header", True).schema(T.StructType.fromJson(json.loads(schema_json))).csv(path)


_ATTRIBUTE = re.compile(r"^@attribute\s+('[^']*'|\"[^\"]*\"|\S+)\s+(.+?)\s*$", re.I)


def read_arff(spark: SparkSession, path: str) -> DataFrame:
    """@attribute lines become typed columns (nominal values and the role of class@ columns as metadata); the body is CSV.

    Only header lines come to the driver; they are those that start with @.
    """
    header = [r.value for r in spark.read.text(path).where(F.col("value").startswith("@")).collect()]
    fields = []
    for line in header:
        if m := _ATTRIBUTE.match(line):
            name, kind = m[1].strip("'\""), m[2]
            nominal = [v.strip().strip("'\"") for v in kind[1:-1].split(",")] if kind.startswith("{") else None
            dtype = T.StringType() if nominal or kind.lower() == "string" else T.DoubleType()
            fields.append(T.StructField(name.split("@")[0], dtype, True, {"nominal": nominal or [], "role": "target" if name.startswith("class") else "feature"}))
    body = spark.read.text(path).where(~F.rlike(F.trim("value"), F.lit("^(@|%|$)")))
    parsed = body.select(F.from_csv("value", F.lit(T.StructType([T.StructField(f.name, f.dataType) for f in fields]).simpleString()[7:-1].replace(":", " ")), {"nullValue": "?", "quote": "'"}).alias("r")).select("r.*")
    return parsed.select(*[F.col(f.name).alias(f.name, metadata=f.metadata) for f in fields])


def text_corpus(df: DataFrame, text: str, label: str, id_col: str, train_share: float = 0.8) -> DataFrame:
    """(id, text, label, split): labels as numbers in sorted order, split by a hash of the id."""
    codes = df.select(label).where(F.col(label).isNotNull()).distinct()
    labels = sorted(r[0] for r in codes.collect())
    number = sum([F.when(F.col(label) == F.lit(v), F.lit(i)).otherwise(0) for i, v in enumerate(labels)], F.lit(0))
    split = F.when(F.pmod(F.crc32(F.col(id_col).cast("string")), F.lit(100)) < int(train_share * 100), "train").otherwise("test")
    return df.select(F.col(id_col), F.col(text).alias("text"), number.alias("label"), split.alias("split"))


def list_projects(spark: SparkSession, path: str, pattern: str = "*.csv") -> DataFrame:
    """(project, files, bytes): files of a tree by their folder; only file names and sizes are read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", pattern).load(path).select("path", "length")
    return files.groupBy(F.regexp_extract("path", r"([^/]+)/[^/]*$", 1).alias("project")).agg(F.count("*").alias("files"), F.sum("length").alias("bytes"))


def write_trials(trials: DataFrame, path: str) -> None:
    """Append records of a search."""
    trials.write.mode("append").parquet(path)


def export_features(df: DataFrame, exprs: dict[str, Column], scores: dict[str, float], target: str, path: str, top: int = 60) -> list[str]:
    """Write the best features and the target as CSV; returns their names."""
    names = sorted(scores, key=lambda n: (-scores[n], n))[:top]
    df.select(*[exprs[n].alias(n) for n in names], target).write.mode("overwrite").option("header", True).csv(path)
    return names


def rewrite_dataset(df: DataFrame, drop: list[str] = (), rename: dict[str, str] | None = None, classes: tuple[str, list] | None = None) -> DataFrame:
    """Drop and rename columns, and map a column's values to two classes: 1 for those listed."""
    out = df.drop(*drop).withColumnsRenamed(rename or {})
    if classes:
        out = out.withColumn(classes[0], F.when(F.col(classes[0]).isin(classes[1]), 1).otherwise(0))
    return out
