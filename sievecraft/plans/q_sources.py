"""Queries over sources and sinks: tables are written in a format and read back by the operator."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..registry import lines, query, r6, read
from ..sources import readers as src
from .scratch import shared_path

C = F.col


@query("read_csv", "SELECT s_nationkey, count(*) AS n, round(sum(s_acctbal), 2) AS total FROM supplier GROUP BY 1")
def read_csv(s, d):
    path = shared_path(s, "supplier-csv")
    read(s, d, "supplier").write.option("header", True).csv(path)
    df, target = src.read_csv(s, path, 2)
    return df.groupBy(C(target).cast("int").alias("s_nationkey")).agg(F.count("*").alias("n"), F.round(F.sum("s_acctbal"), 2).alias("total"))


@query("read_table", "SELECT p_partkey::DOUBLE AS p_partkey, try_cast(p_brand AS DOUBLE) AS p_brand, p_size::DOUBLE AS p_size, p_type FROM part")
def read_table(s, d):
    return src.typed(read(s, d, "part").select("p_partkey", "p_brand", "p_size", "p_type"), ["p_type"])


@query("read_schema_json_csv", "SELECT c_custkey, c_acctbal, c_mktsegment AS target FROM customer")
def read_schema_json_csv(s, d):
    df = read(s, d, "customer").select("c_custkey", "c_acctbal", C("c_mktsegment").alias("target"))
    path = shared_path(s, "customer-csv")
    df.write.option("header", True).csv(path)
    return src.read_schema_json_csv(s, path, df.schema.json())


@query("read_arff", "SELECT c_custkey::DOUBLE AS c_custkey, c_acctbal, c_mktsegment AS class FROM customer")
def read_arff(s, d):
    df = read(s, d, "customer")
    values = sorted(r[0] for r in df.select("c_mktsegment").distinct().collect())
    path = shared_path(s, "customer-arff")
    head = s.createDataFrame([(x,) for x in ("@relation customer", "@attribute c_custkey@NUMERIC numeric", "@attribute c_acctbal@REAL real", f"@attribute class@{{}} {{{','.join(values)}}}", "@data")], "value string")
    body = df.select(F.concat_ws(",", C("c_custkey").cast("string"), C("c_acctbal").cast("string"), "c_mktsegment").alias("value"))
    head.coalesce(1).write.text(path)
    body.write.mode("append").text(path)
    return src.read_arff(s, path)


@query("read_text_corpus", "SELECT doc_id, length(text)::INT AS n, quality::INT AS label FROM documents JOIN labels USING (doc_id)")
def read_text_corpus(s, d):
    df = read(s, d, "documents").join(read(s, d, "labels"), "doc_id")
    return src.text_corpus(df, "text", "quality", "doc_id").select("doc_id", F.length("text").alias("n"), C("label").cast("int").alias("label"))


@query("list_csv_projects")
def list_csv_projects(s, d):
    path = shared_path(s, "projects")
    for name in ("nation", "region", "supplier"):
        read(s, d, name).write.option("header", True).csv(f"{path}/{name}")
    return src.list_projects(s, path).select("project", "files")


@query("write_trials", "SELECT event_type AS strategy, count(*) AS n, round(min(value), 4) AS best FROM events GROUP BY 1")
def write_trials(s, d):
    path = shared_path(s, "trials")
    trials = read(s, d, "events").select(C("event_type").alias("strategy"), "value", "event_id")
    src.write_trials(trials.where("event_id % 2 = 0"), path)
    src.write_trials(trials.where("event_id % 2 <> 0"), path)
    return s.read.parquet(path).groupBy("strategy").agg(F.count("*").alias("n"), F.round(F.min("value"), 4).alias("best"))


@query("export_features_csv", "SELECT count(*) AS n, round(sum(price), 1) AS price, round(sum(quantity * discount), 4) AS qd, sum(label)::BIGINT AS label FROM {lines}")
def export_features_csv(s, d):
    path = shared_path(s, "features-csv")
    exprs = {"price": C("price"), "qd": C("quantity") * C("discount"), "tax": C("tax")}
    src.export_features(lines(s, d), exprs, {"price": 0.9, "qd": 0.8, "tax": 0.1}, "label", path, top=2)
    df, _ = src.read_csv(s, path)
    return df.agg(F.count("*").alias("n"), F.round(F.sum("price"), 1).alias("price"), F.round(F.sum("qd"), 4).alias("qd"), F.sum("label").cast("long").alias("label"))


@query("rewrite_dataset", "SELECT c_custkey AS id, c_acctbal, CASE WHEN c_mktsegment IN ('BUILDING', 'MACHINERY') THEN 1 ELSE 0 END AS c_mktsegment FROM customer")
def rewrite_dataset(s, d):
    return src.rewrite_dataset(read(s, d, "customer"), ["c_name", "c_nationkey"], {"c_custkey": "id"}, ("c_mktsegment", ["BUILDING", "MACHINERY"]))
