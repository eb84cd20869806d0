"""Exact dedup by skew-safe combining.

Digests are counted first, so that only texts whose digest occurs again travel. These are combined three times,
each time comparing the full content beside its digest: inside every map task (partial aggregation), then per salt
of a digest, then over the salts' winners. A hot text is thus at most one row per task in the first shuffle and one
row per salt in the second.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..scratch import cut
from .common import table

#: Up to so many digests that occur again (some tens of MB as longs) are broadcast to choose their rows.
BROADCAST_DIGESTS = 1_000_000


def winners(docs: DataFrame, content: Column, digest: Column, id_col: str = "doc_id", salts: int = 16, keep: str = "max") -> DataFrame:
    """(digest, content, keep_id, n): one row per distinct content, with its largest (or smallest) id and number of rows."""
    best = {"max": F.max, "min": F.min}[keep]
    rows = docs.select(digest.alias("digest"), content.alias("content"), F.col(id_col).alias("id"), F.pmod(F.xxhash64(F.col(id_col)), F.lit(salts)).alias("salt"))
    salted = rows.groupBy("digest", "salt", "content").agg(best("id").alias("keep_id"), F.count("*").alias("n"))
    return salted.groupBy("digest", "content").agg(best("keep_id").alias("keep_id"), F.sum("n").alias("n"))


def repeated_rows(docs: DataFrame, digest: Column) -> DataFrame:
    """The rows whose digest occurs again, and a few others where hashes of digests are equal.

    All rows, where more than half of them are such or their digests are too many to broadcast.
    """
    again = cut(docs.groupBy(digest.alias("digest")).agg(F.count("*").alias("n")).where("n > 1"), "repeated")
    size = again.agg(F.count("*").alias("digests"), F.coalesce(F.sum("n"), F.lit(0)).alias("rows")).first()
    if size.digests > BROADCAST_DIGESTS or 2 * size.rows > docs.count():
        return docs
    chosen = again.select(F.xxhash64("digest").alias("__hash")).distinct()
    return docs.withColumn("__hash", F.xxhash64(digest)).join(F.broadcast(chosen), "__hash", "left_semi").drop("__hash")


def exact_dedup(docs: DataFrame, text_col: str = "text", id_col: str = "doc_id", salts: int = 16, digest=None, hot_share: int = 1024, keep: str = "max") -> DataFrame:
    """Every row of ``docs`` with keep_id, group_size, kept and text_sha256 added (clashing columns replaced).

    Null text counts as empty. Of equal texts the row with the largest id (smallest with ``keep="min"``) stays; of rows that share that id too
    (repeated rows), each is marked kept, as they cannot be told apart. A null id never beats another id; a
    group whose ids are all null has a null keep_id and kept = true. An empty table gives an empty result.

    Winners return to the rows by digest. Contents with more than 1/``hot_share`` of all rows (fewer than
    ``hot_share`` of them by definition) are broadcast, so no digest makes a task of more than that share.
    Digests that stand for several contents, if there ever are any, are resolved by full text.
    """
    content = F.coalesce(F.col(text_col), F.lit(""))
    digest = digest or (lambda c: F.unhex(F.sha2(c, 256)))
    found = cut(winners(repeated_rows(docs.select(id_col, text_col), digest(content)), content, digest(content), id_col, salts, keep).select("digest", "keep_id", "n"), "winners")
    total = docs.count()
    per = found.groupBy("digest").agg(F.count("*").alias("contents"), F.max("keep_id").alias("keep_id"), F.max("n").alias("n"))
    several = per.where("contents > 1").select("digest")
    rows = docs.select(*[c for c in docs.columns if c not in ("keep_id", "group_size", "kept", "text_sha256")]).withColumn("__digest", digest(content)).withColumn("text_sha256", F.sha2(content, 256))
    if not several.isEmpty():
        # the digest asked for collides: compare whole texts
        full = winners(docs, content, digest(content), id_col, salts, keep)
        out = rows.withColumn("__content", content).join(full.select(F.col("digest").alias("__digest"), F.col("content").alias("__content"), "keep_id", F.col("n").alias("group_size")), ["__digest", "__content"]).drop("__content")
    else:
        least = max(2, total // hot_share + 1)
        hot = found.where(F.col("n") >= least).select(F.col("digest").alias("__digest"), F.col("keep_id").alias("__hk"), F.col("n").alias("__hn"))
        rest = found.where((F.col("n") < least) & (F.col("n") > 1)).select(F.col("digest").alias("__digest"), F.col("keep_id").alias("__k"), F.col("n").alias("__n"))
        marked = rows.join(F.broadcast(hot), "__digest", "left")
        # rows of hot contents need no further partner: a key of their own, with or without an id, spreads them over the join's tasks
        key = F.when(F.col("__hn").isNotNull(), F.unhex(F.sha2(F.concat_ws(":", F.lit("hot"), F.col(id_col).cast("string"), F.monotonically_increasing_id().cast("string")), 224))).otherwise(F.col("__digest"))
        marked = marked.withColumn("__key", key).drop("__digest")
        out = marked.join(rest.withColumnRenamed("__digest", "__key"), "__key", "left")
        single = F.lit(1).cast("long")
        out = out.withColumn("keep_id", F.when(F.col("__hn").isNotNull(), F.col("__hk")).when(F.col("__n").isNotNull(), F.col("__k")).otherwise(F.col(id_col))).withColumn("group_size", F.coalesce("__hn", "__n", single)).drop("__key", "__hk", "__hn", "__k", "__n")
    return out.drop("__digest").withColumn("kept", F.coalesce(F.col(id_col) == F.col("keep_id"), F.col("keep_id").isNull()))


def op10_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, keep_id, group_size, kept, text_sha256 for every row of documents."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return exact_dedup(docs).select("doc_id", "keep_id", "group_size", "kept", "text_sha256")


SQL = {
    "op10_exact_dedup": """
        SELECT doc_id, max(doc_id) OVER g AS keep_id, count(*) OVER g AS group_size,
               doc_id = max(doc_id) OVER g AS kept, sha256(coalesce(text, '')) AS text_sha256
        FROM documents WINDOW g AS (PARTITION BY coalesce(text, ''))
    """
}
