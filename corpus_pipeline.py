"""Corpus pipeline: documents in, packed token sequences out.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sievecraft.llm.common import cut, table
from sievecraft.llm.exact_dedup import exact_dedup
from sievecraft.llm.ngram_join import jaccard_components
from sievecraft.llm.packing import pack
from sievecraft.llm.secret_scan import redact, secret_scan
from sievecraft.llm.toxicity import fit_toxicity, score_udf


#: The near-copy stage compares runs of five words and takes a similarity of 0.8 or more.
NEAR = {"shingle": 5, "least": 0.8}


def _with_row(docs: DataFrame) -> DataFrame:
    """doc_id, text, and the whole row beside them, so that no result column clashes with one of ``docs``."""
    return docs.select("doc_id", "text", F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"))


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose score says they aren't toxic.

    Null and empty texts get the score of an empty text; whole texts are scored, of any length; repeated rows are judged
    each; an empty table stays empty; columns of any name are kept as they are.
    """
    grammar = fit_toxicity(docs.select("doc_id", "text"), table(spark, sf_dir, "labels"))
    return docs.where(score_udf(grammar)(F.col("text")) < 0.5)


def drop_exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts, the row with the largest doc_id; null counts as empty.

    Rows that share that doc_id too all stay, as they can't be told apart, and so do all rows of a text without any id.
    Texts of any length are compared whole; an empty table stays empty; columns of any name are kept as they are.
    """
    return exact_dedup(_with_row(docs)).where("kept").select("row.*")


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents that shingle links connect, the one with the smallest doc_id.

    Documents without an id, and null or empty texts, link with nothing and stay; rows that share a doc_id stay or go
    together. Texts of any length are compared whole; an empty table stays empty; other columns are kept as they are.
    """
    gone = jaccard_components(docs.select("doc_id", "text"), **NEAR).where("doc_id <> component_id").select("doc_id").distinct()
    return docs.join(gone, "doc_id", "left_anti").select(*[F.col(f"`{c}`") for c in docs.columns])


def hide_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document, with secrets replaced by a mark; n_chars, where there is one, is counted again for those that change.

    Null texts stay null, empty ones empty; texts of any length are scanned whole; repeated rows are scanned each; an
    empty table stays empty; columns of any other name are kept as they are.
    """
    found = secret_scan(_with_row(docs))
    text = redact(F.col("text"), F.col("secrets"))
    n_chars = F.when(F.size("secrets") > 0, F.length("text")).otherwise(F.col("row.n_chars")).cast(docs.schema["n_chars"].dataType) if "n_chars" in docs.columns else None
    new = {"text": F.col("text"), "n_chars": n_chars}
    return found.withColumn("text", text).select(*[new[c].alias(c) if c in new else F.col(f"row.`{c}`").alias(c) for c in docs.columns])


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token pieces of all documents with their sequences and offsets.

    Null and empty texts are one piece of length 1; longer texts than a sequence are cut; repeated rows and rows without
    an id are packed each; an empty table gives no pieces; other columns are left out.
    """
    return pack(docs)


STAGES = [
    ("toxicity", drop_toxic),
    ("exact_dedup", drop_exact_copies),
    ("ngram_join", drop_near_copies),
    ("secret_scan", hide_secrets),
    ("packing", pack_sequences),
]

#: The learned toxicity score has no SQL form; tests hold each stage against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; each is written and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = cut(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
