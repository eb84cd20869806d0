import pytest
from pyspark.sql import functions as F

from sievecraft.functions import text

ROWS = [(1, "The Cat, the cat sat"), (1, "the cat"), (2, None), (3, "\u212aelvin k 42 the cat"), (None, "the cat the"), (None, "the"), (2**53 + 1, "sat the cat")]


def _rows(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def test_word_counts_are_those_of_the_grams(spark):
    """Repeated and null ids are counted together; ids beyond a double's digits stay."""
    docs = spark.createDataFrame(ROWS, "doc_id long, text string")
    got = _rows(text.word_counts(docs, "doc_id", F.col("text"), 2))
    assert got == _rows(text.gram_counts(docs, "doc_id", text.words_and_ngrams(text.tokens(F.col("text")), 2)))
    assert (1, "the cat", 3) in got and (None, "the", 3) in got and (3, "kelvin", 1) in got and (2**53 + 1, "sat the", 1) in got


@pytest.mark.parametrize("options", [{}, {"min_df": 2}, {"max_df": 0.6, "norm": False}])
def test_tf_idf_large_vocabulary(spark, monkeypatch, options):
    """The shuffled vocabulary gives the same weights, from counts that are made once a pass."""
    docs = spark.createDataFrame([(i, f"the cat{i % 7} sat{i % 300} on {i}") for i in range(600)], "doc_id long, text string")
    counts = text.word_counts(docs, "doc_id", F.col("text"), 2)
    small = text.tf_idf(counts, 600, "doc_id", **options)
    monkeypatch.setattr(text, "BROADCAST_TERMS", 0)
    large = text.tf_idf(counts, 600, "doc_id", **options)
    assert large._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0].count("MapInArrow ") == 1
    rounded = lambda df: _rows(df.select("doc_id", "term", F.round("weight", 9)))
    assert rounded(large) == rounded(small) and small.count()
