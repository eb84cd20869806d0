"""Text features: lengths, numbers, n-grams with tf-idf, hashed tokens, dates."""

from __future__ import annotations

import itertools
import re
from collections import Counter
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..scratch import cut

#: A vocabulary of at most so many terms (some tens of MB) is broadcast whole.
BROADCAST_TERMS = 500_000
#: Places that rows of frequent terms are spread over.
PLACES = 4096
WORD = r"[a-z0-9]+"


def parse_numbers(c: Column, most: int = 5) -> Column:
    """The first ``most`` runs of digits as numbers, padded with zeros."""
    found = F.transform(F.slice(F.regexp_extract_all(c, F.lit(r"\d+"), F.lit(0)), 1, most), lambda x: F.coalesce(x.try_cast("long"), F.lit(0)))
    return F.slice(F.concat(F.coalesce(found, F.array().cast("array<long>")), F.array_repeat(F.lit(0).cast("long"), most)), 1, most)


def tokens(c: Column) -> Column:
    """Lower-case words of ASCII letters and digits."""
    return F.regexp_extract_all(F.lower(F.coalesce(c, F.lit(""))), F.lit(WORD), F.lit(0))


def word_ngrams(words: Column, n: int) -> Column:
    """Space-joined n-grams of an array of words: the array zipped with itself, shifted."""
    last = F.greatest(F.size(words) - n + 1, F.lit(0))
    return reduce(lambda grams, j: F.zip_with(grams, F.slice(words, F.lit(j + 1), last), lambda a, b: F.concat(a, F.lit(" "), b)), range(1, n), F.slice(words, F.lit(1), last))


def words_and_ngrams(words: Column, n: int) -> Column:
    """An array's words, then their n-grams. The array is bound to a variable first, as it would be split again for every gram."""
    return F.flatten(F.transform(F.array(words), lambda w: F.concat(w, word_ngrams(w, n))))


def char_ngrams(c: Column, n: int) -> Column:
    last = F.length(c) - n + 1
    return F.when(last >= 1, F.transform(F.sequence(F.lit(1), last), lambda i: F.substring(c, i, F.lit(n)))).otherwise(F.array().cast("array<string>"))


#: Terms that a task of ``word_counts`` gives at once.
BATCH_TERMS = 200_000


def gram_counts(df: DataFrame, id_col: str, grams: Column) -> DataFrame:
    """(id, term, tf) of an array of terms. The texts travel, not their grams, which are several times as long."""
    return df.repartition(id_col).select(id_col, F.explode(grams).alias("term")).groupBy(id_col, "term").agg(F.count("*").alias("tf"))


def word_counts(df: DataFrame, id_col: str, text: Column, n: int) -> DataFrame:
    """(id, term, tf) of the words of ``tokens`` and their n-grams; texts of one id, dealt and sorted by it, are counted together."""
    words = re.compile(WORD)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first = next(batches, None)
        if first is None:
            return
        id_type = first.schema.field(0).type
        rows = (r for b in itertools.chain([first], batches) for r in zip(b.column(0).to_pylist(), b.column(1).to_pylist()))
        ids, sizes, terms, tfs = [], [], [], []

        def batch() -> pa.RecordBatch:
            at = pa.array(np.repeat(np.arange(len(ids)), sizes))
            return pa.RecordBatch.from_arrays([pa.array(ids, id_type).take(at), pa.array(terms, pa.string()), pa.array(tfs, pa.int64())], names=[id_col, "term", "tf"])

        for name, same in itertools.groupby(rows, key=lambda r: r[0]):
            counts: Counter[str] = Counter()
            for _, t in same:
                found = words.findall(t)
                counts.update(found)
                counts.update(map(" ".join, zip(*[found[j:] for j in range(n)])))
            ids.append(name)
            sizes.append(len(counts))
            terms.extend(counts.keys())
            tfs.extend(counts.values())
            if len(terms) >= BATCH_TERMS:
                yield batch()
                ids, sizes, terms, tfs = [], [], [], []
        if terms:
            yield batch()

    schema = T.StructType([T.StructField(id_col, df.schema[id_col].dataType), T.StructField("term", T.StringType()), T.StructField("tf", T.LongType())])
    return df.select(id_col, F.lower(F.coalesce(text, F.lit(""))).alias("__text")).repartition(id_col).sortWithinPartitions(id_col).mapInArrow(run, schema)


def tf_idf(counts: DataFrame, total: int, id_col: str, min_df: int = 1, max_df: float = 1.0, sublinear: bool = False, smooth: bool = True, norm: bool = True) -> DataFrame:
    """(id, term, weight) from counts (id, term, tf) of ``total`` rows: tf * (ln((1 + n) / (1 + df)) + 1), L2-normalised per row.

    Terms outside the df limits are left out. Document frequencies are combined in every task before their shuffle and
    written; the vocabulary is joined by broadcast while it has at most ``BROADCAST_TERMS`` terms. Beyond that the terms in
    over a hundredth of the rows are broadcast (at most a hundred times the terms of a row), as these would be hot keys; their
    rows go through the other terms' join without a key, spread by their id, so counts are made once for both. The norm takes all
    weights to their row; sums over rows need it only afterwards.
    """
    df_of = counts.groupBy("term").agg(F.count("*").alias("df")).where((F.col("df") >= min_df) & (F.col("df") <= max_df * total))
    add = 1 if smooth else 0
    idf = F.ln((F.lit(total) + add) / (F.col("df") + add)) + 1.0
    vocabulary = cut(df_of.select("term", idf.alias("idf"), "df"), "vocabulary")
    tf = F.ln("tf") + 1.0 if sublinear else F.col("tf")
    if vocabulary.count() <= BROADCAST_TERMS:
        out = counts.join(F.broadcast(vocabulary), "term")
    else:
        often = F.col("df") > total / 100
        hot = vocabulary.where(often).select("term", F.col("idf").alias("__hot"))
        # of the two sides the vocabulary is the small one: it is hashed, so that the counts needn't be sorted
        rest = vocabulary.where(~often).select(F.col("term").alias("__key"), F.lit(0).cast("long").alias("__own"), "idf").hint("shuffle_hash")
        # rows of frequent terms have no key, so their term isn't written where nobody asks for it, and few different places
        own = F.when(F.col("__hot").isNull(), F.lit(0)).otherwise(F.pmod(F.xxhash64(id_col), F.lit(PLACES))).cast("long")
        marked = counts.join(F.broadcast(hot), "term", "left").withColumns({"__key": F.when(F.col("__hot").isNull(), F.col("term")), "__own": own})
        out = marked.join(rest, ["__key", "__own"], "left").withColumn("idf", F.coalesce("__hot", "idf")).where("idf IS NOT NULL")
    out = out.select(id_col, "term", (tf * F.col("idf")).alias("weight"))
    if not norm:
        return out
    length = F.sqrt(F.sum(F.col("weight") * F.col("weight")).over(W.partitionBy(id_col)))
    return out.select(id_col, "term", (F.col("weight") / length).alias("weight"))


def hash_vector(df: DataFrame, id_col: str, words: Column, buckets: int = 100) -> DataFrame:
    """(id, bucket, weight): words counted in hashed buckets, L2-normalised per row."""
    counts = df.select(id_col, F.explode(words).alias("w")).groupBy(id_col, F.pmod(F.xxhash64("w"), F.lit(buckets)).alias("bucket")).agg(F.count("*").alias("n"))
    length = counts.groupBy(id_col).agg(F.sqrt(F.sum(F.col("n") * F.col("n"))).alias("length"))
    return counts.join(length, id_col).select(id_col, "bucket", (F.col("n") / F.col("length")).alias("weight"))


def average_vectors(df: DataFrame, id_col: str, words: Column, vectors: DataFrame, word_col: str, vec_col: str, dims: int) -> DataFrame:
    """(id, v0..): mean vector of a row's known words; a row without any has none.

    Only vectors of words that occur are joined, cut to ``dims`` numbers: by broadcast up to ``BROADCAST_TERMS`` of them; beyond,
    those of words in over a hundredth of the rows are broadcast, which would be hot keys, and the others joined by shuffle.
    """
    found = df.select(id_col, F.explode(words).alias(word_col))
    seen = df.select(id_col, F.explode(F.array_distinct(words)).alias(word_col)).groupBy(word_col).agg(F.count("*").alias("__df"))
    needed = vectors.select(word_col, F.slice(vec_col, 1, dims).alias(vec_col))
    used = cut(needed.join(seen, word_col), "vectors")
    if used.count() <= BROADCAST_TERMS:
        found = found.join(F.broadcast(used), word_col)
    else:
        often = F.col("__df") > df.count() / 100
        hot = used.where(often)
        rest = found.join(F.broadcast(hot.select(word_col).distinct()), word_col, "left_anti").join(used.where(~often), word_col)
        found = found.join(F.broadcast(hot), word_col).unionByName(rest.select(*[word_col, id_col, vec_col, "__df"]))
    return found.groupBy(id_col).agg(*[F.avg(F.element_at(vec_col, i + 1)).alias(f"v{i}") for i in range(dims)])


FORMATS = ("yyyy-MM-dd HH:mm:ss", "yyyy-MM-dd", "MM/dd/yyyy", "dd.MM.yyyy")


def to_epoch(c: Column, formats=FORMATS) -> Column:
    """Seconds since 1970 by the first format that fits; NULL if none does."""
    return F.coalesce(*[F.unix_timestamp(F.try_to_timestamp(c, F.lit(f))) for f in formats])


def date_parts(c: Column) -> dict[str, Column]:
    return {"second": F.second(c), "minute": F.minute(c), "day": F.dayofmonth(c), "weekday": F.weekday(c), "month": F.month(c), "year": F.year(c)}
