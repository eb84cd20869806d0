"""Splits, folds and samples: deterministic by a hash order of ids, exact in every class, without a task per class."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: Memory of the vectors that a fit keeps of one partition, as objects; each takes VECTOR_BYTES beside its components.
PART_BYTES = 64_000_000
VECTOR_BYTES = 72


def hash_order(id_col: str, seed: int = 0) -> Column:
    return F.md5(F.concat_ws(":", F.lit(str(seed)), F.col(id_col).cast("string")))


def class_ranks(df: DataFrame, id_col: str, label: str | None, seed: int = 0) -> DataFrame:
    """df with __rank (from 1, in hash order) and __n, both per class.

    Rows are ranked inside 256 slices of the hash; the slices' counts (classes x 256 rows) shift them.
    """
    rows = df.withColumn("__h", hash_order(id_col, seed)).withColumn("__slice", F.substring("__h", 1, 2)).withColumn("__y", F.col(label) if label else F.lit(0))
    counts = rows.groupBy("__y", "__slice").agg(F.count("*").alias("__c"))
    w = W.partitionBy("__y")
    shifts = counts.select("__y", "__slice", (F.sum("__c").over(w.orderBy("__slice")) - F.col("__c")).alias("__before"), F.sum("__c").over(w).alias("__n"))
    local = F.row_number().over(W.partitionBy("__y", "__slice").orderBy("__h", id_col))
    out = rows.withColumn("__local", local).join(F.broadcast(shifts), ["__y", "__slice"])
    return out.withColumn("__rank", F.col("__local") + F.col("__before")).drop("__h", "__slice", "__y", "__local", "__before")


def split(df: DataFrame, id_col: str, label: str | None, train: float = 0.6, valid: float = 0.2, seed: int = 0) -> DataFrame:
    """df with split = train, valid or test, in these shares of every class (of the table without a label)."""
    part = F.when(F.col("__rank") <= F.lit(train) * F.col("__n"), "train").when(F.col("__rank") <= F.lit(train + valid) * F.col("__n"), "valid").otherwise("test")
    return class_ranks(df, id_col, label, seed).withColumn("split", part).drop("__rank", "__n")


def kfold(df: DataFrame, id_col: str, k: int, label: str | None = None, seed: int = 0, out: str = "fold") -> DataFrame:
    return class_ranks(df, id_col, label, seed).withColumn(out, F.pmod(F.col("__rank") - 1, F.lit(k)).cast("int")).drop("__rank", "__n")


def group_kfold(df: DataFrame, group: str, k: int, out: str = "fold") -> DataFrame:
    """No group crosses folds: groups by descending size are dealt in turn. The window runs over groups."""
    sizes = df.groupBy(group).agg(F.count("*").alias("__n"))
    folds = sizes.select(group, F.pmod(F.row_number().over(W.orderBy(F.desc("__n"), group)) - 1, F.lit(k)).cast("int").alias(out))
    return df.join(folds, group)


def sample_per_class(df: DataFrame, id_col: str, label: str, n: int, seed: int = 0) -> DataFrame:
    """n rows of every class, first in hash order."""
    return class_ranks(df, id_col, label, seed).where(F.col("__rank") <= n).drop("__rank", "__n")


def fixed_sample(df: DataFrame, id_col: str, label: str, n: int, seed: int = 0) -> DataFrame:
    """About n rows in all, each class by its share."""
    total = df.count()
    return class_ranks(df, id_col, label, seed).where(F.col("__rank") <= F.round(F.lit(n) * F.col("__n") / F.lit(total))).drop("__rank", "__n")


def uncertainty(probs: Column) -> Column:
    """1 - the sum of the two largest probabilities of several classes, 1 - the largest of two."""
    top = F.sort_array(probs, asc=False)
    return F.when(F.size(probs) > 2, 1 - top[0] - top[1]).otherwise(1 - top[0])


def ucb_scores(arms: DataFrame, alpha: float = 1.0) -> DataFrame:
    """arms (arm, n, reward): mean reward + alpha * sqrt(2 ln N / n)."""
    total = F.sum("n").over(W.partitionBy())
    return arms.withColumn("ucb", F.col("reward") / F.col("n") + F.lit(alpha) * F.sqrt(2 * F.ln(total) / F.col("n")))


def ucb_allocate(arms: DataFrame, batch: int, alpha: float = 1.0) -> DataFrame:
    """Rows of the next batch per arm, in proportion to its bound; what rounding leaves goes to the best arms."""
    s = ucb_scores(arms, alpha)
    share = F.floor(F.lit(batch) * F.col("ucb") / F.sum("ucb").over(W.partitionBy()))
    s = s.withColumn("rows", share)
    left = F.lit(batch) - F.sum("rows").over(W.partitionBy())
    return s.withColumn("rows", F.col("rows") + (F.row_number().over(W.orderBy(F.desc("ucb"), "arm")) <= left).cast("int"))


def round_robin(df: DataFrame, cluster: str, id_col: str) -> DataFrame:
    """Order rows by turns through the clusters, larger clusters first."""
    sizes = df.groupBy(cluster).agg(F.count("*").alias("__n"))
    order = sizes.select(cluster, F.row_number().over(W.orderBy(F.desc("__n"), cluster)).alias("__o"))
    ranked = class_ranks(df, id_col, cluster).join(F.broadcast(order), cluster)
    return ranked.withColumnRenamed("__rank", "turn").withColumnRenamed("__o", "place").drop("__n")


def fit_even(df: DataFrame, features: list[str], fit: Callable[[DataFrame], object], width: int | None = None) -> object:
    """fit(features of df), for fits that keep their partitions as vectors (of this width): none takes much more than PART_BYTES.

    A file split holds as many rows as its compression lets it. If one is too large, rows are dealt once by their place,
    whatever their values, and keep the table's order, by which a fit draws.
    """
    rows = df.select(*features)
    most = max(1, PART_BYTES // (8 * (width or len(features)) + VECTOR_BYTES))
    largest, count = rows.groupBy(F.spark_partition_id()).agg(F.count("*").alias("n")).agg(F.max("n"), F.sum("n")).first()
    if not count or largest <= most:
        return fit(rows)
    placed = rows.withColumn("__row", F.monotonically_increasing_id())
    even = placed.repartition(-(-count // most), "__row").sortWithinPartitions("__row").persist()
    try:
        return fit(even)
    finally:
        even.unpersist()


def cluster_rows(df: DataFrame, features: list[str], k: int, seed: int = 42) -> DataFrame:
    """df with the KMeans cluster of its standardised features."""
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.feature import StandardScaler

    from .rank import assembled

    vectors = lambda rows: assembled(rows.withColumn("__zero", F.lit(0)), features, "__zero")
    data = vectors(df)
    scaler = StandardScaler(inputCol="features", outputCol="scaled").fit(data)
    kmeans = KMeans(k=k, seed=seed, featuresCol="scaled", predictionCol="cluster", maxIter=10)
    model = fit_even(df, features, lambda rows: kmeans.fit(scaler.transform(vectors(rows))), scaler.std.size)
    return model.transform(scaler.transform(data)).drop("features", "scaled", "__zero", "__y")


def oversample_minority(df: DataFrame, features: list[str], label: str, id_col: str, minority: int, neighbours: int = 5, rows: int | None = None) -> DataFrame:
    """Synthetic rows between minority rows and their near neighbours of the class, ``rows`` in all.

    Every minority row is an anchor. Rows are dealt evenly: draw 1, 2, ... of an anchor takes its next neighbour, with a
    share of its own. Without ``rows``, one for each anchor and neighbour. Rows without all features can't take part.
    """
    from ..scratch import cut
    from .neighbours import placed
    from .select import nearest

    own = placed(df.where(F.col(label) == minority), features)
    near = cut(nearest(own, None, features, id_col, neighbours), "near")
    if rows is None:
        draws = near.withColumn("draw", F.col("rank").cast("long"))
    else:
        anchors = near.groupBy("anchor").agg(F.count("*").alias("have"))
        # __rank and __n: place in hash order, number of anchors
        each = class_ranks(anchors, "anchor", None)
        quota = F.floor(F.lit(rows) / F.col("__n")) + (F.col("__rank") <= F.pmod(F.lit(rows), F.col("__n"))).cast("long")
        each = each.withColumn("quota", quota).where("quota > 0").select("anchor", "have", F.explode(F.sequence(F.lit(1).cast("long"), F.col("quota"))).alias("draw"))
        draws = each.withColumn("rank", (F.pmod(F.col("draw") - 1, F.col("have")) + 1).cast("int")).join(near, ["anchor", "rank"])
    share = F.pmod(F.xxhash64("anchor", "id", "draw"), F.lit(1000)) / 1000.0
    a = own.select(F.col(id_col).alias("anchor"), *[F.col(f).alias(f"a_{f}") for f in features])
    b = own.select(F.col(id_col).alias("id"), *features)
    return draws.join(a, "anchor").join(b, "id").select("anchor", "id", *[(F.col(f"a_{f}") + share * (F.col(f) - F.col(f"a_{f}"))).alias(f) for f in features], F.lit(minority).alias(label))
