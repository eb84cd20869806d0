"""Feature rankings and information measures: (features, label) -> DataFrame(feature, score).

Sums per class are one aggregate over the rows with one expression per feature. Measures over values first count
(feature, value, label) in long form, combined in every task, and work on these counts.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def to_long(df: DataFrame, features: list[str], *keep: str) -> DataFrame:
    """One row per row and feature: feature, value and the kept columns."""
    pairs = F.array(*[F.struct(F.lit(f).alias("feature"), F.col(f).cast("double").alias("value")) for f in features])
    return df.select(*keep, F.explode(pairs).alias("p")).select(*keep, "p.feature", "p.value")


def unpivot(row: DataFrame, features: list[str], name: str = "score", prefix: str = "") -> DataFrame:
    """A one-row aggregate with a column per feature as (feature, score)."""
    return row.select(F.explode(F.array(*[F.struct(F.lit(f).alias("feature"), F.col(f"{prefix}{f}").cast("double").alias(name)) for f in features])).alias("p")).select("p.*")


def rank_variance(df: DataFrame, features: list[str], label: str | None = None) -> DataFrame:
    return unpivot(df.agg(*[F.var_pop(f).alias(f) for f in features]), features)


def classwise_stats(df: DataFrame, features: list[str], label: str) -> DataFrame:
    """(label, feature, n, s, ss): count, sum and sum of squares; the sufficient statistic of NB, F, Fisher and chi-square."""
    aggs = [g for f in features for g in (F.count(f).alias(f"n_{f}"), F.sum(F.col(f).cast("double")).alias(f"s_{f}"), F.sum(F.col(f).cast("double") * F.col(f)).alias(f"ss_{f}"))]
    wide = df.groupBy(F.col(label).alias("label")).agg(*aggs)
    each = F.array(*[F.struct(F.lit(f).alias("feature"), F.col(f"n_{f}").alias("n"), F.col(f"s_{f}").alias("s"), F.col(f"ss_{f}").alias("ss")) for f in features])
    return wide.select("label", F.explode(each).alias("p")).select("label", "p.*")


def rank_chi2(df: DataFrame, features: list[str], label: str) -> DataFrame:
    """Class sums of non-negative values against class share x feature total."""
    st = classwise_stats(df, features, label)
    w = W.partitionBy("feature")
    expected = F.sum("s").over(w) * F.col("n") / F.sum("n").over(w)
    return st.withColumn("e", expected).groupBy("feature").agg(F.sum((F.col("s") - F.col("e")) * (F.col("s") - F.col("e")) / F.col("e")).alias("score"))


def _within_between(df, features, label):
    st = classwise_stats(df, features, label)
    w = W.partitionBy("feature")
    mean = F.sum("s").over(w) / F.sum("n").over(w)
    own = F.col("s") / F.col("n")
    parts = st.withColumn("between", F.col("n") * (own - mean) * (own - mean)).withColumn("within", F.col("ss") - F.col("s") * own)
    return parts.groupBy("feature").agg(F.sum("between").alias("b"), F.sum("within").alias("w"), F.count("*").alias("k"), F.sum("n").alias("n"))


def rank_anova_f(df: DataFrame, features: list[str], label: str) -> DataFrame:
    x = _within_between(df, features, label)
    return x.select("feature", ((F.col("b") / (F.col("k") - 1)) / (F.col("w") / (F.col("n") - F.col("k")))).alias("score"))


def rank_fisher(df: DataFrame, features: list[str], label: str) -> DataFrame:
    """Between-class over within-class variance."""
    return _within_between(df, features, label).select("feature", F.try_divide("b", "w").alias("score"))


def _entropy(counts: DataFrame, by: list[str], n: str = "n") -> DataFrame:
    """(by, h): entropy in bits of the counts in each group."""
    total = F.sum(n)
    return counts.groupBy(*by).agg((F.log2(total) - F.sum(F.col(n) * F.log2(n)) / total).alias("h"))


def value_counts(df: DataFrame, features: list[str], label: str) -> DataFrame:
    """(feature, value, label, n)."""
    return to_long(df, features, label).groupBy("feature", "value", F.col(label).alias("label")).agg(F.count("*").alias("n"))


def information(df: DataFrame, features: list[str], label: str) -> DataFrame:
    """(feature, hx, hy, hxy, h_x_given_y, mi, su) in bits, on raw values."""
    counts = value_counts(df, features, label)
    hx = _entropy(counts.groupBy("feature", "value").agg(F.sum("n").alias("n")), ["feature"]).withColumnRenamed("h", "hx")
    hy = _entropy(counts.groupBy("feature", "label").agg(F.sum("n").alias("n")), ["feature"]).withColumnRenamed("h", "hy")
    hxy = _entropy(counts, ["feature"]).withColumnRenamed("h", "hxy")
    out = hx.join(hy, "feature").join(hxy, "feature").withColumn("h_x_given_y", F.col("hxy") - F.col("hy"))
    out = out.withColumn("mi", F.col("hx") - F.col("h_x_given_y"))
    return out.withColumn("su", F.coalesce(F.try_divide(2 * F.col("mi"), F.col("hx") + F.col("hy")), F.lit(0.0)))


def binned(df: DataFrame, features: list[str], n: int = 10) -> DataFrame:
    """Features replaced by the number of their equal-width bin; a constant one by 0."""
    row = df.agg(*[g(f).alias(f"{k}_{f}") for f in features for k, g in (("lo", F.min), ("hi", F.max))]).first()
    out = {}
    for f in features:
        lo, hi = float(row[f"lo_{f}"]), float(row[f"hi_{f}"])
        out[f] = F.least(F.floor((F.col(f) - lo) / F.lit((hi - lo) / n)), F.lit(n - 1)).cast("double") if hi > lo else F.lit(0.0)
    return df.withColumns(out)


def rank_mutual_info(df: DataFrame, features: list[str], label: str, n: int = 10) -> DataFrame:
    """Mutual information of binned values and label, in bits."""
    return information(binned(df, features, n), features, label).select("feature", F.col("mi").alias("score"))


def binned_mutual_info(df: DataFrame, a: str, b: str, n: int) -> DataFrame:
    """H(A) + H(B) - H(A, B) over n equal-width bins of both columns."""
    x = information(binned(df, [a, b], n), [a], b)
    return x.select(F.col("mi"))


def rank_fcbf(df: DataFrame, features: list[str], label: str, threshold: float | None = None, redundancy: bool = False) -> DataFrame:
    """Symmetrical uncertainty with the label, above the threshold (default: the least one, which goes).

    With ``redundancy``, a feature goes if a better kept one tells more about it than it tells about the label.
    """
    su = information(df, features, label).select("feature", F.col("su").alias("score"))
    least = F.lit(threshold) if threshold is not None else F.min("score").over(W.partitionBy())
    ranked = su.withColumn("least", least).where("score > least").drop("least")
    if not redundancy:
        return ranked
    order = [(r.feature, r.score) for r in ranked.orderBy(F.desc("score"), "feature").collect()]
    kept: list[tuple[str, float]] = []
    pair = {}
    for i, (p, _) in enumerate(order):
        rest = [q for q, _ in order[i + 1 :]]
        if rest:
            pair |= {(p, r.feature): r.su for r in information(df, rest, p).select("feature", "su").collect()}
    for q, score in order:
        if all(pair[(p, q)] < score for p, _ in kept):
            kept.append((q, score))
    return ranked.where(F.col("feature").isin([k for k, _ in kept]))


def rank_relieff(df: DataFrame, features: list[str], label: str, row_id: str, anchors: Column | None = None, k: int = 10) -> DataFrame:
    """ReliefF: for each anchor row the k nearest rows of its own class and of the others, on min-max scaled features.

    ``anchors`` is a predicate; without it every row is an anchor. Rows of one class with equal features have equal
    neighbours but for themselves, who add nothing, so they are searched once, with their number. Classes are searched in
    turn; tasks return sums only. A row counts itself out of its own class.
    """
    import pandas as pd

    from ..scratch import cut, discard
    from .neighbours import each_box, placed, points, ranked

    row = df.agg(*[g(f).alias(f"{n}_{f}") for f in features for n, g in (("lo", F.min), ("hi", F.max))]).first()
    wide = {f: float(row[f"hi_{f}"] - row[f"lo_{f}"]) for f in features}
    scale = {f: ((F.col(f) - row[f"lo_{f}"]) / F.lit(wide[f]) if wide[f] else F.col(f) * 0).cast("double") for f in features}
    asked = F.lit(True) if anchors is None else F.coalesce(anchors, F.lit(False))
    rows = placed(df.select(F.col(row_id).alias("id"), F.col(label).alias("y"), *[scale[f].alias(f) for f in features], asked.alias("__anchor")), features)
    by = ["y", *features]
    queries = cut(rows.where("__anchor").groupBy(*by).agg(F.count("*").alias("n")), "anchors")
    known = cut(points(rows, by, k + 1), "points")
    prior = {r.y: r["count"] for r in df.groupBy(F.col(label).alias("y")).count().collect()}
    total, count = sum(prior.values()), max(1, queries.agg(F.sum("n")).first()[0] or 0)
    score = dict.fromkeys(features, 0.0)
    typed = rows.schema["y"].dataType.simpleString()
    for c, n in prior.items():

        def sums(q, r, nearest, c=c):
            x, z, weight, same = q[features].to_numpy(), r[features].to_numpy(), q["n"].to_numpy(), (q["y"] == c).to_numpy()
            parts = []
            for near in nearest():
                a, b, _, _, place = ranked(r, near, k + 1)
                a, b = a[keep := place < k + same[a]], b[keep]
                parts.append(pd.DataFrame(abs(x[a] - z[b]) * weight[a][:, None], columns=features).groupby(q["y"].to_numpy()[a]).sum())
            out = pd.concat(parts).rename_axis("y").reset_index() if parts else pd.DataFrame({f: [] for f in ["y", *features]})
            return out.groupby("y", as_index=False).sum()

        schema = f"y {typed}, " + ", ".join(f"`{f}` double" for f in features)
        found = each_box(queries, known.where(F.col("y") == F.lit(c)).select("ids", *features), features, k + 1, 1, sums, schema)
        for part in found.groupBy("y").agg(*[F.sum(f).alias(f) for f in features]).collect():
            sign = -1.0 if part.y == c else (n / total) / (1 - prior[part.y] / total)
            for f in features:
                score[f] += sign * part[f] / (k * count)
    discard(queries)
    discard(known)
    return df.sparkSession.createDataFrame(list(score.items()), "feature string, score double")


def assembled(df: DataFrame, features: list[str], label: str) -> DataFrame:
    from pyspark.ml.feature import VectorAssembler

    return VectorAssembler(inputCols=features, outputCol="features", handleInvalid="skip").transform(df.withColumn("__y", F.col(label).cast("double")))


def rank_model_importance(df: DataFrame, features: list[str], label: str, model: str = "forest", seed: int = 7) -> DataFrame:
    """Impurity importances of a forest, or absolute logistic coefficients."""
    from pyspark.ml.classification import LogisticRegression, RandomForestClassifier

    data = assembled(df, features, label)
    if model == "forest":
        scores = RandomForestClassifier(labelCol="__y", numTrees=10, maxDepth=5, seed=seed).fit(data).featureImportances.toArray()
    else:
        scores = abs(LogisticRegression(labelCol="__y", maxIter=20).fit(data).coefficients.toArray())
    return df.sparkSession.createDataFrame([(f, float(v)) for f, v in zip(features, scores)], "feature string, score double")


def rank_fairness(df: DataFrame, features: list[str], sensitive: str, seed: int = 7) -> DataFrame:
    """Minus the importance for telling the sensitive flag; the flag itself has the worst score."""
    others = [f for f in features if f != sensitive]
    scores = rank_model_importance(df, others, sensitive, seed=seed).select("feature", (-F.col("score")).alias("score"))
    worst = df.sparkSession.createDataFrame([(sensitive, -1.0)], scores.schema) if sensitive in features else scores.limit(0)
    return scores.unionByName(worst)


def hash_places(df: DataFrame, row_id: str, *seed: Column) -> DataFrame:
    """``df`` with __r, each row's place from 1 in the order of its id's hash, then id; numbered range by range in one shuffle."""
    from ..functions.window import range_edges, range_of

    hashed = df.withColumn("__h", F.xxhash64(row_id, *seed))
    parts = hashed.withColumn("__part", range_of(F.col("__h"), range_edges(hashed, "__h")))
    counts = parts.groupBy("__part").agg(F.count("*").alias("__c"))
    earlier = counts.select("__part", (F.sum("__c").over(W.partitionBy().orderBy("__part")) - F.col("__c")).alias("__before"))  # a row a range
    place = F.row_number().over(W.partitionBy("__part").orderBy("__h", row_id)) + F.col("__before")
    return parts.join(F.broadcast(earlier), "__part").withColumn("__r", place).drop("__h", "__part", "__before")


def permuted(places: DataFrame, cols: list[str], row_id: str, seed: int, prefix: str = "shadow_") -> DataFrame:
    """``places`` (of ``hash_places``) with the columns' values dealt to other rows by a hash order, as ``prefix`` + column; a row's values stay together."""
    moved = hash_places(places.select(row_id, *cols), row_id, F.lit(seed)).select("__r", *[F.col(c).alias(f"{prefix}{c}") for c in cols])
    return places.join(moved, "__r")


def rank_permutation_importance(df: DataFrame, features: list[str], label: str, row_id: str, repeats: int = 5, seed: int = 7) -> DataFrame:
    """Mean drop of a logistic model's accuracy when a feature's values are shuffled among rows.

    A repeat shuffles all features in one order and scores each of them in one pass; the order by id is written once.
    """
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.feature import VectorAssembler

    from ..scratch import cut, discard

    data = assembled(df, features, label)
    model = LogisticRegression(labelCol="__y", maxIter=10).fit(data)
    base = model.transform(data).agg(F.avg((F.col("prediction") == F.col("__y")).cast("double"))).first()[0]
    kept = {f: f"__f{i}" for i, f in enumerate(features)}
    places = cut(hash_places(df.select(F.col(row_id).alias("__id"), F.col(label).cast("double").alias("__y"), *[F.col(f).cast("double").alias(k) for f, k in kept.items()]), "__id"), "places")
    total = dict.fromkeys(features, 0.0)
    for i in range(repeats):
        rows, hits = permuted(places, list(kept.values()), "__id", seed + i), []
        for f, k in kept.items():
            inputs = [f"shadow_{x}" if x == k else x for x in kept.values()]
            rows = VectorAssembler(inputCols=inputs, outputCol=f"v{k}", handleInvalid="keep").transform(rows)
            rows = model.transform(rows, {model.featuresCol: f"v{k}", model.predictionCol: f"p{k}", model.rawPredictionCol: "", model.probabilityCol: ""})
            missing = F.lit(False)
            for x in inputs:
                missing = missing | F.col(x).isNull() | F.isnan(x)
            hits.append(F.avg(F.when(~missing, (F.col(f"p{k}") == F.col("__y")).cast("double"))).alias(k))
        row = rows.agg(*hits).first()
        for f, k in kept.items():
            total[f] += row[k]
    discard(places)
    return df.sparkSession.createDataFrame([(f, base - total[f] / repeats) for f in features], "feature string, score double")


def consistency(df: DataFrame, features: list[str], label: str) -> DataFrame:
    """One row: share of rows whose feature tuple has one label only."""
    groups = df.groupBy(*features).agg(F.count("*").alias("n"), F.min(label).alias("lo"), F.max(label).alias("hi"))
    return groups.agg((F.sum(F.when(F.col("lo") == F.col("hi"), F.col("n")).otherwise(0)) / F.sum("n")).alias("consistency"))


def consistent_rows(df: DataFrame, features: list[str], label: str, out: str = "consistent") -> DataFrame:
    w = W.partitionBy(*features)
    return df.withColumn(out, F.min(label).over(w) == F.max(label).over(w))


def traceability(df: DataFrame, features: list[str], value: str) -> DataFrame:
    """One row: mean over value combinations of their rows / rows of the constructed value."""
    combos = df.groupBy(*features, value).agg(F.count("*").alias("n"))
    return combos.withColumn("of", F.sum("n").over(W.partitionBy(value))).agg(F.avg(F.col("n") / F.col("of")).alias("traceability"))


def feature_correlations(df: DataFrame, features: list[str]) -> DataFrame:
    """(a, b, corr, r2) of all pairs from one aggregate."""
    pairs = [(a, b) for i, a in enumerate(features) for b in features[i + 1 :]]
    row = df.agg(*[F.corr(a, b).alias(f"{a}|{b}") for a, b in pairs])
    each = F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.col(f"{a}|{b}").alias("corr")) for a, b in pairs])
    return row.select(F.explode(each).alias("p")).select("p.*").withColumn("r2", F.col("corr") * F.col("corr"))


def redundancy_r2(df: DataFrame, features: list[str], threshold: float) -> DataFrame:
    """(feature, r2, keep): R2 of each feature from all others, 1 - 1 / (C^-1)_jj of one correlation pass; keep = above the threshold."""
    import numpy as np
    from pyspark.ml.stat import Correlation

    data = assembled(df.withColumn("__zero", F.lit(0)), features, "__zero")
    c = Correlation.corr(data, "features").first()[0].toArray()
    r2 = 1 - 1 / np.diag(np.linalg.pinv(c))
    return df.sparkSession.createDataFrame([(f, float(v), bool(v > threshold)) for f, v in zip(features, r2)], "feature string, r2 double, keep boolean")
