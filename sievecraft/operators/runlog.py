"""Run-log analytics over trials (scenario, strategy, seq, time, loss, success) and a meta-model that picks strategies."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

RUN = ["scenario", "strategy"]


def success_flags(trials: DataFrame) -> DataFrame:
    """Per run: success of the last record, whether any succeeded, and its final time."""
    return trials.groupBy(*RUN).agg(F.max_by("success", "seq").alias("success"), F.max("success").alias("ever"), F.max("time").alias("final_time"))


def best_so_far(trials: DataFrame) -> DataFrame:
    """Running minimum of the loss in each run."""
    w = W.partitionBy(*RUN).orderBy("seq").rowsBetween(W.unboundedPreceding, 0)
    return trials.withColumn("best", F.min("loss").over(w))


def best_trial(trials: DataFrame) -> DataFrame:
    return trials.groupBy(*RUN).agg(F.min_by("seq", F.struct("loss", "seq")).alias("seq"), F.min("loss").alias("loss"))


def fastest_strategy(runs: DataFrame) -> DataFrame:
    """Per scenario the successful run of least time; ties by name."""
    return runs.where("success").groupBy("scenario").agg(F.min_by("strategy", F.struct("final_time", "strategy")).alias("strategy"), F.min("final_time").alias("final_time"))


def topk_fastest(runs: DataFrame, k: int) -> DataFrame:
    w = W.partitionBy("scenario").orderBy("final_time", "strategy")
    return runs.where("success").withColumn("place", F.row_number().over(w)).where(F.col("place") <= k)


def coverage(runs: DataFrame, by: list[str]) -> DataFrame:
    """Success share, and share of scenarios in which the strategy is the fastest."""
    fast = fastest_strategy(runs).select("scenario", F.col("strategy").alias("fastest"))
    return runs.join(fast, "scenario", "left").groupBy(*by).agg(F.avg(F.col("success").cast("int")).alias("coverage"), F.avg(F.coalesce((F.col("strategy") == F.col("fastest")).cast("int"), F.lit(0))).alias("fastest"))


def runtime_with_penalty(success: Column, time: Column, limit: Column, landmark: Column) -> Column:
    """Success: time and landmark time; else the whole time limit."""
    return F.when(success, time + landmark).otherwise(limit)


def greedy_portfolio(runs: DataFrame, size: int) -> DataFrame:
    """(step, strategy, covered): each step takes the strategy that solves most unsolved scenarios (of those any solves)."""
    left, rows = runs.where("success").select("scenario", "strategy").distinct(), []
    for step in range(1, size + 1):
        best = left.groupBy("strategy").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "strategy").first()
        if best is None:
            break
        rows.append((step, best.strategy, best.n))
        left = left.join(left.where(F.col("strategy") == best.strategy).select("scenario"), "scenario", "left_anti")
    return runs.sparkSession.createDataFrame(rows, "step int, strategy string, covered long")


def portfolio_outcome(runs: DataFrame, picks: DataFrame) -> DataFrame:
    """Per scenario: whether any of its picked strategies succeeds, and the least time of those."""
    x = runs.join(picks, ["scenario", "strategy"])
    return x.groupBy("scenario").agg(F.max("success").alias("success"), F.min(F.when(F.col("success"), F.col("final_time"))).alias("time"))


def chooser_report(runs: DataFrame, chosen: DataFrame) -> DataFrame:
    """One row: average time of the choice and of the best, and how often a solvable scenario is solved."""
    fast = fastest_strategy(runs).select("scenario", F.col("final_time").alias("optimum"))
    x = chosen.join(runs, RUN, "left").join(fast, "scenario")
    return x.agg(F.avg(F.when(F.col("success"), F.col("final_time"))).alias("avg_runtime"), F.avg("optimum").alias("optimum_runtime"), F.avg(F.coalesce(F.col("success"), F.lit(False)).cast("int")).alias("recall"))


def ranking_correlation(a: DataFrame, b: DataFrame) -> DataFrame:
    """One row: Spearman correlation of two rankings (feature, score). The windows run over features."""
    rank = lambda d, out: d.withColumn(out, F.rank().over(W.orderBy("score")) + (F.count("*").over(W.partitionBy("score")) - 1) / 2.0).select("feature", out)
    return rank(a, "ra").join(rank(b, "rb"), "feature").agg(F.corr("ra", "rb").alias("spearman"))


def scenario_grid(spark, axes: dict[str, list[float]]) -> DataFrame:
    """Every combination of threshold values."""
    out = None
    for name, values in axes.items():
        one = spark.createDataFrame([(float(v),) for v in values], f"{name} double")
        out = one if out is None else out.join(F.broadcast(one))
    return out.withColumn("scenario", F.monotonically_increasing_id())


#: Values of a scenario that the strategy models are trained on, in their order.
SCENARIO = ["accuracy", "fairness", "safety", "complexity", "privacy", "log_time", "d_accuracy", "d_fairness", "d_safety", "d_complexity", "d_time", "log_rows", "log_columns", "label_share", "group_share", "is_nb", "is_tree", "is_logistic"]


def scenario_features(accuracy: Column, fairness: Column, safety: Column, complexity: Column, time: Column, land_accuracy: Column, land_fairness: Column, privacy: Column | None = None, land_safety: Column | None = None, land_time: Column | None = None, rows: Column | None = None, columns: Column | None = None, label_share: Column | None = None, group_share: Column | None = None, model: Column | None = None) -> dict[str, Column]:
    """The values of ``SCENARIO``: thresholds clamped to 0..1 (infinity: 1), their distances to a landmark, logs of sizes, model flags.

    An unbounded privacy budget counts as 1, as any budget above it; what isn't given is 0.
    """
    clamp = lambda c: F.least(F.greatest(c, F.lit(0.0)), F.lit(1.0))
    zero = F.lit(0.0)
    a, f, s, k = clamp(accuracy), clamp(fairness), clamp(safety), clamp(complexity)
    size = lambda c: zero if c is None else F.ln(1 + c)
    is_model = lambda name: F.lit(0) if model is None else F.coalesce((model == name).cast("int"), F.lit(0))
    return {
        "accuracy": a,
        "fairness": f,
        "safety": s,
        "complexity": k,
        "privacy": zero if privacy is None else clamp(privacy),
        "log_time": F.ln(1 + time),
        "d_accuracy": a - land_accuracy,
        "d_fairness": f - land_fairness,
        "d_safety": zero if land_safety is None else s - land_safety,
        # the landmark uses all features
        "d_complexity": k - 1,
        "d_time": zero if land_time is None else F.ln(1 + time) - F.ln(1 + land_time),
        "log_rows": size(rows),
        "log_columns": size(columns),
        "label_share": zero if label_share is None else label_share,
        "group_share": zero if group_share is None else group_share,
        "is_nb": is_model("nb"),
        "is_tree": is_model("tree"),
        "is_logistic": is_model("logistic"),
    }


def random_scenarios(ids: DataFrame, id_col: str, seed: int = 7) -> DataFrame:
    """``ids`` with a random constraint set each, drawn by hash: accuracy 0.5 to 1, fairness and safety 0.8 to 1, share of features, privacy log-normal, time limit."""
    u = lambda k: F.pmod(F.xxhash64(id_col, F.lit(seed), F.lit(k)), F.lit(1_000_000)) / F.lit(1e6)
    normal = F.sqrt(-2 * F.ln(F.greatest(u(4), F.lit(1e-6)))) * F.cos(F.lit(6.283185307179586) * u(5))
    return ids.select(id_col, (0.5 + u(0) / 2).alias("accuracy"), (0.8 + u(1) / 5).alias("fairness"), (0.8 + u(2) / 5).alias("safety"), F.greatest(u(3), F.lit(0.01)).alias("complexity"), F.exp(normal).alias("privacy"), (10 + 10790 * u(6)).alias("time"))


def contributions(models: dict, scenarios: DataFrame, features: list[str], id_col: str = "scenario") -> DataFrame:
    """(id, strategy, feature, contribution) of each scenario's choice: how much its probability falls when the feature is at its mean instead."""
    chosen = choose_strategy(plan(models, scenarios, features, id_col), id_col)
    means = scenarios.agg(*[F.avg(f).alias(f) for f in features]).first()
    out = None
    for f in features:
        moved = plan(models, scenarios.withColumn(f, F.lit(float(means[f]))), features, id_col).withColumnRenamed("probability", "without")
        one = chosen.join(moved, [id_col, "strategy"]).select(id_col, "strategy", F.lit(f).alias("feature"), (F.col("probability") - F.col("without")).alias("contribution"))
        out = one if out is None else out.unionByName(one)
    return out


def train_strategy_models(data: DataFrame, features: list[str], strategies: list[str], seed: int = 7) -> dict:
    """A forest per strategy on its success column."""
    from pyspark.ml.classification import RandomForestClassifier

    from .rank import assembled

    models = {}
    for name in strategies:
        d = assembled(data.withColumn("__s", F.col(name).cast("int")), features, "__s")
        models[name] = RandomForestClassifier(labelCol="__y", numTrees=8, maxDepth=4, seed=seed).fit(d)
    return models


def plan(models: dict, scenarios: DataFrame, features: list[str], id_col: str = "scenario") -> DataFrame:
    """(scenario, strategy, probability) for every model."""
    from pyspark.ml.functions import vector_to_array

    from .rank import assembled

    data, out = assembled(scenarios.withColumn("__s", F.lit(0)), features, "__s"), None
    for name, m in models.items():
        p = F.element_at(vector_to_array("probability"), -1) if m.numClasses > 1 else F.lit(0.0)
        one = m.transform(data).select(id_col, F.lit(name).alias("strategy"), p.alias("probability"))
        out = one if out is None else out.unionByName(one)
    return out


def choose_strategy(planned: DataFrame, id_col: str = "scenario") -> DataFrame:
    return planned.groupBy(id_col).agg(F.max_by("strategy", F.struct("probability", "strategy")).alias("strategy"), F.max("probability").alias("probability"))
