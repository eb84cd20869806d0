"""Queries over run logs; scenarios, strategies and times are taken from the events table."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import window as win
from ..operators import rank as rk
from ..operators import runlog as rl
from ..registry import FEATURES, lines, query, r6, read
from .q_rank import _LONG, _STATS
from .scratch import cut

C = F.col
_T = "SELECT user_id % 40 AS scenario, event_type AS strategy, event_id AS seq, value AS time, round(abs(value - 20) / 100, 6) AS loss, (event_id * 7 + user_id) % 5 < 2 AS success FROM events"
_RUNS = f"t AS ({_T}), runs AS (SELECT scenario, strategy, arg_max(success, seq) AS success, bool_or(success) AS ever, max(time) AS final_time FROM t GROUP BY 1, 2)"
_FAST = _RUNS + ", fast AS (SELECT scenario, arg_min(strategy, (final_time, strategy)) AS strategy, min(final_time) AS final_time FROM runs WHERE success GROUP BY 1)"


def _trials(s, d):
    e = read(s, d, "events")
    return e.select((C("user_id") % 40).alias("scenario"), C("event_type").alias("strategy"), C("event_id").alias("seq"), C("value").alias("time"), F.round(F.abs(C("value") - 20) / 100, 6).alias("loss"), ((C("event_id") * 7 + C("user_id")) % 5 < 2).alias("success"))


def _runs(s, d):
    return rl.success_flags(_trials(s, d))


@query("success_flags", f"WITH {_RUNS} SELECT * FROM runs")
def success_flags(s, d):
    return _runs(s, d)


@query("best_so_far", f"SELECT scenario, strategy, seq, min(loss) OVER (PARTITION BY scenario, strategy ORDER BY seq) AS best FROM ({_T})")
def best_so_far(s, d):
    return rl.best_so_far(_trials(s, d)).select("scenario", "strategy", "seq", "best")


@query("best_trial", f"SELECT scenario, strategy, arg_min(seq, (loss, seq)) AS seq, min(loss) AS loss FROM ({_T}) GROUP BY 1, 2")
def best_trial(s, d):
    return rl.best_trial(_trials(s, d))


@query("pareto_axes", f"WITH b AS (SELECT scenario, strategy, min(loss) AS loss, min(time) AS time, avg(success::INT) AS rate FROM ({_T}) GROUP BY 1, 2) SELECT scenario, strategy FROM b WHERE NOT EXISTS (SELECT 1 FROM b o WHERE o.loss <= b.loss AND o.time <= b.time AND o.rate >= b.rate AND (o.loss < b.loss OR o.time < b.time OR o.rate > b.rate))")
def pareto_axes(s, d):
    from ..operators.select import pareto_front

    b = _trials(s, d).groupBy("scenario", "strategy").agg((-F.min("loss")).alias("loss"), (-F.min("time")).alias("time"), F.avg(C("success").cast("int")).alias("rate"))
    return pareto_front(cut(b), "scenario", ["loss", "time", "rate"]).select("scenario", "strategy")


@query("fastest_strategy", f"WITH {_FAST} SELECT * FROM fast")
def fastest_strategy(s, d):
    return rl.fastest_strategy(_runs(s, d))


@query("topk_fastest", f"WITH {_RUNS} SELECT scenario, strategy, place FROM (SELECT *, row_number() OVER (PARTITION BY scenario ORDER BY final_time, strategy)::INT AS place FROM runs WHERE success) WHERE place <= 3")
def topk_fastest(s, d):
    return rl.topk_fastest(_runs(s, d), 3).select("scenario", "strategy", "place")


_GROUP = "scenario % 4"


@query("coverage_by_dataset", f"WITH {_FAST} SELECT runs.scenario % 4 AS dataset, runs.strategy, round(avg(success::INT), 6) AS coverage, round(avg(coalesce((runs.strategy = fast.strategy)::INT, 0)), 6) AS fastest FROM runs LEFT JOIN fast USING (scenario) GROUP BY 1, 2")
def coverage_by_dataset(s, d):
    return rl.coverage(_runs(s, d).withColumn("dataset", C("scenario") % 4), ["dataset", "strategy"]).select("dataset", "strategy", r6(C("coverage"), "coverage"), r6(C("fastest"), "fastest"))


@query("coverage_by_model", f"WITH {_RUNS} SELECT strategy, round(avg(success::INT) FILTER (WHERE scenario % 3 = 0), 6) AS m0, round(avg(success::INT) FILTER (WHERE scenario % 3 = 1), 6) AS m1, round(avg(success::INT) FILTER (WHERE scenario % 3 = 2), 6) AS m2 FROM runs GROUP BY 1")
def coverage_by_model(s, d):
    x = _runs(s, d).withColumn("model", F.concat(F.lit("m"), (C("scenario") % 3).cast("string")))
    out = x.groupBy("strategy").pivot("model", ["m0", "m1", "m2"]).agg(F.avg(C("success").cast("int")))
    return out.select("strategy", *[r6(C(m), m) for m in ("m0", "m1", "m2")])


@query("runtime_with_penalty", f"WITH {_RUNS} SELECT scenario, strategy, round(CASE WHEN success THEN final_time + 1.5 ELSE 100 END, 6) AS time FROM runs")
def runtime_with_penalty(s, d):
    return _runs(s, d).select("scenario", "strategy", r6(rl.runtime_with_penalty(C("success"), C("final_time"), F.lit(100.0), F.lit(1.5)), "time"))


@query("chooser_report", f"WITH {_FAST}, ch AS (SELECT scenario, min(strategy) AS strategy FROM runs GROUP BY 1) SELECT round(avg(CASE WHEN r.success THEN r.final_time END), 6) AS avg_runtime, round(avg(f.final_time), 6) AS optimum_runtime, round(avg(r.success::INT), 6) AS recall FROM ch JOIN runs r USING (scenario, strategy) JOIN fast f ON f.scenario = ch.scenario")
def chooser_report(s, d):
    runs = _runs(s, d)
    chosen = runs.groupBy("scenario").agg(F.min("strategy").alias("strategy"))
    return rl.chooser_report(runs, chosen).select(r6(C("avg_runtime"), "avg_runtime"), r6(C("optimum_runtime"), "optimum_runtime"), r6(C("recall"), "recall"))


_STEP = "(SELECT strategy, count(*) AS n FROM {t} GROUP BY 1 ORDER BY n DESC, strategy LIMIT 1)"


@query("greedy_portfolio", f"WITH {_RUNS}, l1 AS (SELECT scenario, strategy FROM runs WHERE success), g1 AS {_STEP.format(t='l1')}, l2 AS (SELECT * FROM l1 WHERE scenario NOT IN (SELECT scenario FROM l1 JOIN g1 USING (strategy))), g2 AS {_STEP.format(t='l2')}, l3 AS (SELECT * FROM l2 WHERE scenario NOT IN (SELECT scenario FROM l2 JOIN g2 USING (strategy))), g3 AS {_STEP.format(t='l3')} SELECT 1::INT AS step, strategy, n AS covered FROM g1 UNION ALL SELECT 2, strategy, n FROM g2 UNION ALL SELECT 3, strategy, n FROM g3")
def greedy_portfolio(s, d):
    return rl.greedy_portfolio(cut(_runs(s, d)), 3)


@query("portfolio_outcome", f"WITH {_RUNS}, p AS (SELECT scenario, strategy FROM (SELECT scenario, strategy, row_number() OVER (PARTITION BY scenario ORDER BY strategy) AS k FROM runs) WHERE k <= 2) SELECT scenario, bool_or(success) AS success, min(final_time) FILTER (WHERE success) AS time FROM runs JOIN p USING (scenario, strategy) GROUP BY 1")
def portfolio_outcome(s, d):
    from pyspark.sql import Window as W

    runs = _runs(s, d)
    picks = runs.withColumn("k", F.row_number().over(W.partitionBy("scenario").orderBy("strategy"))).where("k <= 2").select("scenario", "strategy")
    return rl.portfolio_outcome(runs, picks)


@query("scenario_features", f"SELECT event_id, least(greatest(value / 50, 0), 1)::DOUBLE AS accuracy, round(ln(1 + user_id), 6) AS log_time, round(least(greatest(value / 50, 0), 1) - 0.4, 6) AS d_accuracy, 1.0::DOUBLE AS safety FROM events")
def scenario_features(s, d):
    x = rl.scenario_features(C("value") / 50, F.lit(0.9), F.lit(float("inf")), F.lit(0.5), C("user_id"), F.lit(0.4), F.lit(0.8))
    return read(s, d, "events").select("event_id", x["accuracy"].alias("accuracy"), r6(x["log_time"], "log_time"), r6(x["d_accuracy"], "d_accuracy"), x["safety"].alias("safety"))


_CLAMP = "least(greatest({}, 0), 1)"


@query("scenario_vector", f"""SELECT event_id, round(accuracy, 6) AS accuracy, 0.9::DOUBLE AS fairness, 1.0::DOUBLE AS safety, round(complexity, 6) AS complexity, round(privacy, 6) AS privacy, round(ln(1 + user_id), 6) AS log_time,
    round(accuracy - 0.4, 6) AS d_accuracy, round(0.9 - 0.8, 6)::DOUBLE AS d_fairness, round(1 - 0.7, 6)::DOUBLE AS d_safety, round(complexity - 1, 6) AS d_complexity, round(ln(1 + user_id) - ln(1 + 2.5::DOUBLE), 6) AS d_time,
    round(ln(1 + n), 6) AS log_rows, round(ln(1 + 6::DOUBLE), 6) AS log_columns, 0.25::DOUBLE AS label_share, 0.5::DOUBLE AS group_share, (event_type = 'click')::INT AS is_nb, (event_type = 'view')::INT AS is_tree, (event_type = 'error')::INT AS is_logistic
    FROM (SELECT *, {_CLAMP.format('value / 50')}::DOUBLE AS accuracy, {_CLAMP.format('(event_id % 13) / 10.0')}::DOUBLE AS complexity, {_CLAMP.format('value / 20')}::DOUBLE AS privacy, (SELECT count(*) FROM events) AS n FROM events)""")
def scenario_vector(s, d):
    """All eighteen values of a scenario."""
    df = read(s, d, "events")
    model = F.when(C("event_type") == "click", "nb").when(C("event_type") == "view", "tree").when(C("event_type") == "error", "logistic")
    x = rl.scenario_features(C("value") / 50, F.lit(0.9), F.lit(float("inf")), C("event_id") % 13 / 10.0, C("user_id"), F.lit(0.4), F.lit(0.8), C("value") / 20, F.lit(0.7), F.lit(2.5), F.lit(df.count()), F.lit(len(df.columns)), F.lit(0.25), F.lit(0.5), model)
    return df.select("event_id", *[x[c].alias(c) if c.startswith("is_") else r6(x[c].cast("double"), c) for c in rl.SCENARIO])


@query("random_scenarios")
def random_scenarios(s, d):
    return rl.random_scenarios(read(s, d, "events").select("event_id"), "event_id")


@query("choice_contributions")
def choice_contributions(s, d):
    """For each scenario's chosen strategy, what each feature adds to its probability."""
    data, names = _meta(s, d)
    return rl.contributions(rl.train_strategy_models(data, _MF, names), data, _MF)


@query("portfolio_of_predictions")
def portfolio_of_predictions(s, d):
    """Success and time of any of the three strategies that the models find most probable."""
    from pyspark.sql import Window as W

    data, names = _meta(s, d)
    planned = rl.plan(rl.train_strategy_models(data, _MF, names), data, _MF)
    place = F.row_number().over(W.partitionBy("scenario").orderBy(F.desc("probability"), "strategy"))
    return rl.portfolio_outcome(_runs(s, d), planned.withColumn("k", place).where("k <= 3").select("scenario", "strategy"))


@query("landmark")
def landmark(s, d):
    """Five-fold scores of naive Bayes on a sample of 100 rows: accuracy, fairness, safety, and seconds taken."""
    import time

    from ..operators import evaluate as ev
    from ..operators import sample as sm

    began = time.monotonic()
    small = cut(sm.kfold(sm.fixed_sample(lines(s, d), "row_id", "label", 100), "row_id", 5, "label"), "landmark")
    out = None
    for k in range(5):
        train, test = small.where(C("fold") != k), small.where(C("fold") == k)
        model = ev.fit_nb(train, FEATURES, "label")
        scale = train.agg(*[F.stddev_pop(f).alias(f) for f in FEATURES]).first().asDict()
        safety = ev.robustness(test, model, FEATURES, "label", 15, scale).select("safety")
        one = ev.metrics(ev.confusion(test, model, FEATURES, "label", "grp", [15]), []).join(F.broadcast(safety))
        out = one if out is None else out.unionByName(one)
    row = out.agg(F.avg("accuracy").alias("accuracy"), F.avg("fairness").alias("fairness"), F.avg("safety").alias("safety")).first()
    return s.createDataFrame([(row.accuracy, row.fairness, row.safety, time.monotonic() - began)], "accuracy double, fairness double, safety double, seconds double")


_MF = ["x1", "x2"]


def _meta(s, d):
    """A row per scenario: two features and a success flag per strategy."""
    t = _runs(s, d)
    names = sorted(r[0] for r in t.select("strategy").distinct().collect())
    wide = t.groupBy("scenario").pivot("strategy", names).agg(F.max(C("success").cast("int"))).na.fill(0)
    x = _trials(s, d).groupBy("scenario").agg(F.avg("time").alias("x1"), F.stddev_pop("time").alias("x2"))
    return cut(wide.join(x, "scenario"), "meta"), names


@query("train_strategy_models")
def train_strategy_models(s, d):
    """Accuracy of each strategy's model over three folds that share no scenario group."""
    from ..operators.sample import group_kfold

    data, names = _meta(s, d)
    data = cut(group_kfold(data.withColumn("g", C("scenario") % 10), "g", 3), "folds")
    out = None
    for k in range(3):
        models = rl.train_strategy_models(data.where(C("fold") != k), _MF, names)
        test = data.where(C("fold") == k)
        p = rl.plan(models, test, _MF)
        truth = test.select("scenario", F.explode(F.array(*[F.struct(F.lit(n).alias("strategy"), C(n).alias("y")) for n in names])).alias("t")).select("scenario", "t.*")
        one = p.join(truth, ["scenario", "strategy"]).select("strategy", ((C("probability") > 0.5).cast("int") == C("y")).cast("int").alias("hit"))
        out = one if out is None else out.unionByName(one)
    return out.groupBy("strategy").agg(F.avg("hit").alias("accuracy"))


@query("plan_strategies")
def plan_strategies(s, d):
    data, names = _meta(s, d)
    return rl.plan(rl.train_strategy_models(data, _MF, names), data, _MF)


@query("choose_strategy")
def choose_strategy(s, d):
    data, names = _meta(s, d)
    return rl.choose_strategy(rl.plan(rl.train_strategy_models(data, _MF, names), data, _MF))


@query("what_if_relax")
def what_if_relax(s, d):
    """The choice when the first feature is lowered by 0 to 4 points."""
    data, names = _meta(s, d)
    models = rl.train_strategy_models(data, _MF, names)
    relaxed = data.select("scenario", "x2", "x1", F.explode(F.array(*[F.lit(i) for i in range(5)])).alias("points")).withColumn("x1", C("x1") - C("points")).withColumn("case", F.concat_ws("-", C("scenario").cast("string"), C("points").cast("string")))
    return rl.choose_strategy(rl.plan(models, relaxed, _MF, "case"), "case")


@query("explain_choice")
def explain_choice(s, d):
    data, names = _meta(s, d)
    rows = [(n, f, float(v)) for n, m in rl.train_strategy_models(data, _MF, names).items() for f, v in zip(_MF, m.featureImportances.toArray())]
    return s.createDataFrame(rows, "strategy string, feature string, importance double")


@query("scenario_grid", "SELECT a.x / 10.0::DOUBLE AS accuracy, b.x / 10.0::DOUBLE AS fairness, (SELECT count(*) FROM events WHERE value / 50 >= a.x / 10.0::DOUBLE) AS met FROM (SELECT unnest([5, 6, 7, 8, 9]) AS x) a, (SELECT unnest([8, 9, 10]) AS x) b")
def scenario_grid(s, d):
    grid = rl.scenario_grid(s, {"accuracy": [0.5, 0.6, 0.7, 0.8, 0.9], "fairness": [0.8, 0.9, 1.0]})
    met = read(s, d, "events").select((C("value") / 50).alias("v"))
    x = met.join(F.broadcast(grid), C("v") >= C("accuracy"), "right")
    return x.groupBy("accuracy", "fairness").agg(F.count("v").alias("met"))


@query("metric_correlation", f"SELECT round(corr(time, loss), 6) AS time_loss, round(corr(time, success::INT), 6) AS time_success, round(corr(loss, seq), 6) AS loss_seq FROM ({_T})")
def metric_correlation(s, d):
    return _trials(s, d).agg(r6(F.corr("time", "loss"), "time_loss"), r6(F.corr("time", C("success").cast("int")), "time_success"), r6(F.corr("loss", "seq"), "loss_seq"))


@query("ranking_correlation", _STATS + f", a AS (SELECT feature, rank() OVER (ORDER BY x) AS r FROM (SELECT feature, sum(pow(s - sn * n / nn, 2) / (sn * n / nn)) AS x FROM t GROUP BY 1)), b AS (SELECT feature, rank() OVER (ORDER BY x) AS r FROM (SELECT feature, var_pop(value) AS x FROM ({_LONG}) GROUP BY 1)) SELECT round(corr(a.r, b.r), 6) AS spearman FROM a JOIN b USING (feature)")
def ranking_correlation(s, d):
    df = lines(s, d)
    return rl.ranking_correlation(rk.rank_chi2(df, FEATURES, "label"), rk.rank_variance(df, FEATURES)).select(r6(C("spearman"), "spearman"))


@query("satisfied_values", f"SELECT strategy, round(quantile_cont(time, 0.25), 6) AS q25, round(quantile_cont(time, 0.5), 6) AS q50, round(quantile_cont(time, 0.75), 6) AS q75, count(*) AS n FROM ({_T}) WHERE success GROUP BY 1")
def satisfied_values(s, d):
    good = _trials(s, d).where("success")
    q = win.group_quantiles(good, "strategy", "time", {"q25": 0.25, "q50": 0.5, "q75": 0.75})
    return good.groupBy("strategy").agg(F.count("*").alias("n")).join(q, "strategy", "left").select("strategy", *[r6(C(c), c) for c in ("q25", "q50", "q75")], "n")


@query("pivot_heatmap", f"WITH {_FAST} SELECT scenario % 5 AS accuracy, " + ", ".join(f"min(strategy) FILTER (WHERE scenario % 3 = {i}) AS f{i}" for i in range(3)) + " FROM fast GROUP BY 1")
def pivot_heatmap(s, d):
    x = rl.fastest_strategy(_runs(s, d)).select((C("scenario") % 5).alias("accuracy"), F.concat(F.lit("f"), (C("scenario") % 3).cast("string")).alias("f"), "strategy")
    return x.groupBy("accuracy").pivot("f", ["f0", "f1", "f2"]).agg(F.min("strategy"))
