"""Queries over models, metrics and constraints."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import numeric as num
from ..operators import evaluate as ev
from ..operators import private_trees as pt
from ..operators import rank as rk
from ..operators import sample as sm
from ..registry import FEATURES, lines, query, r6, read

C = F.col


def parts(s, d):
    """Train, validation and test part of the labelled table by row id."""
    df = lines(s, d)
    k = C("row_id") % 5
    return df.where(k < 3), df.where(k == 3), df.where(k == 4)


MASKS = [1, 2, 5, 10, 15]
LIMITS = ev.Constraints(accuracy=0.66, fairness=0.9, complexity=0.5)
_NB = "t AS (SELECT * FROM {lines}), tr AS (SELECT * FROM t WHERE row_id % 5 < 3), g AS (SELECT 1e-9 * greatest(" + ", ".join(f"sum({f} * {f}) / count(*) - pow(sum({f}) / count(*), 2)" for f in FEATURES) + ") AS s FROM tr), st AS (SELECT label AS c, count(*) AS n, " + ", ".join(f"avg({f}) AS m_{f}, sum({f} * {f}) / count(*) - pow(sum({f}) / count(*), 2) + (SELECT s FROM g) AS v_{f}" for f in FEATURES) + " FROM tr GROUP BY 1)"
_LL = " + ".join(f"((mask >> {i}) % 2) * -0.5 * (ln(2 * pi() * v_{f}) + pow({f} - m_{f}, 2) / v_{f})" for i, f in enumerate(FEATURES))
_PRED = f"WITH {_NB}, mk AS (SELECT unnest({MASKS}) AS mask), pr AS (SELECT mask, t.rowid AS rid, any_value(label) AS label, any_value(grp) AS grp, arg_max(c, ln(n / (SELECT sum(n) FROM st)) + {_LL}) AS pred FROM (SELECT *, row_number() OVER () AS rowid FROM t WHERE row_id % 5 = 3) t, st, mk GROUP BY 1, 2)"
_MET = _PRED + ", m AS (SELECT mask, bit_count(mask) AS size, avg((label = pred)::INT) AS accuracy, coalesce(2 * sum(label * pred) / nullif(sum(label) + sum(pred), 0), 0) AS f1, 1 - abs(sum(label * pred * (1 - grp)) / sum(1 - grp) - sum(label * pred * grp) / sum(grp)) AS fairness FROM pr GROUP BY 1)"
_LOSS = "pow(greatest(0, 0.66 - accuracy), 2) + pow(greatest(0, 0.9 - fairness), 2) + pow(greatest(0, size / 4.0 - 0.5), 2)"


@query("evaluate_masks", _MET + f" SELECT mask::BIGINT AS mask, size::INT AS size, round(accuracy, 6) AS accuracy, round(f1, 6) AS f1, round(fairness, 6) AS fairness, round({_LOSS}, 6) AS loss, accuracy >= 0.66 AND fairness >= 0.9 AND size <= 2 AS satisfied FROM m")
def evaluate_masks(s, d):
    train, valid, _ = parts(s, d)
    out = ev.evaluate_masks(train, valid, FEATURES, "label", "grp", MASKS, LIMITS)
    return out.select("mask", "size", *[r6(C(c), c) for c in ("accuracy", "f1", "fairness", "loss")], "satisfied")


_LOG = "SELECT event_id, (user_id % 100) / 100.0::DOUBLE AS acc, (event_id % 50) / 50.0::DOUBLE AS fair, (event_id % 10) / 10.0::DOUBLE AS share FROM events"


def _log(s, d):
    return read(s, d, "events").select("event_id", (C("user_id") % 100 / 100.0).alias("acc"), (C("event_id") % 50 / 50.0).alias("fair"), (C("event_id") % 10 / 10.0).alias("share"))


@query("constraint_loss", f"WITH l AS ({_LOG}) SELECT event_id, round(CASE WHEN share <= 0 THEN 4 ELSE pow(greatest(0, 0.8 - acc), 2) + pow(greatest(0, 0.9 - fair), 2) + pow(greatest(0, share - 0.5), 2) END, 6) AS loss, round(CASE WHEN share <= 0 THEN 4 WHEN pow(greatest(0, 0.9 - fair), 2) > 0 THEN pow(greatest(0, 0.9 - fair), 2) ELSE -acc END, 6) AS utility FROM l")
def constraint_loss(s, d):
    a = ev.constraint_loss(ev.Constraints(0.8, 0.9, None, 0.5), C("acc"), C("fair"), C("share"))
    b = ev.constraint_loss(ev.Constraints(float("inf"), 0.9), C("acc"), C("fair"), C("share"))
    return _log(s, d).select("event_id", r6(a, "loss"), r6(b, "utility"))


@query("constraints_satisfied", f"WITH l AS ({_LOG}) SELECT event_id, acc >= 0.5 AND fair >= 0.5 AND share <= 0.5 AS ok, false AS never FROM l")
def constraints_satisfied(s, d):
    ok = ev.satisfied(ev.Constraints(0.5, 0.5, None, 0.5), C("acc"), C("fair"), C("share"))
    never = ev.satisfied(ev.Constraints(float("inf"), None), C("acc"), C("fair"), C("share"))
    return _log(s, d).select("event_id", ok.alias("ok"), never.alias("never"))


@query("distance_to_constraints", f"WITH l AS ({_LOG}) SELECT event_id % 7 AS scenario, round(min(CASE WHEN share <= 0 THEN 4 ELSE pow(greatest(0, 0.9 - acc), 2) + pow(greatest(0, 0.95 - fair), 2) END), 6) AS distance FROM l GROUP BY 1")
def distance_to_constraints(s, d):
    loss = ev.constraint_loss(ev.Constraints(0.9, 0.95), C("acc"), C("fair"), C("share"))
    return _log(s, d).groupBy((C("event_id") % 7).alias("scenario")).agg(r6(F.min(loss), "distance"))


_CM = "SELECT label, (discount > 0.05)::INT AS pred, grp FROM {lines}"


def _cm(s, d):
    return lines(s, d).select("label", (C("discount") > 0.05).cast("int").alias("pred"), "grp").groupBy("label", "pred", "grp").agg(F.count("*").alias("n"))


@query("fairness", f"SELECT round(1 - abs(sum(label * pred * (1 - grp)) / sum(1 - grp) - sum(label * pred * grp) / sum(grp)), 6) AS fairness FROM ({_CM})")
def fairness(s, d):
    return ev.metrics(_cm(s, d), []).select(r6(C("fairness"), "fairness"))


@query("f1_accuracy", f"SELECT round(avg((label = pred)::INT), 6) AS accuracy, round(2 * sum(label * pred) / (sum(label) + sum(pred)), 6) AS f1, count(*) AS rows FROM ({_CM})")
def f1_accuracy(s, d):
    return ev.metrics(_cm(s, d), []).select(r6(C("accuracy"), "accuracy"), r6(C("f1"), "f1"), "rows")


#: Three classes told by the number of the line, with a score for each.
_MC = "SELECT l_linenumber % 3 AS y, CASE WHEN l_quantity > 30 THEN 0 WHEN l_quantity > 15 THEN 1 ELSE 2 END AS pred, l_quantity / 50 AS s0, l_discount * 10 AS s1, l_tax * 12 AS s2 FROM lineitem"


def _mc(s, d):
    q = C("l_quantity")
    return read(s, d, "lineitem").select((C("l_linenumber") % 3).alias("y"), F.when(q > 30, 0).when(q > 15, 1).otherwise(2).alias("pred"), (q / 50).alias("s0"), (C("l_discount") * 10).alias("s1"), (C("l_tax") * 12).alias("s2"))


@query("micro_f1", f"WITH t AS ({_MC}), c AS (SELECT k, sum((y = k AND pred = k)::INT) AS tp, sum((y <> k AND pred = k)::INT) AS fp, sum((y = k AND pred <> k)::INT) AS fn FROM t, (SELECT unnest([0, 1, 2]) AS k) GROUP BY 1) SELECT round(2 * sum(tp) / (2 * sum(tp) + sum(fp) + sum(fn)), 6) AS micro_f1 FROM c")
def micro_f1(s, d):
    counts = _mc(s, d).groupBy(C("y").alias("label"), "pred").agg(F.count("*").alias("n"))
    return ev.micro_f1(counts).select(r6(C("micro_f1"), "micro_f1"))


@query("micro_auc", f"WITH t AS ({_MC}), p AS (SELECT s0 AS score, (y = 0)::INT AS hit FROM t UNION ALL SELECT s1, (y = 1)::INT FROM t UNION ALL SELECT s2, (y = 2)::INT FROM t), r AS (SELECT hit, rank() OVER (ORDER BY score) + (count(*) OVER (PARTITION BY score) - 1) / 2.0 AS r FROM p) SELECT round((sum(r * hit) - sum(hit) * (sum(hit) + 1) / 2.0) / (sum(hit) * (count(*) - sum(hit))), 6) AS auc FROM r")
def micro_auc(s, d):
    return ev.micro_auc(_mc(s, d), {0: "s0", 1: "s1", 2: "s2"}, "y").select(r6(C("auc"), "auc"))


@query("roc_auc", "WITH r AS (SELECT label, rank() OVER (ORDER BY discount) + (count(*) OVER (PARTITION BY discount) - 1) / 2.0 AS r FROM {lines}) SELECT round((sum(r * label) - sum(label) * (sum(label) + 1) / 2.0) / (sum(label) * (count(*) - sum(label))), 6) AS auc FROM r")
def roc_auc(s, d):
    return ev.roc_auc(lines(s, d), "discount", "label").select(r6(C("auc"), "auc"))


@query("r2_rss", "SELECT round(sum(pow(price - quantity * 1500, 2)) / 1e9, 4) AS rss, round(1 - sum(pow(price - quantity * 1500, 2)) / (var_pop(price) * count(*)), 6) AS r2 FROM {lines}")
def r2_rss(s, d):
    e = C("price") - C("quantity") * 1500
    a = lines(s, d).agg(F.sum(e * e).alias("rss"), (F.var_pop("price") * F.count("*")).alias("tss"))
    return a.select(F.round(C("rss") / 1e9, 4).alias("rss"), r6(1 - C("rss") / C("tss"), "r2"))


@query("number_features", "SELECT m AS mask, bit_count(m)::INT AS size, bit_count(m) / 4.0 AS share, (SELECT count(*) FROM lineitem) AS n FROM (SELECT unnest(range(1, 16)) AS m)")
def number_features(s, d):
    from ..operators.select import all_masks

    n = lines(s, d).agg(F.count("*").alias("n"))
    return all_masks(lines(s, d), 4, 4).withColumn("share", C("size") / 4.0).join(F.broadcast(n))


@query("robustness")
def robustness(s, d):
    train, valid, _ = parts(s, d)
    scale = train.agg(*[F.stddev_pop(f).alias(f) for f in FEATURES]).first().asDict()
    return ev.robustness(valid, ev.fit_nb(train, FEATURES, "label"), FEATURES, "label", 15, scale)


@query("robustness_boundary")
def robustness_boundary(s, d):
    """Accuracy before and after an attack that walks along the decision boundary, and how far it goes."""
    from ..operators import attack as at
    from ..operators import mask_models as mm

    train, valid, _ = parts(s, d)
    fitted = mm.LogisticMasks((1.0,)).prepare(train, FEATURES, "label")
    coefs, mean, width = fitted.fit([15])[15][0], fitted.design.mean, fitted.design.scale
    predict = lambda x: ((x - mean) / width @ coefs[:-1] + coefs[-1] > 0).astype(int)
    return at.boundary_attack(valid, FEATURES, "label", "row_id", predict, fitted.labels, dict(zip(FEATURES, width.tolist())))


_SUM_LL = " + ".join(f"-0.5 * (ln(2 * pi() * v_{f}) + pow({f} - m_{f}, 2) / v_{f})" for f in FEATURES)


@query("unit_test_score", f"WITH {_NB}, one AS (SELECT * FROM t WHERE row_id % 5 = 3 ORDER BY row_id, price LIMIT 1), z AS (SELECT row_id, label, c, ln(n / (SELECT sum(n) FROM st)) + {_SUM_LL} AS z FROM one, st) SELECT row_id, round(sum(CASE WHEN c = label THEN exp(z - (SELECT max(z) FROM z)) ELSE 0 END) / sum(exp(z - (SELECT max(z) FROM z))), 6) AS p FROM z GROUP BY 1")
def unit_test_score(s, d):
    """The predicted probability of one record's own class."""
    import numpy as np

    train, valid, _ = parts(s, d)
    model = ev.fit_nb(train, FEATURES, "label")
    row = valid.orderBy("row_id", "price").first()
    z = model.log_likelihoods(np.array([[row[f] for f in FEATURES]], dtype=float)).sum(2)[0] + np.log(model.prior)
    p = np.exp(z - z.max()) / np.exp(z - z.max()).sum()
    return s.createDataFrame([(row.row_id, round(float(p[model.labels.index(row.label)]), 6))], "row_id long, p double")


def _fit_score(s, d, estimator, **cols):
    train, valid, _ = parts(s, d)
    model = estimator.fit(rk.assembled(train, FEATURES, "label"))
    pred = model.transform(rk.assembled(valid, FEATURES, "label")).select("label", C("prediction").cast("int").alias("pred"), "grp")
    return ev.metrics(pred.groupBy("label", "pred", "grp").agg(F.count("*").alias("n")), [])


@query("transfer_to_model")
def transfer_to_model(s, d):
    from pyspark.ml.classification import DecisionTreeClassifier

    return _fit_score(s, d, DecisionTreeClassifier(labelCol="__y", maxDepth=4, seed=7))


@query("model_classes")
def model_classes(s, d):
    """Accuracy, F1 and fairness of each model class on the validation part."""
    from pyspark.ml import classification as mc

    models = {
        "logistic": mc.LogisticRegression(labelCol="__y", maxIter=10, regParam=0.01),
        "naive_bayes": mc.NaiveBayes(labelCol="__y", modelType="gaussian"),
        "tree": mc.DecisionTreeClassifier(labelCol="__y", maxDepth=5, seed=7),
        "forest": mc.RandomForestClassifier(labelCol="__y", numTrees=5, maxDepth=4, seed=7),
        "boosting": mc.GBTClassifier(labelCol="__y", maxIter=3, maxDepth=3, seed=7),
        "linear_svc": mc.LinearSVC(labelCol="__y", maxIter=5),
        "multinomial_nb": mc.NaiveBayes(labelCol="__y"),
    }
    train, valid, _ = parts(s, d)
    # the rows, not the assembled table, so that each model still keeps what it goes through many times
    train = train.persist()
    data, pred = rk.assembled(train, FEATURES, "label"), rk.assembled(valid, FEATURES, "label")
    for name, m in models.items():
        pred = m.fit(data).transform(pred).withColumn(name, C("prediction").cast("int")).drop("prediction", "rawPrediction", "probability")
    train.unpersist()
    each = F.explode(F.array(*[F.struct(F.lit(name).alias("model"), C(name).alias("pred")) for name in models])).alias("p")
    counts = pred.select("label", "grp", each).groupBy("p.model", "label", "p.pred", "grp").agg(F.count("*").alias("n"))
    return ev.metrics(counts, ["model"]).select("accuracy", "f1", "fairness", "rows", "model")


@query("evaluate_masks_models")
def evaluate_masks_models(s, d):
    """Three masks with the best of a small parameter grid of trees, chosen by F1."""
    from pyspark.ml.classification import DecisionTreeClassifier

    train, valid, _ = parts(s, d)
    grid = [DecisionTreeClassifier(labelCol="__y", maxDepth=n, seed=7) for n in (2, 4)]
    return ev.evaluate_model(train, valid, FEATURES, "label", "grp", [1, 6, 15], LIMITS, grid, "f1")


@query("balanced_logistic")
def balanced_logistic(s, d):
    from pyspark.ml.classification import LogisticRegression

    train, valid, _ = parts(s, d)
    share = train.agg(F.avg("label")).first()[0]
    data = rk.assembled(train, FEATURES, "label").withColumn("w", F.when(C("label") == 1, 0.5 / share).otherwise(0.5 / (1 - share)))
    pred = LogisticRegression(labelCol="__y", weightCol="w", maxIter=10).fit(data).transform(rk.assembled(valid, FEATURES, "label"))
    return ev.metrics(pred.select("label", C("prediction").cast("int").alias("pred"), "grp").groupBy("label", "pred", "grp").agg(F.count("*").alias("n")), [])


def _bounds(df):
    row = df.agg(*[g(f).alias(f"{k}_{f}") for f in FEATURES for k, g in (("lo", F.min), ("hi", F.max))]).first()
    return {f: (float(row[f"lo_{f}"]), float(row[f"hi_{f}"])) for f in FEATURES}


@query("private_nb")
def private_nb(s, d):
    train, valid, _ = parts(s, d)
    model = ev.fit_nb(train, FEATURES, "label", epsilon=1.0, bounds=_bounds(train))
    return ev.metrics(ev.confusion(valid, model, FEATURES, "label", "grp", [15]), ["mask"])


@query("private_lr")
def private_lr(s, d):
    """Logistic regression with output perturbation: coefficients plus seeded Laplace noise of scale 2 / (n * reg * epsilon)."""
    import numpy as np
    from pyspark.ml.classification import LogisticRegression

    train, _, _ = parts(s, d)
    scaled = train.select("label", *[e.alias(c) for c, e in num.fit_minmax(train, FEATURES).items()])
    model = LogisticRegression(labelCol="__y", maxIter=10, regParam=0.01).fit(rk.assembled(scaled, FEATURES, "label"))
    noise = np.random.default_rng(7).laplace(0, 2 / (train.count() * 0.01 * 1.0), len(FEATURES))
    return s.createDataFrame([(f, float(c + e)) for f, c, e in zip(FEATURES, model.coefficients.toArray(), noise)], "feature string, coefficient double")


@query("private_random_trees")
def private_random_trees(s, d):
    """Leaves of random private trees with their majorities and counts."""
    df = lines(s, d)
    leaves = pt.fit_private_trees(df, FEATURES, "label", _bounds(df), epsilon=0.5).table(s)
    return leaves.select("tree", "leaf", "majority", C("counts")[0].alias("n0"), C("counts")[1].alias("n1"))


@query("private_trees_vote")
def private_trees_vote(s, d):
    """Accuracy, F1 and fairness of the vote of private trees."""
    train, valid, _ = parts(s, d)
    return ev.metrics(pt.fit_private_trees(train, FEATURES, "label", _bounds(train), epsilon=0.5).confusion(valid, "label", "grp"), [])


@query("resource_constraints", "SELECT event_id, CASE WHEN value > 40 THEN 40 - value WHEN user_id % 50 > 30 THEN (30 - user_id % 50)::DOUBLE WHEN event_id % 9 > 6 THEN (6 - event_id % 9)::DOUBLE ELSE 0 END AS violation FROM events")
def resource_constraints(s, d):
    checks = [(C("value"), 40.0), ((C("user_id") % 50).cast("double"), 30.0), ((C("event_id") % 9).cast("double"), 6.0)]
    first = F.coalesce(*[F.when(v > limit, limit - v) for v, limit in checks], F.lit(0.0))
    return read(s, d, "events").select("event_id", first.alias("violation"))


def _full_accuracy_sql(train, valid):
    """Accuracy of naive Bayes over all features, fitted and scored on rows that the conditions choose."""
    one = _MET.replace(str(MASKS), "[15]").replace("row_id % 5 < 3", train).replace("row_id % 5 = 3", valid)
    return f"SELECT * FROM ({one} SELECT accuracy FROM m)"


@query("holdout_vs_cv", f"SELECT round(({_full_accuracy_sql('row_id % 5 < 3', 'row_id % 5 = 3')}), 6) AS holdout, round((SELECT avg(accuracy) FROM (" + " UNION ALL ".join(_full_accuracy_sql(f"row_id % 5 <> {k}", f"row_id % 5 = {k}") for k in range(5)) + ")), 6) AS cv")
def holdout_vs_cv(s, d):
    """Accuracy of naive Bayes on a hold-out part and as the mean over five folds."""
    train, valid, _ = parts(s, d)
    acc = lambda a, b: ev.metrics(ev.confusion(b, ev.fit_nb(a, FEATURES, "label"), FEATURES, "label", "grp", [15]), []).first().accuracy
    df = lines(s, d).withColumn("fold", C("row_id") % 5)
    folds = [acc(df.where(C("fold") != k), df.where(C("fold") == k)) for k in range(5)]
    return s.createDataFrame([(round(acc(train, valid), 6), round(sum(folds) / 5, 6))], "holdout double, cv double")


@query("pca")
def pca(s, d):
    from pyspark.ml.feature import PCA

    data = rk.assembled(lines(s, d).withColumns(num.fit_standard(lines(s, d), FEATURES)), FEATURES, "label")
    model = PCA(k=2, inputCol="features", outputCol="pca").fit(data)
    return s.createDataFrame([(i, float(v)) for i, v in enumerate(model.explainedVariance.toArray())], "component int, share double")


DIM = 64  # of the embeddings that are projected; longer ones would need a larger matrix


@query("pca_rows")
def pca_rows(s, d):
    """Every row on the first two principal axes of its standardised features."""
    from pyspark.ml.feature import PCA
    from pyspark.ml.functions import vector_to_array

    df = lines(s, d)
    data = rk.assembled(df.withColumns(num.fit_standard(df, FEATURES)), FEATURES, "label")
    z = vector_to_array("pca")
    return PCA(k=2, inputCol="features", outputCol="pca").fit(data).transform(data).select("row_id", *[r6(z[i], f"z{i}") for i in range(2)])


@query("truncated_svd")
def truncated_svd(s, d):
    """Singular values of the feature matrix, from one pass of products; and each feature's weight in the right vectors."""
    import numpy as np

    pairs = [(i, j) for i in range(len(FEATURES)) for j in range(i, len(FEATURES))]
    row = lines(s, d).agg(*[F.sum(C(FEATURES[i]) * C(FEATURES[j])).alias(f"p{i}_{j}") for i, j in pairs]).first()
    gram = np.array([[float(row[f"p{min(i, j)}_{max(i, j)}"]) for j in range(len(FEATURES))] for i in range(len(FEATURES))])
    values, vectors = np.linalg.eigh(gram)
    order = np.argsort(values)[::-1][:2]
    return s.createDataFrame([(k, float(max(0.0, values[i]) ** 0.5), FEATURES[j], float(abs(vectors[j, i]))) for k, i in enumerate(order) for j in range(len(FEATURES))], "component int, singular double, feature string, weight double")


def _random_matrix(kind):
    """(weights, shifts) of a seeded map from DIM to 4: Gaussian or sparse projection, or random Fourier features."""
    import numpy as np

    rng = np.random.default_rng(7)
    w = {"gaussian": lambda: rng.standard_normal((DIM, 4)) / 2, "sparse": lambda: rng.choice([-1.0, 0, 1], (DIM, 4), p=[1 / 6, 2 / 3, 1 / 6]) * np.sqrt(3) / 2, "rbf": lambda: rng.standard_normal((DIM, 4))}[kind]()
    return w, rng.uniform(0, 2 * np.pi, 4)


def _random_map(s, d, kind):
    """Rows mapped by the matrix, as sums of products with literals."""
    w, b = _random_matrix(kind)
    dot = lambda i: F.aggregate(F.zip_with("embedding", F.array(*[F.lit(float(x)) for x in w[:, i]]), lambda x, y: x.cast("double") * y), F.lit(0.0), lambda a, x: a + x)
    z = [F.lit(0.5**0.5) * F.cos(dot(i) + F.lit(float(b[i]))) if kind == "rbf" else dot(i) for i in range(4)]
    return read(s, d, "embeddings").select("vec_id", *[r6(x, f"z{i}") for i, x in enumerate(z)])


def _random_map_sql(kind):
    w, b = _random_matrix(kind)
    dot = lambda i: f"list_dot_product(embedding::DOUBLE[], {[float(x) for x in w[:, i]]}::DOUBLE[])"
    z = [f"round(sqrt(0.5) * cos({dot(i)} + {float(b[i])!r}), 6)" if kind == "rbf" else f"round({dot(i)}, 6)" for i in range(4)]
    return "SELECT vec_id, " + ", ".join(f"{x} AS z{i}" for i, x in enumerate(z)) + " FROM embeddings"


for _query, _kind in (("gaussian_random_projection", "gaussian"), ("sparse_random_projection", "sparse"), ("rbf_sampler", "rbf")):
    query(_query, _random_map_sql(_kind))(lambda s, d, kind=_kind: _random_map(s, d, kind))


@query("constraint_metafeatures", f"WITH l AS ({_LOG}) SELECT event_id, round(acc * fair, 6) AS acc_fair, round(ln(1 + share), 6) AS log_share, (acc > 0.5)::INT AS has_acc, round(acc * fair * share, 6) AS all_three FROM l")
def constraint_metafeatures(s, d):
    return _log(s, d).select("event_id", r6(C("acc") * C("fair"), "acc_fair"), r6(F.ln(1 + C("share")), "log_share"), (C("acc") > 0.5).cast("int").alias("has_acc"), r6(C("acc") * C("fair") * C("share"), "all_three"))


@query("fold_scores", "SELECT (row_id % 5)::INT AS fold, round(avg(((discount > 0.05)::INT = label)::INT), 6) AS accuracy FROM {lines} GROUP BY 1")
def fold_scores(s, d):
    df = lines(s, d).select((C("row_id") % 5).cast("int").alias("fold"), "label", (C("discount") > 0.05).cast("int").alias("pred"), "grp")
    return ev.metrics(df.groupBy("fold", "label", "pred", "grp").agg(F.count("*").alias("n")), ["fold"]).select("fold", r6(C("accuracy"), "accuracy"))
