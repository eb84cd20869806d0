"""Scoring many feature masks in one job, metrics, and the constraint loss.

Gaussian naive Bayes is additive over features: with L[row, class, feature] its log-likelihoods and M[feature, mask],
prior + L . M scores all masks at once. Fitting is one aggregate per class; scoring is one pass over the rows that
leaves each task as a small table of confusion counts.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..scratch import ROWS
from .rank import classwise_stats


@dataclass(frozen=True)
class Constraints:
    """Thresholds; None isn't asked for, infinity means that the value is to be as high as possible."""

    accuracy: float | None = None
    fairness: float | None = None
    safety: float | None = None
    complexity: float | None = None  # most features, as a share of all


@dataclass(frozen=True)
class NaiveBayes:
    labels: list
    prior: np.ndarray
    mean: np.ndarray
    var: np.ndarray

    def log_likelihoods(self, x: np.ndarray) -> np.ndarray:
        """rows x classes x features."""
        return -0.5 * (np.log(2 * np.pi * self.var)[None] + (x[:, None, :] - self.mean[None]) ** 2 / self.var[None])


def fit_nb(train: DataFrame, features: list[str], label: str, smoothing: float = 1e-9, epsilon: float | None = None, bounds: dict[str, tuple[float, float]] | None = None, seed: int = 7, stats: pd.DataFrame | None = None) -> NaiveBayes:
    """From sufficient statistics, which may be given. With epsilon, Laplace noise is added to the means and variances of values bounded as given."""
    st = classwise_stats(train, features, label).toPandas() if stats is None else stats
    labels = sorted(st["label"].unique().tolist())
    pick = lambda c: st.pivot(index="label", columns="feature", values=c).loc[labels, features].to_numpy(dtype=float)
    n, mean = pick("n"), pick("s") / pick("n")
    var = np.maximum(pick("ss") / n - mean**2, 0)
    if epsilon is not None:
        rng = np.random.default_rng(seed)
        width = np.array([(bounds or {}).get(f, (0.0, 1.0)) for f in features])
        width = width[:, 1] - width[:, 0]
        mean = mean + rng.laplace(0, width / (n * epsilon / 3))
        var = np.maximum(var + rng.laplace(0, width**2 / (n * epsilon / 3)), 1e-6)
    total = pick("ss").sum(0) / n.sum(0) - (pick("s").sum(0) / n.sum(0)) ** 2
    var = var + smoothing * total.max()
    return NaiveBayes(labels, n[:, 0] / n[:, 0].sum(), mean, var)


def mask_type(n: int) -> str:
    """How a mask over n features is stored: a long, or from 64 features on a text of 0 and 1, first feature first."""
    return "long" if n < 64 else "string"


def stored(mask: int, n: int) -> int | str:
    return mask if n < 64 else "".join("01"[(mask >> i) & 1] for i in range(n))


def loaded(mask: int | str) -> int:
    return mask if isinstance(mask, int) else sum(1 << i for i, b in enumerate(mask) if b == "1")


def mask_matrix(masks: list[int], n: int) -> np.ndarray:
    """features x masks of 0 and 1; bit i of a mask stands for feature i."""
    return np.array([[(m >> i) & 1 for m in masks] for i in range(n)], dtype=float)


def places(labels: list, values: pd.Series) -> np.ndarray:
    """Place of each value in the sorted labels; behind them where it isn't one."""
    known = np.array(labels)
    at = np.minimum(np.searchsorted(known, values.to_numpy()), len(known) - 1)
    return np.where(known[at] == values.to_numpy(), at, len(known))


def other_label(labels: list) -> int:
    """What stands for all labels that a model doesn't know."""
    return int(labels[0]) - 1


def count_predictions(df: DataFrame, features: list[str], label: str, group: str, labels: list, columns: list[tuple[int, int]], predict: Callable[[pd.DataFrame], np.ndarray], block: int = 4096) -> DataFrame:
    """(mask, label, pred, grp, n, setting) over all rows.

    columns: the mask and the setting of each column of what ``predict`` gives for some rows, the places of the predicted
    labels. ``df`` may be what ``counted`` makes. Labels that aren't among ``labels`` count as one more class, ``other_label``, which nothing predicts.
    """
    names = np.array([stored(m, len(features)) for m, _ in columns], dtype=object)
    settings = np.array([k for _, k in columns])
    known = np.array([*labels, other_label(labels)])
    weighed = ROWS in df.columns

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        k = len(labels)
        total = np.zeros((len(columns), k + 1, k, 2), dtype=np.int64)
        for b in batches:
            for at in range(0, len(b), block):
                part = b.iloc[at : at + block]
                pred = predict(part)
                # rows of each class and group that are predicted as c, for all columns: a product of 0/1 matrices
                code = places(labels, part[label]) * 2 + part[group].to_numpy(dtype=int)
                own = (code[:, None] == np.arange(2 * k + 2)[None]).astype(np.float32)
                if weighed:
                    own = own * part[ROWS].to_numpy(dtype=float)[:, None]
                for c in range(k):
                    n = own.T @ (pred == c).astype(np.float32)
                    total[:, :, c, :] += n.T.reshape(len(columns), k + 1, 2).astype(np.int64)
        at = np.argwhere(total)
        yield pd.DataFrame({"mask": names[at[:, 0]], "label": known[at[:, 1]], "pred": known[at[:, 2]], "grp": at[:, 3], "n": total[tuple(at.T)], "setting": settings[at[:, 0]]})

    counts = df.select(*features, label, group, *[ROWS] * weighed).mapInPandas(run, f"mask {mask_type(len(features))}, label int, pred int, grp int, n long, setting int")
    return counts.groupBy("mask", "label", "pred", "grp", "setting").agg(F.sum("n").alias("n"))


def confusion(df: DataFrame, model: NaiveBayes, features: list[str], label: str, group: str, masks: list[int]) -> DataFrame:
    """(mask, label, pred, grp, n) of all masks over all rows; ``model`` has labels, prior and log_likelihoods(rows)."""
    m = mask_matrix(masks, len(features))

    def predict(part: pd.DataFrame) -> np.ndarray:
        log = model.log_likelihoods(part[features].to_numpy(dtype=float))
        best, pred = None, np.zeros((len(part), len(masks)), dtype=np.int8)
        for c in range(len(model.labels)):
            score = log[:, c, :] @ m + np.log(model.prior[c])
            if best is None:
                best = score
            else:
                pred[score > best] = c
                best = np.maximum(best, score)
        return pred

    return count_predictions(df, features, label, group, model.labels, [(x, 0) for x in masks], predict).drop("setting")


def metrics(counts: DataFrame, by: list[str], positive: int = 1, scorer: str | Callable[..., Column] | None = None) -> DataFrame:
    """(by, accuracy, f1, fairness, rows) from confusion counts, and with ``scorer`` also score.

    scorer: accuracy, f1, fairness, or a function of the columns tp, fp, fn, tn that gives a column.

    Fairness is 1 - |TP0 / n0 - TP1 / n1| with n the size of the group (not of its positives); a table without two
    groups counts as fair.
    """
    n = F.col("n")
    tp = (F.col("label") == positive) & (F.col("pred") == positive)
    s = lambda cond: F.sum(F.when(cond, n).otherwise(0))
    a = counts.groupBy(*by).agg(
        F.sum(n).alias("rows"), s(F.col("label") == F.col("pred")).alias("hit"), s(tp).alias("tp"), s((F.col("label") != positive) & (F.col("pred") == positive)).alias("fp"), s((F.col("label") == positive) & (F.col("pred") != positive)).alias("fn"),
        *[x for g in (0, 1) for x in (s(F.col("grp") == g).alias(f"n{g}"), s(tp & (F.col("grp") == g)).alias(f"tp{g}"))],
    )
    gap = F.abs(F.try_divide("tp0", "n0") - F.try_divide("tp1", "n1"))
    out = {"accuracy": F.col("hit") / F.col("rows"), "f1": F.coalesce(F.try_divide(2 * F.col("tp"), 2 * F.col("tp") + F.col("fp") + F.col("fn")), F.lit(0.0)), "fairness": 1 - F.coalesce(gap, F.lit(0.0)), "rows": F.col("rows")}
    if scorer is not None:
        tp, fp, fn = F.col("tp"), F.col("fp"), F.col("fn")
        out["score"] = out[scorer] if isinstance(scorer, str) else scorer(tp, fp, fn, F.col("rows") - tp - fp - fn).cast("double")
    return a.select(*by, *[v.alias(k) for k, v in out.items()])


def constraint_loss(c: Constraints, accuracy: Column, fairness: Column, share: Column, safety: Column | None = None) -> Column:
    """Sum of squared violations; where nothing is violated and a threshold is infinite, minus that value. No feature: 4."""
    inf = float("inf")
    terms, utility = [], None
    for limit, value in ((c.accuracy, accuracy), (c.fairness, fairness), (c.safety, safety)):
        if limit is None or value is None:
            continue
        if limit == inf:
            utility = -value if utility is None else utility - value
        else:
            gap = F.greatest(F.lit(0.0), F.lit(limit) - value)
            terms.append(gap * gap)
    if c.complexity is not None:
        gap = F.greatest(F.lit(0.0), share - F.lit(c.complexity))
        terms.append(gap * gap)
    loss = sum(terms, F.lit(0.0))
    if utility is not None:
        loss = F.when(loss > 0, loss).otherwise(utility)
    return F.when(share <= 0, F.lit(4.0)).otherwise(loss)


def satisfied(c: Constraints, accuracy: Column, fairness: Column, share: Column) -> Column:
    """Whether every finite constraint holds and none is infinite."""
    ok = F.lit(float("inf") not in (c.accuracy, c.fairness, c.safety))
    if c.accuracy is not None:
        ok &= accuracy >= c.accuracy
    if c.fairness is not None:
        ok &= fairness >= c.fairness
    if c.complexity is not None:
        ok &= share <= c.complexity
    return ok


def evaluate_model(train: DataFrame, valid: DataFrame, features: list[str], label: str, group: str, masks: list[int], constraints: Constraints, estimators: list, scorer: str | Callable[..., Column] = "accuracy") -> DataFrame:
    """As ``evaluate_masks`` for any Spark ML classifier: per mask the setting of ``estimators`` that scores highest.

    A mask is a fit of its own per setting, one Spark job each; ``scorer`` as in ``metrics``. The result has
    ``setting``, the place of the chosen one.
    """
    from .mask_models import SparkMasks, evaluate

    return evaluate(SparkMasks(tuple(estimators)).prepare(train, features, label), valid, features, group, masks, constraints, scorer).drop("score")


def evaluate_masks(train: DataFrame, valid: DataFrame, features: list[str], label: str, group: str, masks: list[int], constraints: Constraints, smoothings=(1e-9,)) -> DataFrame:
    """(mask, size, share, accuracy, f1, fairness, loss, satisfied): per mask the smoothing of highest accuracy (not of lowest loss)."""
    from .mask_models import GaussianMasks, evaluate

    return evaluate(GaussianMasks(tuple(smoothings)).prepare(train, features, label), valid, features, group, masks, constraints).drop("setting", "score")


def _with_loss(scored: DataFrame, features: list[str], constraints: Constraints, *keep: str, goal: str = "accuracy") -> DataFrame:
    size = F.bit_count("mask").cast("int") if len(features) < 64 else F.length(F.replace("mask", F.lit("0"), F.lit("")))
    share = size / F.lit(float(len(features)))
    c = [F.col(goal), F.col("fairness"), share]
    return scored.select("mask", size.alias("size"), share.alias("share"), "accuracy", "f1", "fairness", constraint_loss(constraints, *c).alias("loss"), satisfied(constraints, *c).alias("satisfied"), *keep)


def micro_f1(counts: DataFrame) -> DataFrame:
    """One row: F1 over the summed true and false positives and false negatives of all classes (counts: label, pred, n)."""
    n = F.col("n")
    s = counts.agg(F.sum(F.when(F.col("label") == F.col("pred"), n).otherwise(0)).alias("tp"), F.sum(F.when(F.col("label") != F.col("pred"), n).otherwise(0)).alias("wrong"))
    # every wrong row is a false positive of one class and a false negative of another
    return s.select((2 * F.col("tp") / (2 * F.col("tp") + 2 * F.col("wrong"))).alias("micro_f1"))


def micro_auc(df: DataFrame, scores: dict, label: str) -> DataFrame:
    """One row: area under the curve over all (row, class) pairs, a pair's score being the class's and its truth whether it is the row's class.

    scores: class -> column of its score.
    """
    pairs = F.array(*[F.struct(F.col(c).cast("double").alias("score"), (F.col(label) == F.lit(k)).cast("int").alias("hit")) for k, c in scores.items()])
    return roc_auc(df.select(F.explode(pairs).alias("p")).select("p.*"), "score", "hit")


def roc_auc(df: DataFrame, score: str, label: str) -> DataFrame:
    """One row: area under the curve by rank sums with average ranks; ranks come from counts per score."""
    from ..functions.window import value_ranks

    ranks = value_ranks(df, score)
    per = df.groupBy(F.col(score).alias("value")).agg(F.sum(F.col(label)).alias("pos"), F.count("*").alias("all"))
    x = per.join(ranks, "value").agg(F.sum(F.col("pos") * (F.col("before") + (F.col("n") + 1) / 2.0)).alias("r"), F.sum("pos").alias("p"), F.sum("all").alias("t"))
    return x.select(((F.col("r") - F.col("p") * (F.col("p") + 1) / 2.0) / (F.col("p") * (F.col("t") - F.col("p")))).alias("auc"))


def robustness(df: DataFrame, model: NaiveBayes, features: list[str], label: str, mask: int, scale: dict[str, float], steps: int = 10, seed: int = 7) -> DataFrame:
    """One row: clean and attacked accuracy, safety = 1 - their difference.

    For each row a seeded search along a random direction takes the first of ``steps`` growing moves that turns the
    prediction; the moves are scaled by each feature's deviation.
    """
    use = [i for i in range(len(features)) if (mask >> i) & 1]
    width = np.array([scale[features[i]] for i in use])
    labels = np.array(model.labels)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        n = clean = attacked = 0
        for b in batches:
            x = b[features].to_numpy(dtype=float)
            y = np.searchsorted(labels, b[label].to_numpy())
            m = mask_matrix([mask], len(features))
            predict = lambda v: (model.log_likelihoods(v) @ m + np.log(model.prior)[None, :, None]).argmax(axis=1)[:, 0]
            base = predict(x)
            way = np.random.default_rng(seed).standard_normal((len(x), len(use)))
            way /= np.linalg.norm(way, axis=1, keepdims=True)
            now = base.copy()
            for k in range(1, steps + 1):
                moved = x.copy()
                moved[:, use] += way * width * 0.1 * k
                now = np.where(now == base, predict(moved), now)
            n += len(x)
            clean += int((base == y).sum())
            attacked += int((now == y).sum())
        yield pd.DataFrame({"n": [n], "clean": [clean], "attacked": [attacked]})

    s = df.select(*features, label).mapInPandas(run, "n long, clean long, attacked long").agg(*[F.sum(c).alias(c) for c in ("n", "clean", "attacked")])
    return s.select((F.col("clean") / F.col("n")).alias("clean"), (F.col("attacked") / F.col("n")).alias("attacked"), (1 - (F.col("clean") - F.col("attacked")) / F.col("n")).alias("safety"))
