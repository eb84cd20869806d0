"""Models that are fitted and scored over many feature masks at once, each with its grid of settings.

``prepare`` reads of the training table what doesn't depend on the masks, once for a whole search; ``confusion`` then gives
the confusion counts of every (mask, setting) on a validation table. Naive Bayes adds log-likelihoods, so a batch is
one product of matrices. Logistic regression takes a Newton step for all columns (mask, setting) in each job. Trees grow
level by level over binned features; nodes that the trees of several masks share are one node, and a tree cut at a
smaller depth is that depth's tree, so the grid of depths costs nothing. For logistic regression and trees, rows that are equal
in what the model sees (for trees: in their codes) are one row with their number, in training and in scoring.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.window import exact_quantiles
from ..scratch import ROWS, counted, cut, discard
from .evaluate import Constraints, NaiveBayes, _with_loss, confusion, count_predictions, fit_nb, mask_matrix, mask_type, metrics, other_label, places, stored
from .rank import assembled, classwise_stats

#: Numbers that the arrays of one pass hold at most, over all nodes or columns; more take several passes.
PASS_NUMBERS = 1 << 22
#: Rows that are looked at together.
BLOCK = 4096


def array_sums(df: DataFrame, partial: Callable[[Iterator[pd.DataFrame]], dict[int, np.ndarray]], merge=np.add) -> dict[int, np.ndarray]:
    """Sums over all tasks (or what ``merge`` makes of two) of the arrays that ``partial`` makes of a task's rows, by key. Arrays of a key are merged in a task."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for k, v in partial(batches).items():
            yield pd.DataFrame({"k": [k], "v": [np.ascontiguousarray(v, dtype=np.float64).tobytes()]})

    def add(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total: dict[int, np.ndarray] = {}
        for b in batches:
            for k, v in zip(b["k"].tolist(), b["v"]):
                got = np.frombuffer(v, dtype=np.float64)
                total[k] = merge(total[k], got) if k in total else got
        if total:
            yield pd.DataFrame({"k": list(total), "v": [v.tobytes() for v in total.values()]})

    sums = df.mapInPandas(run, "k int, v binary").repartition("k").mapInPandas(add, "k int, v binary")
    return {r.k: np.frombuffer(r.v, dtype=np.float64) for r in sums.collect()}


def kept(held: list, df: DataFrame, make: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """``make(df)``, made again only for another table; a search scores all its batches on one."""
    if not held or held[0] is not df:
        held[:] = [df, make(df)]
    return held[1]


# naive Bayes


@dataclass(frozen=True)
class GaussianMasks:
    """Gaussian naive Bayes; a setting is a smoothing, the share of the largest variance that all variances get."""

    smoothings: tuple[float, ...] = (1e-9,)

    def prepare(self, train: DataFrame, features: list[str], label: str) -> _Additive:
        stats = classwise_stats(train, features, label).toPandas()
        return _Additive(features, label, [fit_nb(train, features, label, s, stats=stats) for s in self.smoothings])


@dataclass(frozen=True)
class Bernoulli:
    """P(feature > threshold) per class."""

    labels: list
    prior: np.ndarray
    share: np.ndarray
    threshold: float

    def log_likelihoods(self, x: np.ndarray) -> np.ndarray:
        """rows x classes x features."""
        on = x[:, None, :] > self.threshold
        return np.where(on, np.log(self.share)[None], np.log1p(-self.share)[None])


@dataclass(frozen=True)
class BernoulliMasks:
    """Bernoulli naive Bayes over features as above or not above a threshold; a setting is the weight added to each count."""

    alphas: tuple[float, ...] = (1.0,)
    threshold: float = 0.0

    def prepare(self, train: DataFrame, features: list[str], label: str) -> _Additive:
        on = [F.sum((F.col(f) > self.threshold).cast("long")).alias(f"s{i}") for i, f in enumerate(features)]
        rows = sorted(train.groupBy(F.col(label).alias("y")).agg(F.count("*").alias("n"), *on).collect(), key=lambda r: r.y)
        n = np.array([r.n for r in rows], dtype=float)
        ones = np.array([[r[f"s{i}"] or 0 for i in range(len(features))] for r in rows], dtype=float)
        return _Additive(features, label, [Bernoulli([r.y for r in rows], n / n.sum(), (ones + a) / (n[:, None] + 2 * a), self.threshold) for a in self.alphas])


@dataclass(frozen=True)
class _Additive:
    features: list[str]
    label: str
    models: list[NaiveBayes | Bernoulli]

    def confusion(self, valid: DataFrame, group: str, masks: list[int]) -> DataFrame:
        out = None
        for k, m in enumerate(self.models):
            one = confusion(valid, m, self.features, self.label, group, masks).withColumn("setting", F.lit(k))
            out = one if out is None else out.unionByName(one)
        return out


@dataclass(frozen=True)
class SparkMasks:
    """Any Spark ML classifiers over columns ``features`` and ``__y``, each a setting; every mask and setting is a fit of its own."""

    estimators: tuple

    def prepare(self, train: DataFrame, features: list[str], label: str) -> _Spark:
        return _Spark(self.estimators, train, features, label)


@dataclass(frozen=True)
class _Spark:
    estimators: tuple
    train: DataFrame
    features: list[str]
    label: str

    def confusion(self, valid: DataFrame, group: str, masks: list[int]) -> DataFrame:
        out, n = None, len(self.features)
        for mask in masks:
            names = [f for i, f in enumerate(self.features) if (mask >> i) & 1]
            for k, e in enumerate(self.estimators):
                pred = e.fit(assembled(self.train, names, self.label)).transform(assembled(valid, names, self.label))
                counts = pred.groupBy(F.col(self.label).alias("label"), F.col("prediction").cast("int").alias("pred"), F.col(group).alias("grp")).agg(F.count("*").alias("n"))
                one = counts.withColumns({"mask": F.lit(stored(mask, n)).cast(mask_type(n)), "setting": F.lit(k)})
                out = one if out is None else out.unionByName(one)
        return out


# logistic regression


@dataclass(frozen=True)
class LogisticMasks:
    """Logistic regression of two classes with an L2 penalty on standardised features; a setting is C, the weight of the rows against the penalty.

    Minimises C * sum of weighted row losses + |coefficients|^2 / 2, without a penalty on the intercept; ``balanced`` weighs
    classes by the inverse of their size. Missing values count as the mean. Up to ``exact`` features the
    Newton steps use each column's own Hessian; beyond, one bound of all Hessians (a quarter of the Gram
    matrix), which needs more passes but no numbers per column and pair of features.
    """

    cs: tuple[float, ...] = (0.001, 0.01, 0.1, 1.0, 10.0, 100.0, 1000.0)
    balanced: bool = True
    exact: int = 64
    tolerance: float = 1e-9
    most_steps: int = 500

    def prepare(self, train: DataFrame, features: list[str], label: str) -> _Logistic:
        stats = train.groupBy(F.col(label).alias("y")).agg(F.count("*").alias("n"), *[F.sum(F.col(f).cast("double") ** k).alias(f"s{k}_{i}") for i, f in enumerate(features) for k in (1, 2)], *[F.count(f).alias(f"n_{i}") for i, f in enumerate(features)])
        rows = sorted(stats.collect(), key=lambda r: r.y)
        if len(rows) != 2:
            raise ValueError(f"logistic regression takes two classes, got {len(rows)}")
        every = lambda c: np.array([sum((r[f"{c}_{i}"] or 0) for r in rows) for i in range(len(features))], dtype=float)
        n = np.maximum(every("n"), 1)
        mean = every("s1") / n
        scale = np.sqrt(np.maximum(every("s2") / n - mean**2, 0))
        total = sum(r.n for r in rows)
        weights = np.array([total / (2 * r.n) if self.balanced else 1.0 for r in rows])
        return _Logistic(self, counted(train.select(*features, label)), features, label, [r.y for r in rows], weights, _Design(features, mean, np.where(scale > 0, scale, 1.0)))


@dataclass(frozen=True)
class _Design:
    features: list[str]
    mean: np.ndarray
    scale: np.ndarray

    def of(self, b: pd.DataFrame) -> np.ndarray:
        """Standardised features and a column of ones."""
        x = (b[self.features].to_numpy(dtype=float) - self.mean) / self.scale
        return np.c_[np.nan_to_num(x), np.ones(len(x))]


@dataclass
class _Logistic:
    model: LogisticMasks
    train: DataFrame
    features: list[str]
    label: str
    labels: list
    weights: np.ndarray
    design: _Design
    fitted: dict[int, np.ndarray] = field(default_factory=dict)
    gram: np.ndarray | None = None
    held: list = field(default_factory=list)

    def _pass(self, beta: np.ndarray, hessians: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray | None]:
        """(loss, gradient, Hessian as pairs or None) of all columns at their coefficients, in one job."""
        positive, label, design, weights, f1 = self.labels[1], self.label, self.design, self.weights, beta.shape[1]
        i, j = np.triu_indices(f1)
        coefs = beta.T.copy()
        width = 1 + f1 + (len(i) if hessians else 0)

        def partial(batches: Iterator[pd.DataFrame]) -> dict[int, np.ndarray]:
            out = np.zeros((coefs.shape[1], width))
            for b in batches:
                for at in range(0, len(b), BLOCK // 2):
                    part = b.iloc[at : at + BLOCK // 2]
                    x = design.of(part)
                    y = (part[label].to_numpy() == positive).astype(float)
                    w = weights[y.astype(int)] * part[ROWS].to_numpy(dtype=float)
                    z = x @ coefs
                    p = 1 / (1 + np.exp(-np.clip(z, -500, 500)))
                    out[:, 0] += w @ (np.logaddexp(0, z) - y[:, None] * z)
                    out[:, 1 : 1 + f1] += (w[:, None] * (p - y[:, None])).T @ x
                    if hessians:
                        out[:, 1 + f1 :] += (w[:, None] * p * (1 - p)).T @ (x[:, i] * x[:, j])
            return {k // 64: out[k : k + 64].reshape(-1) for k in range(0, len(out), 64)}

        sums = array_sums(self.train, partial)
        flat = np.concatenate([sums[k].reshape(-1, width) for k in sorted(sums)])
        return flat[:, 0], flat[:, 1 : 1 + f1], flat[:, 1 + f1 :] if hessians else None

    def _gram(self) -> np.ndarray:
        """A quarter of the weighted Gram matrix, as pairs; from the Hessian at zero, whose rows all have p (1 - p) = 1/4."""
        if self.gram is None:
            self.gram = self._pass(np.zeros((1, len(self.features) + 1)), True)[2][0]
        return self.gram

    def fit(self, masks: list[int]) -> dict[int, np.ndarray]:
        """Coefficients (settings x features and the intercept) of each mask, on the standardised features."""
        new = [m for m in dict.fromkeys(masks) if m not in self.fitted]
        cs = np.array(self.model.cs)
        f1 = len(self.features) + 1
        per = max(1, PASS_NUMBERS // (len(cs) * (f1 * (f1 + 1) // 2 + f1 + 1)))
        for a in range(0, len(new), per):
            some = new[a : a + per]
            beta = self._newton(np.repeat(np.c_[mask_matrix(some, f1 - 1).T, np.ones(len(some))] > 0, len(cs), axis=0), np.tile(cs, len(some)))
            self.fitted |= {m: beta[k * len(cs) : (k + 1) * len(cs)] for k, m in enumerate(some)}
        return {m: self.fitted[m] for m in masks}

    def _newton(self, on: np.ndarray, cs: np.ndarray) -> np.ndarray:
        """Columns x coefficients; ``on``: which coefficients a column has. A step that doesn't lower a column's loss is halved."""
        n, f1 = on.shape
        exact = f1 - 1 <= self.model.exact
        i, j = np.triu_indices(f1)
        penalty = np.r_[np.ones(f1 - 1), 0.0]
        beta, base, way = np.zeros((n, f1)), np.zeros((n, f1)), np.zeros((n, f1))
        last, step = np.full(n, np.inf), np.ones(n)
        left = np.arange(n)
        for _ in range(self.model.most_steps):
            loss, grad, pairs = self._pass(beta[left], exact)
            done = []
            for k, c in enumerate(left.tolist()):
                value = loss[k] + 0.5 * (penalty * beta[c] ** 2).sum() / cs[c]
                if value > last[c] + 1e-10 * abs(last[c]):
                    step[c] /= 2
                    if step[c] < 1e-6:
                        beta[c] = base[c]
                        done.append(k)
                    else:
                        beta[c] = base[c] + step[c] * way[c]
                    continue
                last[c], base[c], step[c] = value, beta[c], 1.0
                h = np.zeros((f1, f1))
                h[i, j] = pairs[k] if exact else self._gram()
                h = h + np.triu(h, 1).T + np.diag(penalty / cs[c])
                at = np.flatnonzero(on[c])
                g = (grad[k] + penalty * beta[c] / cs[c])[at]
                way[c] = 0
                way[c, at] = -np.linalg.lstsq(h[np.ix_(at, at)], g, rcond=None)[0]
                beta[c] = base[c] + way[c]
                if np.abs(way[c]).max() <= self.model.tolerance * (1 + np.abs(beta[c]).max()):
                    done.append(k)
            left = np.delete(left, done)
            if not len(left):
                break
        return beta

    def confusion(self, valid: DataFrame, group: str, masks: list[int]) -> DataFrame:
        coefs, design = self.fit(masks), self.design
        settings = len(self.model.cs)
        b = np.concatenate([coefs[m] for m in masks]).T
        valid = kept(self.held, valid, lambda v: counted(v.select(*self.features, self.label, group)))
        return count_predictions(valid, self.features, self.label, group, self.labels, [(m, k) for m in masks for k in range(settings)], lambda part: (design.of(part) @ b > 0).astype(np.int8))


# trees


@dataclass(frozen=True)
class Bins:
    """Features as small codes: code k holds values up to edge k; the last code holds missing ones."""

    features: list[str]
    edges: list[np.ndarray]

    @classmethod
    def of(cls, df: DataFrame, features: list[str], most: int = 32) -> Bins:
        """Edges at exact quantiles, at most ``most`` codes for values."""
        got = exact_quantiles(df, features, [k / most for k in range(1, most)])
        return cls(list(features), [np.unique(np.array([v for v in got[f] if v is not None], dtype=float)) for f in features])

    @property
    def size(self) -> int:
        return max((len(e) for e in self.edges), default=0) + 2

    @property
    def missing(self) -> int:
        return self.size - 1

    def codes(self, b: pd.DataFrame) -> np.ndarray:
        out = np.empty((len(b), len(self.features)), dtype=np.uint8 if self.size <= 256 else np.int16)
        for i, (f, e) in enumerate(zip(self.features, self.edges)):
            x = b[f].to_numpy(dtype=float)
            out[:, i] = np.where(np.isnan(x), self.missing, np.searchsorted(e, x, side="left"))
        return out


@dataclass
class Node:
    """A set of rows: those of the parent whose code of ``feature`` is at most ``code`` (left) or isn't."""

    parent: int = -1
    feature: int = -1
    code: int = -1
    left: bool = True
    missing_left: bool = False

    def holds(self, codes: np.ndarray, missing: int) -> np.ndarray:
        c = codes[:, self.feature]
        goes = c <= self.code
        if self.missing_left:
            goes |= c == missing
        return goes if self.left else ~goes


def members(nodes: list[Node], wanted: list[int], codes: np.ndarray, missing: int) -> dict[int, np.ndarray]:
    """Row numbers of each wanted node; a node's rows are looked for among its parent's only."""
    rows: dict[int, np.ndarray] = {0: np.arange(len(codes))}

    def of(k: int) -> np.ndarray:
        if k not in rows:
            above = of(nodes[k].parent)
            rows[k] = above[nodes[k].holds(codes[above], missing)]
        return rows[k]

    return {k: of(k) for k in wanted}


@dataclass(frozen=True)
class TreeMasks:
    """Classification trees by Gini impurity over binned features; a setting is the largest depth.

    ``balanced`` weighs classes by the inverse of their size. Of equal gains the first feature and the lowest edge win;
    missing values go right. A node is split while its rows differ in class and the gain is above 0.
    """

    depths: tuple[int, ...] = (1, 2, 3, 4, 5, 6, 7)
    bins: int = 32
    balanced: bool = True

    def prepare(self, train: DataFrame, features: list[str], label: str) -> _Trees:
        seen = counted(train.select(*features, label))
        bins = Bins.of(seen, features, self.bins)
        counts = {r.y: r.n for r in seen.groupBy(F.col(label).alias("y")).agg(F.sum(ROWS).alias("n")).collect()}
        labels = sorted(counts)
        total = sum(counts.values())
        weights = np.array([total / (len(labels) * counts[y]) if self.balanced else 1.0 for y in labels])

        def code(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for b in batches:
                if len(b):
                    yield pd.DataFrame({"codes": [r.tobytes() for r in bins.codes(b)], "y": np.searchsorted(np.array(labels), b[label].to_numpy()).astype(np.int32), ROWS: b[ROWS]})

        coded = cut(seen.mapInPandas(code, f"codes binary, y int, {ROWS} long").groupBy("codes", "y").agg(F.sum(ROWS).alias(ROWS)), "codes")
        discard(seen)
        return _Trees(self, bins, coded, features, label, labels, weights, np.array([counts[y] for y in labels], dtype=float))


@dataclass
class _Trees:
    model: TreeMasks
    bins: Bins
    coded: DataFrame
    features: list[str]
    label: str
    labels: list
    weights: np.ndarray
    total: np.ndarray
    nodes: list[Node] = field(default_factory=lambda: [Node()])
    ids: dict[tuple, int] = field(default_factory=dict)
    counts: dict[int, np.ndarray] = field(default_factory=dict)
    splits: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]] = field(default_factory=dict)
    trees: dict[int, dict[int, tuple[int, int] | None]] = field(default_factory=dict)
    held: list = field(default_factory=list)

    def _histograms(self, wanted: list[int]) -> Iterator[tuple[int, np.ndarray]]:
        """(node, counts by feature, code and class) of the nodes, a pass for as many as ``PASS_NUMBERS`` holds."""
        nf, size, k, missing = len(self.features), self.bins.size, len(self.labels), self.bins.missing
        kind = np.uint8 if size <= 256 else np.int16
        per = max(1, PASS_NUMBERS // (nf * size * k))
        for a in range(0, len(wanted), per):
            some, nodes = wanted[a : a + per], self.nodes

            def partial(batches: Iterator[pd.DataFrame]) -> dict[int, np.ndarray]:
                out = {n: np.zeros(nf * size * k) for n in some}
                base = np.arange(nf) * size * k
                for b in batches:
                    for at in range(0, len(b), BLOCK):
                        part = b.iloc[at : at + BLOCK]
                        codes = np.frombuffer(b"".join(part["codes"]), dtype=kind).reshape(len(part), nf)
                        flat = base[None] + codes.astype(np.int64) * k + part["y"].to_numpy()[:, None]
                        count = np.repeat(part[ROWS].to_numpy(dtype=float)[:, None], nf, axis=1)
                        for n, rows in members(nodes, some, codes, missing).items():
                            if len(rows):
                                out[n] += np.bincount(flat[rows].reshape(-1), count[rows].reshape(-1), nf * size * k)
                return {n: v for n, v in out.items() if v.any()}

            got = array_sums(self.coded, partial)
            for n in some:
                yield n, got.get(n, np.zeros(nf * size * k)).reshape(nf, size, k)

    def _split(self, hist: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(gain, code, class counts left) of the best split of each feature."""
        left = np.cumsum(hist, axis=1)[:, :-2]  # neither after the last values nor after missing ones
        whole = hist[0].sum(axis=0)
        if not left.shape[1]:
            return np.full(len(hist), -np.inf), np.zeros(len(hist), dtype=int), np.zeros((len(hist), len(whole)))
        wl, wr = left * self.weights, (whole - left) * self.weights
        purity = lambda w: np.divide((w**2).sum(axis=-1), w.sum(axis=-1), out=np.zeros(w.shape[:-1]), where=w.sum(axis=-1) > 0)
        gain = purity(wl) + purity(wr) - purity(whole * self.weights)
        gain[(left.sum(axis=2) == 0) | ((whole - left).sum(axis=2) == 0)] = -np.inf
        gain = np.round(gain / max((whole * self.weights).sum(), 1e-300), 12)
        code = gain.argmax(axis=1)
        at = np.arange(len(hist))
        return gain[at, code], code, left[at, code]

    def _child(self, node: int, feature: int, code: int, left: bool, counts: np.ndarray) -> int:
        key = (node, feature, code, left)
        if key not in self.ids:
            self.ids[key] = len(self.nodes)
            self.nodes.append(Node(node, feature, code, left))
            self.counts[self.ids[key]] = counts
        return self.ids[key]

    def fit(self, masks: list[int]) -> None:
        """Grows the trees of all masks, a level of all of them at a time."""
        new = [m for m in dict.fromkeys(masks) if m not in self.trees]
        on = {m: np.array([(m >> i) & 1 for i in range(len(self.features))], dtype=bool) for m in new}
        self.counts[0] = self.total
        for m in new:
            self.trees[m] = {}
        front = {0: new} if new else {}
        for _ in range(max(self.model.depths)):
            live = {n: ms for n, ms in front.items() if (self.counts[n] > 0).sum() > 1}
            for n, hist in self._histograms([n for n in live if n not in self.splits]):
                self.splits[n] = self._split(hist)
            front = {}
            for n, ms in live.items():
                gain, code, left = self.splits[n]
                for m in ms:
                    f = int(np.where(on[m], gain, -np.inf).argmax())
                    if not on[m][f] or not gain[f] > 0:
                        continue
                    a = self._child(n, f, int(code[f]), True, left[f])
                    b = self._child(n, f, int(code[f]), False, self.counts[n] - left[f])
                    self.trees[m][n] = (a, b)
                    front.setdefault(a, []).append(m)
                    front.setdefault(b, []).append(m)
            if not front:
                break

    def leaves(self, mask: int, depth: int) -> list[int]:
        """Nodes where rows end in the mask's tree of that depth."""
        out, level = [], [0]
        for _ in range(depth):
            deeper = []
            for n in level:
                split = self.trees[mask].get(n)
                if split:
                    deeper += split
                else:
                    out.append(n)
            level = deeper
        return out + level

    def predicted(self, node: int) -> int:
        """Place of the node's class: the heaviest, of equal ones the first."""
        return int(np.round(self.counts[node] * self.weights, 9).argmax())

    def confusion(self, valid: DataFrame, group: str, masks: list[int]) -> DataFrame:
        """Rows of each class and group are counted per node, in one pass; what a node predicts is known."""
        self.fit(masks)
        wanted = sorted({n for m in masks for d in self.model.depths for n in self.leaves(m, d)})
        nodes, bins, labels, k, label, nf = self.nodes, self.bins, self.labels, len(self.labels), self.label, len(self.features)
        kind = np.uint8 if bins.size <= 256 else np.int16

        def code(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for b in batches:
                if len(b):
                    yield pd.DataFrame({"codes": [r.tobytes() for r in bins.codes(b)], "cell": (places(labels, b[label]) * 2 + b[group].to_numpy(dtype=int)).astype(np.int32), ROWS: b[ROWS]})

        def codes_of(v: DataFrame) -> DataFrame:
            seen = counted(v.select(*self.features, label, group))
            out = cut(seen.mapInPandas(code, f"codes binary, cell int, {ROWS} long").groupBy("codes", "cell").agg(F.sum(ROWS).alias(ROWS)), "codes")
            discard(seen)
            return out

        coded = kept(self.held, valid, codes_of)

        def partial(batches: Iterator[pd.DataFrame]) -> dict[int, np.ndarray]:
            out = np.zeros((len(wanted), 2 * k + 2))
            for b in batches:
                for at in range(0, len(b), BLOCK):
                    part = b.iloc[at : at + BLOCK]
                    codes = np.frombuffer(b"".join(part["codes"]), dtype=kind).reshape(len(part), nf)
                    cell, count = part["cell"].to_numpy(), part[ROWS].to_numpy(dtype=float)
                    for i, rows in enumerate(members(nodes, wanted, codes, bins.missing).values()):
                        out[i] += np.bincount(cell[rows], count[rows], 2 * k + 2)
            return {0: out.reshape(-1)}

        got = array_sums(coded, partial)
        counts = dict(zip(wanted, got[0].reshape(-1, k + 1, 2))) if got else {}
        known, rows = [*self.labels, other_label(self.labels)], []
        for m in masks:
            for s, d in enumerate(self.model.depths):
                cells = np.zeros((k + 1, k, 2), dtype=np.int64)  # class, prediction, group
                for n in self.leaves(m, d):
                    if n in counts:
                        cells[:, self.predicted(n)] += counts[n].astype(np.int64)
                rows += [(stored(m, len(self.features)), int(known[y]), int(known[p]), int(g), int(cells[y, p, g]), s) for y, p, g in zip(*np.nonzero(cells))]
        return valid.sparkSession.createDataFrame(rows, f"mask {mask_type(len(self.features))}, label int, pred int, grp int, n long, setting int")


def evaluate(fitted, valid: DataFrame, features: list[str], group: str, masks: list[int], constraints: Constraints, scorer: str | Callable[..., Column] = "accuracy") -> DataFrame:
    """(mask, setting, size, share, accuracy, f1, fairness, score, loss, satisfied): per mask the setting of highest score, of equal ones the first.

    scorer: accuracy, f1, fairness, or a function of the columns tp, fp, fn, tn that gives one. The constraint on accuracy is
    held against the score.
    """
    m = metrics(fitted.confusion(valid, group, masks), ["mask", "setting"], scorer=scorer)
    best = F.max_by(F.struct("setting", "accuracy", "f1", "fairness", "score"), F.struct("score", -F.col("setting")))
    out = m.groupBy("mask").agg(best.alias("b")).select("mask", "b.*")
    return _with_loss(out, features, constraints, "setting", "score", goal="score")
