"""Mask-search strategies. Proposals are a few integers on the driver; scoring a batch of masks is one Spark job."""

from __future__ import annotations

import math
import random
from collections.abc import Iterable
from dataclasses import dataclass, field
from itertools import combinations, islice

from pyspark.sql import DataFrame

from .evaluate import Constraints, evaluate_masks, loaded, mask_type, stored
from .mask_models import GaussianMasks, evaluate

TRIAL_SCHEMA = "seq int, batch int, mask {}, size int, share double, accuracy double, f1 double, fairness double, loss double, satisfied boolean"


@dataclass
class Search:
    """Scores masks in batches, each mask once, and keeps the trials in order."""

    train: DataFrame
    valid: DataFrame
    features: list[str]
    label: str
    group: str
    constraints: Constraints
    trials: dict[int, dict] = field(default_factory=dict)
    batches: int = 0
    model: object = GaussianMasks()  # any of mask_models: what is fitted on a mask, with its grid of settings
    scorer: object = "accuracy"  # by which a setting is chosen and which the constraint on accuracy is about
    fitted: object = None

    @property
    def n(self) -> int:
        return len(self.features)

    @property
    def most(self) -> int:
        """Largest allowed number of features."""
        return self.n if self.constraints.complexity is None else max(1, int(self.constraints.complexity * self.n + 1e-9))

    def score(self, masks: Iterable[int]) -> list[dict]:
        masks = list(dict.fromkeys(masks))
        new = [m for m in masks if m and m not in self.trials]
        if new:
            if self.fitted is None:  # what doesn't depend on the masks is read once
                self.fitted = self.model.prepare(self.train, self.features, self.label)
            rows = evaluate(self.fitted, self.valid, self.features, self.group, new, self.constraints, self.scorer).collect()
            got = {loaded(r["mask"]): r.asDict() | {"mask": loaded(r["mask"])} for r in rows}
            for m in new:
                self.trials[m] = got[m] | {"seq": len(self.trials), "batch": self.batches}
            self.batches += 1
        return [self.trials[m] for m in masks if m]

    @staticmethod
    def best(rows: list[dict]) -> dict:
        return min(rows, key=lambda r: (r["loss"], r["size"], r["mask"]))

    @property
    def done(self) -> bool:
        return any(t["satisfied"] for t in self.trials.values())

    def repair(self, mask: int, rng: random.Random) -> int:
        """Switch off random features until the mask is small enough; an empty one gets a random feature."""
        on = [i for i in range(self.n) if (mask >> i) & 1]
        while len(on) > self.most:
            on.remove(rng.choice(on))
        return sum(1 << i for i in on) or 1 << rng.randrange(self.n)

    def table(self) -> DataFrame:
        names = [c.split()[0] for c in TRIAL_SCHEMA.split(", ")]
        rows = [tuple(stored(t[c], self.n) if c == "mask" else t[c] for c in names) for t in self.trials.values()]
        return self.train.sparkSession.createDataFrame(rows, TRIAL_SCHEMA.format(mask_type(self.n)))

    def answer(self) -> list[str]:
        """Names of the best satisfying mask; none if nothing satisfies."""
        good = [t for t in self.trials.values() if t["satisfied"]]
        mask = self.best(good)["mask"] if good else 0
        return [f for i, f in enumerate(self.features) if (mask >> i) & 1]


def full_set(s: Search) -> None:
    s.score([(1 << s.n) - 1])


def forward(s: Search, floating: bool = False) -> None:
    """Add the best feature each step; floating also drops features while the loss doesn't get worse."""
    now, loss, seen = 0, math.inf, set()
    while bin(now).count("1") < s.most and not s.done:
        best = s.best(s.score(now | 1 << i for i in range(s.n) if not (now >> i) & 1))
        now, loss = best["mask"], best["loss"]
        while floating and bin(now).count("1") > 2 and not s.done:
            down = s.best(s.score(now & ~(1 << i) for i in range(s.n) if (now >> i) & 1))
            if down["loss"] > loss or down["mask"] in seen:
                break
            now, loss = down["mask"], down["loss"]
            seen.add(now)
        if now in seen and not floating:
            break
        seen.add(now)


def backward(s: Search, floating: bool = False) -> None:
    """Remove the feature whose loss is best without it; floating also adds back while that helps."""
    now, seen = (1 << s.n) - 1, set()
    while bin(now).count("1") > 1 and not s.done:
        best = s.best(s.score(now & ~(1 << i) for i in range(s.n) if (now >> i) & 1))
        now, loss = best["mask"], best["loss"]
        while floating and not s.done:
            back = [now | 1 << i for i in range(s.n) if not (now >> i) & 1 and (now | 1 << i) not in seen and (now | 1 << i) != (1 << s.n) - 1]
            if not back or (up := s.best(s.score(back)))["loss"] >= loss:
                break
            now, loss = up["mask"], up["loss"]
        if now in seen:
            break
        seen.add(now)


def exhaustive(s: Search, batch: int = 256) -> None:
    """All masks by size, lexicographic, listed a batch at a time; stops between batches."""
    masks = (sum(1 << i for i in c) for k in range(1, s.most + 1) for c in combinations(range(s.n), k))
    while some := list(islice(masks, batch)):
        s.score(some)
        if s.done:
            break


def ranking_k(s: Search, ranking: list[str]) -> None:
    """The nested masks of the first 1, 2, .. features of a ranking, in one batch."""
    at = [s.features.index(f) for f in ranking]
    s.score(sum(1 << i for i in at[:k]) for k in range(1, s.most + 1))


def ranking_weights(s: Search, rankings: list[dict[str, float]], rounds: int = 4, batch: int = 10, seed: int = 7) -> None:
    """Search over weights of several rankings and the number of features: the k best by the weighted sum of scaled scores.

    Later rounds draw weights and k around those of the best trials so far.
    """
    rng = random.Random(seed)
    scaled = []
    for r in rankings:
        lo, hi = min(r.values()), max(r.values())
        scaled.append({f: (v - lo) / (hi - lo) if hi > lo else 0.0 for f, v in r.items()})
    tried: list[tuple[list[float], int, int]] = []
    for _ in range(rounds):
        best = sorted(tried, key=lambda t: (s.trials[t[2]]["loss"], t[2]))[: max(1, len(tried) // 4)]
        new = []
        for _ in range(batch):
            if best:
                base, k, _ = best[rng.randrange(len(best))]
                weights = [max(0.0, w + rng.gauss(0, 0.2)) for w in base]
                k = min(s.most, max(1, k + rng.choice((-1, 0, 1))))
            else:
                weights, k = [rng.random() for _ in scaled], rng.randint(1, s.most)
            total = {f: sum(w * r[f] for w, r in zip(weights, scaled)) for f in s.features}
            top = sorted(s.features, key=lambda f: (-total[f], f))[:k]
            new.append((weights, k, sum(1 << s.features.index(f) for f in top)))
        s.score([m for _, _, m in new])
        tried += new
        if s.done:
            break


def kbest_tpe(s: Search, ranking: list[str], rounds: int = 4, batch: int = 4, seed: int = 7) -> None:
    """Search over the number k of best features only: k is drawn by how often it lies near the better quarter of trials against the others."""
    rng = random.Random(seed)
    at = [s.features.index(f) for f in ranking]
    mask = lambda k: sum(1 << i for i in at[:k])
    tried: list[int] = []
    for _ in range(rounds):
        left = [k for k in range(1, s.most + 1) if k not in tried]
        if not left or s.done:
            break
        order = sorted(tried, key=lambda k: (s.trials[mask(k)]["loss"], k))
        good, bad = order[: max(1, len(order) // 4)], order[max(1, len(order) // 4) :]
        near = lambda k, ks: (sum(math.exp(-0.5 * ((k - x) / max(1.0, s.most / 6)) ** 2) for x in ks) + 0.1) / (len(ks) + 0.1)
        picked = sorted(left, key=lambda k: (-near(k, good) / near(k, bad), k))[:batch] if tried else rng.sample(left, min(batch, len(left)))
        s.score([mask(k) for k in picked])
        tried += picked


def cross_validated(folds: list[Search], steps: int, backward: bool = False) -> list[tuple[int, int, float]]:
    """(size, mask, mean accuracy) of each step of a forward or backward selection by the mean over folds."""
    n = folds[0].n
    now, rows = (1 << n) - 1 if backward else 0, []
    for _ in range(steps):
        masks = [now ^ 1 << i for i in range(n) if (now >> i) & 1 == backward]
        masks = [m for m in masks if m]
        if not masks:
            break
        scored = [x.score(masks) for x in folds]
        mean = {m: sum(fold[i]["accuracy"] for fold in scored) / len(folds) for i, m in enumerate(masks)}
        now = min(mean, key=lambda m: (-round(mean[m], 9), m))
        rows.append((bin(now).count("1"), now, mean[now]))
    return rows


def rfe(s: Search, importance) -> None:
    """Drop the least important feature each step; ``importance`` gives {feature: score} for a list of features."""
    names = list(s.features)
    while names and not s.done:
        s.score([sum(1 << s.features.index(f) for f in names)])
        if len(names) == 1:
            break
        scores = importance(names)
        names.remove(min(names, key=lambda f: (scores[f], f)))


def tpe_masks(s: Search, rounds: int = 4, batch: int = 12, seed: int = 7) -> None:
    """Rounds of masks drawn bit by bit from how often features are on in the better and the worse quarter of trials."""
    rng = random.Random(seed)
    for _ in range(rounds):
        done = sorted(s.trials.values(), key=lambda t: (t["loss"], t["mask"]))
        cutoff = max(1, len(done) // 4)
        good, bad = [t["mask"] for t in done[:cutoff]], [t["mask"] for t in done[cutoff:]]
        rate = lambda ms, i: (sum((m >> i) & 1 for m in ms) + 1) / (len(ms) + 2)
        draws = []
        for _ in range(batch * 8):
            mask = s.repair(sum((rng.random() < (rate(good, i) if done else 0.5)) << i for i in range(s.n)), rng)
            gain = sum(math.log((rate(good, i) if (mask >> i) & 1 else 1 - rate(good, i)) / (rate(bad, i) if (mask >> i) & 1 else 1 - rate(bad, i))) for i in range(s.n)) if bad else rng.random()
            draws.append((-gain, mask))
        s.score(list(dict.fromkeys(m for _, m in sorted(draws) if m not in s.trials))[:batch])
        if s.done:
            break


def annealing_masks(s: Search, chains: int = 6, steps: int = 6, seed: int = 7) -> None:
    """Parallel chains; a batch per temperature."""
    rng = random.Random(seed)
    now = s.score([s.repair(rng.randrange(1, 1 << s.n), rng) for _ in range(chains)])
    for step in range(steps):
        if s.done:
            break
        heat = 0.1 * 0.6**step
        moved = [s.repair(t["mask"] ^ (1 << rng.randrange(s.n)), rng) for t in now]
        s.score(moved)
        now = [u if u["loss"] <= t["loss"] or rng.random() < math.exp((t["loss"] - u["loss"]) / heat) else t for t, u in zip(now, (s.trials[m] for m in moved))]


def objectives(s: Search, t: dict) -> tuple[float, ...]:
    """What a trial is to have much of: the constrained measures, and few features; accuracy where nothing is constrained."""
    c = s.constraints
    active = [t[n] for n, limit in (("accuracy", c.accuracy), ("fairness", c.fairness)) if limit is not None] or [t["accuracy"]]
    return (*active, -t["share"])


def fronts(points: list[tuple[float, ...]]) -> list[list[int]]:
    """Places of points by non-dominated front."""
    dominates = lambda a, b: all(p >= q for p, q in zip(a, b)) and a != b
    left, out = list(range(len(points))), []
    while left:
        front = [i for i in left if not any(dominates(points[j], points[i]) for j in left)]
        out.append(front)
        left = [i for i in left if i not in front]
    return out


def crowding(points: list[tuple[float, ...]]) -> list[float]:
    """Crowding distance of each point of a front: how far its neighbours are, over all objectives; ends are infinitely far."""
    out = [0.0] * len(points)
    for axis in range(len(points[0]) if points else 0):
        order = sorted(range(len(points)), key=lambda i: points[i][axis])
        width = points[order[-1]][axis] - points[order[0]][axis]
        out[order[0]] = out[order[-1]] = math.inf
        for a, i, b in zip(order, order[1:], order[2:]):
            out[i] += (points[b][axis] - points[a][axis]) / width if width else 0.0
    return out


def nsga2_masks(s: Search, population: int = 10, generations: int = 4, seed: int = 7) -> None:
    """Non-dominated fronts over the active constraints, ties by crowding distance; one-point crossover and bit flips; one batch per generation."""
    rng = random.Random(seed)
    now = list(dict.fromkeys(s.repair(rng.randrange(1, 1 << s.n), rng) for _ in range(population)))
    s.score(now)
    for _ in range(generations):
        if s.done:
            break
        children = []
        for _ in range(population):
            # binary tournaments: ``now`` is ordered by front and crowding
            a, b = (now[min(rng.randrange(len(now)), rng.randrange(len(now)))] for _ in range(2))
            low = (1 << rng.randrange(1, s.n)) - 1 if s.n > 1 else 1
            child = (a & low) | (b & ~low)
            child ^= sum((rng.random() < 1 / s.n) << i for i in range(s.n))
            children.append(s.repair(child, rng))
        s.score(children)
        pool = list(dict.fromkeys([*now, *children]))
        points = [objectives(s, s.trials[m]) for m in pool]
        now = []
        for front in fronts(points):
            far = crowding([points[i] for i in front])
            now += [pool[i] for _, i in sorted(zip(far, front), key=lambda x: (-x[0], s.trials[pool[x[1]]]["loss"], pool[x[1]]))]
        now = now[:population]


def surrogate_masks(s: Search, rounds: int = 3, batch: int = 8, seed: int = 7) -> None:
    """A forest regressor over trials chooses masks: half by predicted loss, half by the spread of its trees.

    They are drawn feature by feature: those whose trials have less loss on average are on more often.
    """
    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.regression import RandomForestRegressor

    rng = random.Random(seed)
    spark = s.train.sparkSession
    s.score([s.repair(rng.randrange(1, 1 << s.n), rng) for _ in range(batch)])
    for _ in range(rounds):
        if s.done or len(s.trials) >= (1 << s.n) - 1:
            break
        bits = [f"b{i}" for i in range(s.n)]
        row = lambda m: [float((m >> i) & 1) for i in range(s.n)]
        to_vec = VectorAssembler(inputCols=bits, outputCol="features")
        data = to_vec.transform(spark.createDataFrame([(t["loss"], *row(m)) for m, t in s.trials.items()], ["label", *bits]))
        model = RandomForestRegressor(numTrees=10, maxDepth=4, seed=seed).fit(data)
        mean = lambda ts: sum(t["loss"] for t in ts) / len(ts) if ts else None
        on, off = ([mean([t for m, t in s.trials.items() if (m >> i) & 1 == bit]) for i in range(s.n)] for bit in (1, 0))
        rate = [0.5 if a is None or b is None or a == b else 0.75 if a < b else 0.25 for a, b in zip(on, off)]
        drawn = [s.repair(sum((rng.random() < rate[i]) << i for i in range(s.n)), rng) for _ in range(200)]
        pool = sorted(set(drawn) - s.trials.keys())
        if not pool:
            break
        asked = to_vec.transform(spark.createDataFrame([(k, *row(m)) for k, m in enumerate(pool)], ["k", *bits]))
        rows = model.transform(asked).select("k", "features", "prediction").collect()
        spread = {pool[r.k]: max(v := [t.predict(r.features) for t in model.trees]) - min(v) for r in rows}
        by_loss = [pool[r.k] for r in sorted(rows, key=lambda r: (r.prediction, pool[r.k]))[: batch // 2]]
        by_spread = sorted(spread, key=lambda m: (-spread[m], m))[: batch // 2]
        s.score([*by_loss, *by_spread])


STRATEGIES = {
    "full_set": full_set,
    "forward": forward,
    "forward_floating": lambda s: forward(s, True),
    "backward": backward,
    "backward_floating": lambda s: backward(s, True),
    "exhaustive": exhaustive,
    "tpe_masks": tpe_masks,
    "annealing_masks": annealing_masks,
    "nsga2_masks": nsga2_masks,
    "surrogate_masks": surrogate_masks,
}


def query(train: DataFrame, valid: DataFrame, test: DataFrame, features: list[str], label: str, group: str, constraints: Constraints, strategy="forward_floating", model=None, scorer="accuracy") -> tuple[list[str], DataFrame]:
    """(names, trials): features of a mask that satisfies the constraints on validation and on test; no names if none does."""
    s = Search(train, valid, features, label, group, constraints)
    plain = model is None and scorer == "accuracy"
    if not plain:
        s.model, s.scorer = model or GaussianMasks(), scorer
    (STRATEGIES[strategy] if isinstance(strategy, str) else strategy)(s)
    good = [t["mask"] for t in sorted(s.trials.values(), key=lambda t: (t["loss"], t["size"], t["mask"])) if t["satisfied"]]
    best = 0
    for i in range(0, len(good), 32):
        some = good[i : i + 32]
        held = (evaluate_masks(train, test, features, label, group, some, constraints) if plain else evaluate(s.fitted, test, features, group, some, constraints, scorer)).collect()
        ok = {loaded(r["mask"]) for r in held if r["satisfied"]}
        if best := next((m for m in some if m in ok), 0):
            break
    names = [f for i, f in enumerate(features) if (best >> i) & 1]
    return names, s.table()
