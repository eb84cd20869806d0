"""Second-order gradient boosting of trees for two classes, over binned features.

A tree grows level by level. Each level is one job: tasks route their rows by the trees so far and add up gradients and
Hessians per (node, feature, code); of two children only the smaller is added up, the other is the parent
minus it. Where every tree sees all rows, rows with equal codes and class are one row with their number. The driver sees histograms, never rows. Margins of finished trees are written beside the rows every
few trees, so a pass routes rows through few of them.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..scratch import ROWS, counted, cut, discard
from .evaluate import count_predictions
from .mask_models import BLOCK, Bins, Node, array_sums, members

#: Trees whose margins are added up again in every pass, before they are written beside the rows.
REFRESH = 8


@dataclass(frozen=True)
class Boosting:
    """rows, columns: shares of rows and features that a tree sees; ``penalty`` (lambda) is added to Hessian sums, ``least_gain`` (gamma) is taken off each split."""

    trees: int = 100
    depth: int = 6
    rate: float = 0.3
    penalty: float = 1.0
    least_gain: float = 0.0
    least_child: float = 1.0
    rows: float = 1.0
    columns: float = 1.0
    bins: int = 32
    seed: int = 0


@dataclass
class Tree:
    nodes: list[Node]
    split: dict[int, tuple[int, int]]
    value: dict[int, float]

    def margins(self, codes: np.ndarray, missing: int) -> np.ndarray:
        out = np.zeros(len(codes))
        for n, rows in members(self.nodes, list(self.value), codes, missing).items():
            out[rows] = self.value[n]
        return out


@dataclass
class Boosted:
    settings: Boosting
    bins: Bins
    labels: list
    trees: list[Tree]

    def margins(self, rows: pd.DataFrame) -> np.ndarray:
        codes = self.bins.codes(rows)
        return sum((t.margins(codes, self.bins.missing) for t in self.trees), np.zeros(len(rows)))

    def confusion(self, df: DataFrame, features: list[str], label: str, group: str, mask: int, setting: int = 0) -> DataFrame:
        return count_predictions(counted(df.select(*features, label, group)), features, label, group, self.labels, [(mask, setting)], lambda part: (self.margins(part) > 0).astype(np.int8)[:, None])

    def score(self, df: DataFrame, out: str = "probability") -> DataFrame:
        """``df`` with the probability of the larger label."""
        names = self.bins.features

        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for b in batches:
                yield b.assign(**{out: 1 / (1 + np.exp(-self.margins(b[names])))})

        kept = [f for f in df.schema if f.name != out]
        return df.select(*[f"`{f.name}`" for f in kept]).mapInPandas(run, ", ".join([*[f"`{f.name}` {f.dataType.simpleString()}" for f in kept], f"`{out}` double"]))


def best_split(hist: np.ndarray, columns: np.ndarray, s: Boosting) -> tuple[float, int, int, bool, np.ndarray] | None:
    """(gain, feature, code, missing left, sums left) of a node's best split; None where none has a gain.

    hist: features x codes x (gradient, Hessian), missing values last. The gain is half of GL^2 / (HL + lambda) +
    GR^2 / (HR + lambda) - G^2 / (H + lambda), less gamma. Of equal gains the first feature, then missing values to the right,
    then the lowest code win.
    """
    whole = hist[0].sum(axis=0)
    left = np.cumsum(hist[:, :-1], axis=1)
    sides = np.stack([left, left + hist[:, -1:]], axis=1)  # features x (missing right, left) x codes
    part = lambda x: x[..., 0] ** 2 / (x[..., 1] + s.penalty)
    gain = 0.5 * (part(sides) + part(whole - sides) - part(whole)) - s.least_gain
    light = np.minimum(sides[..., 1], (whole - sides)[..., 1])
    gain[(light < s.least_child - 1e-9) | (light <= 1e-12)] = -np.inf
    gain[~columns] = -np.inf
    gain = np.round(gain, 9)
    f, side, code = np.unravel_index(gain.argmax(), gain.shape)
    return (float(gain[f, side, code]), int(f), int(code), bool(side), sides[f, side, code]) if gain[f, side, code] > 0 else None


def _spread(ids: np.ndarray, seed: int) -> np.ndarray:
    """A number from 0 to 1 of each row id, another for each seed."""
    x = ids.astype(np.int64).view(np.uint64) + np.uint64((seed * 0x9E3779B97F4A7C15 + 0x632BE59BD9B4E019) % (1 << 64))
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return (x ^ (x >> np.uint64(31))).astype(np.float64) / 2.0**64


def fit_boosting(train: DataFrame, features: list[str], label: str, settings: Boosting = Boosting(), row_id: str | None = None) -> Boosted:
    """Boosted trees on the log-loss of two classes, from margin 0.

    Missing values of a feature go to the side that gains more. ``row_id`` decides which rows a tree sees; without one,
    a hash of the row does. A tree that can't split is one leaf.
    """
    s, bins = settings, Bins.of(train, features, settings.bins)
    labels = sorted(r[0] for r in train.select(label).where(F.col(label).isNotNull()).distinct().collect())
    if len(labels) != 2:
        raise ValueError(f"boosting takes two classes, got {len(labels)}")
    nf, size, missing, kind = len(features), bins.size, bins.missing, np.uint8 if bins.size <= 256 else np.int16

    def code(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            if len(b):
                yield pd.DataFrame({"id": b["__id"] if s.rows < 1 else 0, "codes": [r.tobytes() for r in bins.codes(b)], "y": (b[label].to_numpy() == labels[1]).astype(np.int32), "margin": 0.0})

    name = F.xxhash64(row_id) if row_id else F.xxhash64(*features, label)
    coded = counted(train.where(F.col(label).isNotNull()).select(*features, label, name.alias("__id")).mapInPandas(code, "id long, codes binary, y int, margin double"), "boosting")
    done, fresh = [], []

    def blocks(batches: Iterator[pd.DataFrame]) -> Iterator[tuple[pd.DataFrame, np.ndarray, np.ndarray]]:
        """(rows, codes, margins by all trees so far)"""
        for b in batches:
            for at in range(0, len(b), BLOCK):
                part = b.iloc[at : at + BLOCK]
                codes = np.frombuffer(b"".join(part["codes"]), dtype=kind).reshape(len(part), nf)
                yield part, codes, part["margin"].to_numpy() + sum((t.margins(codes, missing) for t in fresh), np.zeros(len(part)))

    def histograms(nodes: list[Node], wanted: list[int], k: int) -> dict[int, np.ndarray]:
        def partial(batches: Iterator[pd.DataFrame]) -> dict[int, np.ndarray]:
            out = {n: np.zeros((2, nf * size)) for n in wanted}
            for part, codes, margin in blocks(batches):
                if s.rows < 1:
                    seen = _spread(part["id"].to_numpy(), s.seed * 100_003 + k) < s.rows
                    part, codes, margin = part[seen], codes[seen], margin[seen]
                p = 1 / (1 + np.exp(-margin))
                n = part[ROWS].to_numpy(dtype=float)
                g, h = n * (p - part["y"].to_numpy()), n * p * (1 - p)
                flat = np.arange(nf)[None] * size + codes
                for n, rows in members(nodes, wanted, codes, missing).items():
                    if len(rows):
                        cells = flat[rows].reshape(-1)
                        out[n][0] += np.bincount(cells, np.repeat(g[rows], nf), nf * size)
                        out[n][1] += np.bincount(cells, np.repeat(h[rows], nf), nf * size)
            return out

        got = array_sums(coded, partial)
        zero = np.zeros(2 * nf * size)
        return {n: np.moveaxis(got.get(n, zero).reshape(2, nf, size), 0, 2) for n in wanted}

    for k in range(s.trees):
        rng = np.random.default_rng([s.seed, k])
        columns = np.zeros(nf, dtype=bool)
        columns[rng.permutation(nf)[: max(1, round(s.columns * nf))]] = True
        tree = Tree([Node()], {}, {})
        sums: dict[int, np.ndarray] = {}
        front = {0: histograms(tree.nodes, [0], k)[0]}
        sums[0] = front[0][0].sum(axis=0)
        for level in range(s.depth):
            pairs = []
            for n, hist in front.items():
                found = best_split(hist, columns, s)
                if found is None:
                    continue
                _, f, c, side, left = found
                children = (len(tree.nodes), len(tree.nodes) + 1)
                tree.nodes += [Node(n, f, c, True, side), Node(n, f, c, False, side)]
                tree.split[n] = children
                sums[children[0]], sums[children[1]] = left, sums[n] - left
                pairs.append((n, *children))
            if not pairs or level == s.depth - 1:
                break
            # only the child of smaller Hessian is added up; its sibling is what is left of the parent
            small = {n: min((a, b), key=lambda c: (sums[c][1], c)) for n, a, b in pairs}
            got = histograms(tree.nodes, list(small.values()), k)
            parents, front = front, {}
            for n, a, b in pairs:
                front[small[n]] = got[small[n]]
                front[a + b - small[n]] = parents[n] - got[small[n]]
        tree.value = {n: -s.rate * sums[n][0] / (sums[n][1] + s.penalty) for n in range(len(tree.nodes)) if n not in tree.split}
        done.append(tree)
        fresh.append(tree)
        if len(fresh) == REFRESH and k + 1 < s.trees:
            old = coded

            def add(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
                for part, _, margin in blocks(batches):
                    yield part.assign(margin=margin)

            coded = cut(coded.mapInPandas(add, coded.schema), "boosting")
            discard(old)
            fresh = []
    discard(coded)
    return Boosted(s, bins, labels, done)


@dataclass(frozen=True)
class BoostingMasks:
    """Boosting as a model of masks; every mask and setting is a fit of its own."""

    grid: tuple[Boosting, ...] = (Boosting(),)

    def prepare(self, train: DataFrame, features: list[str], label: str) -> _Grid:
        return _Grid(self.grid, train, features, label)


@dataclass(frozen=True)
class _Grid:
    grid: tuple[Boosting, ...]
    train: DataFrame
    features: list[str]
    label: str

    def confusion(self, valid: DataFrame, group: str, masks: list[int]) -> DataFrame:
        out = None
        for mask in masks:
            names = [f for i, f in enumerate(self.features) if (mask >> i) & 1]
            for k, s in enumerate(self.grid):
                one = fit_boosting(self.train, names, self.label, s).confusion(valid, self.features, self.label, group, mask, k)
                out = one if out is None else out.unionByName(one)
        return out
