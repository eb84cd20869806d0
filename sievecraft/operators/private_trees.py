"""Random trees with differential privacy: splits don't look at the data, leaves tell their majority by the exponential mechanism.

A tree is drawn node by node: each node splits a random feature at a random point of what is left of that feature's domain
there. Every tree gets rows of its own, so each has the whole budget. Trees are small arrays that tasks walk with their rows;
only counts per (tree, leaf, class) leave a task.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .evaluate import count_predictions, places
from .mask_models import array_sums


@dataclass(frozen=True)
class RandomTrees:
    """feature, point: trees x inner nodes, the children of node i being 2 i + 1 (at most the point) and 2 i + 2."""

    feature: np.ndarray
    point: np.ndarray
    depth: int

    @classmethod
    def drawn(cls, domains: list[tuple[float, float]], trees: int, depth: int, seed: int) -> RandomTrees:
        inner = (1 << depth) - 1
        feature, point = np.zeros((trees, inner), dtype=np.int32), np.zeros((trees, inner))
        for t in range(trees):
            rng = np.random.default_rng([seed, t])
            left = {0: list(domains)}
            for i in range(inner):
                own = left.pop(i)
                j = int(rng.integers(len(domains)))
                at = float(rng.uniform(*own[j]))
                feature[t, i], point[t, i] = j, at
                below, above = list(own), list(own)
                below[j], above[j] = (own[j][0], at), (at, own[j][1])
                left[2 * i + 1], left[2 * i + 2] = below, above
        return cls(feature, point, depth)

    def leaf_of(self, tree: np.ndarray, x: np.ndarray) -> np.ndarray:
        """Leaf from 0 of each row in its tree; missing values go above."""
        node, rows = np.zeros(len(x), dtype=np.int64), np.arange(len(x))
        for _ in range(self.depth):
            below = x[rows, self.feature[tree, node]] <= self.point[tree, node]
            node = 2 * node + np.where(below, 1, 2)
        return node - ((1 << self.depth) - 1)


@dataclass(frozen=True)
class PrivateForest:
    """counts: trees x leaves x classes; majority: trees x leaves, places of labels."""

    trees: RandomTrees
    features: list[str]
    labels: list
    counts: np.ndarray
    majority: np.ndarray

    def table(self, spark) -> DataFrame:
        """(tree, leaf, majority, counts), with empty leaves."""
        rows = [(t, k, int(self.labels[self.majority[t, k]]), [int(n) for n in self.counts[t, k]]) for t in range(self.counts.shape[0]) for k in range(self.counts.shape[1])]
        return spark.createDataFrame(rows, "tree int, leaf int, majority int, counts array<long>")

    def vote(self, x: np.ndarray) -> np.ndarray:
        """Place of the label that most trees say; of equal ones the first."""
        votes = np.zeros((len(x), len(self.labels)), dtype=np.int64)
        for t in range(len(self.majority)):
            votes[np.arange(len(x)), self.majority[t, self.trees.leaf_of(np.full(len(x), t), x)]] += 1
        return votes.argmax(axis=1)

    def confusion(self, df: DataFrame, label: str, group: str) -> DataFrame:
        return count_predictions(df, self.features, label, group, self.labels, [((1 << len(self.features)) - 1, 0)], lambda part: self.vote(part[self.features].to_numpy(dtype=float)).astype(np.int8)[:, None])


def exponential_majority(counts: np.ndarray, epsilon: float, draw: float) -> int:
    """Place of the class that the mechanism takes for ``draw`` from 0 to 1.

    The most frequent classes weigh e^(epsilon / 2s), at most e^50, all others 1; s = e^(-lead * epsilon) is the smooth
    sensitivity. An empty leaf takes any class.
    """
    top = np.sort(counts)[::-1]
    power = 0.0 if top[0] < 1 else min(50.0, epsilon / 2 * np.exp(min(700.0, float(top[0] - top[1]) * epsilon)))
    weight = np.where(counts == top[0], np.exp(power), 1.0)
    return int(min(np.searchsorted(np.cumsum(weight) / weight.sum(), draw, side="right"), len(counts) - 1))


def fit_private_trees(df: DataFrame, features: list[str], label: str, domains: dict[str, tuple[float, float]], epsilon: float, trees: int = 8, depth: int = 4, row_id: str = "row_id", seed: int = 7) -> PrivateForest:
    """Trees over the public ``domains`` of the features; a row belongs to one tree, by a hash of its id.

    Labels are those that the table has. Rows without a label are left out.
    """
    labels = sorted(r[0] for r in df.select(label).where(F.col(label).isNotNull()).distinct().collect())
    if len(labels) < 2:
        raise ValueError("private trees take two classes or more")
    drawn = RandomTrees.drawn([domains[f] for f in features], trees, depth, seed)
    leaves, k = 1 << depth, len(labels)

    def partial(batches: Iterator[pd.DataFrame]) -> dict[int, np.ndarray]:
        out = np.zeros(trees * leaves * k, dtype=np.int64)
        for b in batches:
            tree = b["__tree"].to_numpy()
            leaf = drawn.leaf_of(tree, b[features].to_numpy(dtype=float))
            out += np.bincount((tree * leaves + leaf) * k + places(labels, b[label]), minlength=trees * leaves * k)
        return {0: out}

    rows = df.where(F.col(label).isNotNull()).select(*features, label, F.pmod(F.xxhash64(row_id), F.lit(trees)).cast("int").alias("__tree"))
    counts = array_sums(rows, partial).get(0, np.zeros(trees * leaves * k)).reshape(trees, leaves, k)
    draws = np.random.default_rng([seed, trees, depth]).random((trees, leaves))
    majority = np.array([[exponential_majority(counts[t, i], epsilon, draws[t, i]) for i in range(leaves)] for t in range(trees)])
    return PrivateForest(drawn, features, labels, counts.astype(np.int64), majority)
