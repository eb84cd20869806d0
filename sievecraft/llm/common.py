"""Helpers shared by the training-data operators: tables, buckets, groups of sorted rows, connected components."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..scratch import cut, discard

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
LOWER = UPPER.lower()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@dataclass(frozen=True)
class Buckets:
    """How index entries are dealt: to ``parts`` tasks, which go through ``subs`` buckets one after another."""

    parts: int
    subs: int

    @classmethod
    def of(cls, docs: DataFrame, text_col: str, task: int = 1 << 30, bucket: int = 1 << 23) -> Buckets:
        """From the bytes of the texts: at most ``task`` of them per task and ``bucket`` per bucket, on average."""
        total = docs.agg(F.sum(F.octet_length(text_col))).first()[0] or 0
        parts = max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-total // task))
        return cls(parts, max(1, -(-total // (parts * bucket))))


def whole_groups(batches: Iterator[pd.DataFrame], keys: list[str]) -> Iterator[tuple[pd.DataFrame, np.ndarray]]:
    """(rows, where each group starts and the end) from batches that are sorted by ``keys``; no group is in two."""
    rest: list[pd.DataFrame] = []
    for b in batches:
        if not len(b):
            continue
        k = b[keys].to_numpy()
        if rest and (rest[-1][keys].iloc[-1].to_numpy() != k[0]).any():
            last = pd.concat(rest, ignore_index=True)
            yield last, np.array([0, len(last)])
            rest = []
        starts = np.r_[0, np.flatnonzero((k[1:] != k[:-1]).any(axis=1)) + 1]
        if len(starts) > 1:
            done = pd.concat([*rest, b.iloc[: starts[-1]]], ignore_index=True) if rest else b.iloc[: starts[-1]]
            yield done, np.r_[0, starts[1:] + len(done) - starts[-1]]
            rest = []
        rest.append(b.iloc[starts[-1] :])
    if rest:
        last = pd.concat(rest, ignore_index=True)
        yield last, np.array([0, len(last)])


def sorted_groups(batches: Iterator[pd.DataFrame], keys: list[str]) -> Iterator[pd.DataFrame]:
    """The groups of such rows, each a frame."""
    for rows, starts in whole_groups(batches, keys):
        for lo, hi in zip(starts[:-1], starts[1:]):
            yield rows.iloc[lo:hi]


def ascii_lower(col):
    """Lower-case A-Z only."""
    return F.translate(col, UPPER, LOWER)


def connected_components(edges: DataFrame, a: str = "a", b: str = "b", out: str = "comp") -> DataFrame:
    """(node, comp): the smallest node reachable over undirected edges, by alternating star steps.

    Large-star links each node's larger neighbours to its smallest neighbour; small-star does so for the
    smaller ones. Both need one shuffle, keep at most one row per edge, and need about log(n) rounds. The
    minimum of a neighbourhood is a partial aggregate joined back, so a hub never meets in one task: the
    join's exchanges are plain, and adaptive execution splits a skewed hub.
    Self-links and null ends are ignored; nodes without any edge are not in the result.
    """
    edges = edges.select(F.col(a).alias("u"), F.col(b).alias("v")).where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()
    edges = cut(edges, "edges")
    state = None
    while True:
        last = edges
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        # small star: edges u > v now; u and its smaller neighbours all go to the smallest of them
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(F.explode(F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v")), F.struct(F.col("u").alias("u"), F.col("m").alias("v")))).alias("e")).select("e.u", "e.v").where("u <> v").distinct()
        edges = cut(small, "edges")
        discard(last)
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == state:
            break
        state = now
    return edges.groupBy("u").agg(F.min("v").alias("v")).select(F.col("u").alias("node"), F.col("v").alias(out)).unionByName(edges.select(F.col("v").alias("node"), F.col("v").alias(out)).distinct())
