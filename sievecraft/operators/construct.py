"""Construction searches over the catalog: expand the frontier, score a batch, go on from the best."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import catalog as cg
from .rank import binned, information

#: Named operator spaces: (unary, binary).
SPACES = {
    "division": (cg.UNARY_OPS, {"divide": cg.BINARY_OPS["divide"]}),
    "autofeat": ({"log": "ln({0})", "square": "({0} * {0})", "one_div": "try_divide(1D, {0})", "sqrt": "sqrt(abs({0}))", "abs": "abs({0})", "exp": "exp(least({0}, 50D))"}, {"prod": cg.BINARY_OPS["prod"], "sum": cg.BINARY_OPS["sum"]}),
    "explorekit": ({"minus": "(-{0})", "log": "ln({0})"}, cg.BINARY_OPS),
    "categorical": ({}, {}),
}


def mi_scores(df: DataFrame, candidates: DataFrame, label: str, row_id: str, n: int = 10) -> DataFrame:
    """(key, score): mutual information of each candidate's binned values with the label; one job for the batch."""
    table, names = cg.materialize(df, candidates, [row_id, label])
    cols = [f"c{i}" for i in range(len(names))]
    row = table.agg(*[F.min(c).alias(c) for c in cols]).first()
    known = [(c, k) for c, k in zip(cols, names) if row[c] is not None]
    scored = information(binned(table, [c for c, _ in known], n), [c for c, _ in known], label)
    keys = F.create_map(*[F.lit(x) for pair in known for x in pair])
    return scored.select(F.element_at(keys, F.col("feature")).alias("key"), F.col("mi").alias("score"))


def traverse(df: DataFrame, features: list[str], label: str, row_id: str, how: str = "best", steps: int = 3, space: str = "explorekit") -> DataFrame:
    """(key, complexity, score, step): expand the best, the deepest best, or the best harmonic mean of score and simplicity.

    Each step applies the space's operators to one node (with raw partners for binary ones) and scores all new forms at once.
    """
    spark = df.sparkSession
    unary, binary = SPACES[space]
    catalog = cg.raw_catalog(spark, features)
    scores = {r.key: (r.score, 1, 0) for r in mi_scores(df, catalog, label, row_id).collect()}
    rows = catalog.collect()
    expanded: set[str] = set()
    for step in range(1, steps + 1):
        top = max(s for s, _, _ in scores.values()) or 1.0
        value = {"best": lambda k: (scores[k][0],), "depth": lambda k: (scores[k][2], scores[k][0]), "harmonic": lambda k: (2 * (scores[k][0] / top) / scores[k][1] / ((scores[k][0] / top) + 1 / scores[k][1] + 1e-12),)}[how]
        open_nodes = [r for r in rows if r.key in scores and r.key not in expanded]
        if not open_nodes:
            break
        node = max(open_nodes, key=lambda r: (*value(r.key), r.key))
        expanded.add(node.key)
        one = spark.createDataFrame([node], cg.SCHEMA)
        raw = [r for r in rows if r.op == "raw"]
        pool = spark.createDataFrame(list({r.key: r for r in [*raw, node]}.values()), cg.SCHEMA)
        made = cg.generate_unary(one, node.complexity + 1, unary).unionByName(cg.generate_binary(pool, node.complexity + 2, binary)) if unary else cg.generate_binary(pool, node.complexity + 2, binary)
        made = [r for r in made.collect() if r.key not in scores and node.key in r.parents]
        if not made:
            continue
        got = mi_scores(df, spark.createDataFrame(made, cg.SCHEMA), label, row_id).collect()
        scores |= {r.key: (r.score, next(m.complexity for m in made if m.key == r.key), step) for r in got}
        rows += made
    return spark.createDataFrame([(k, c, float(s), t) for k, (s, c, t) in scores.items()], "key string, complexity int, score double, step int")


def info_gain_greedy(df: DataFrame, features: list[str], label: str, row_id: str, rounds: int = 15, improve: float = 0.01, least: float = 0.00001) -> DataFrame:
    """Rank candidates of one unary round by mutual information; add the first that beats the last by ``improve``; stop below ``least``."""
    catalog = cg.raw_catalog(df.sparkSession, features)
    every = catalog.unionByName(cg.generate_unary(catalog, 2))
    ranked = sorted(((r.score, r.key) for r in mi_scores(df, every, label, row_id).collect()), key=lambda x: (-x[0], x[1]))
    chosen, last = [], None
    for score, key in ranked:
        if len(chosen) >= rounds or score < least:
            break
        if last is None or abs(last - score) >= improve:
            chosen.append((len(chosen) + 1, key, float(score)))
            last = score
    return df.sparkSession.createDataFrame(chosen, "round int, key string, score double")
