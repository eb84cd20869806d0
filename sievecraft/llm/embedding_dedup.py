"""Embedding near-dedup by Euclidean p-stable hashing.

Normalised vectors are projected on random Gaussian directions; floor((a . v + b) / width) of several
directions together name a bucket, in several tables. Vectors that meet in a bucket are compared by exact
cosine in double precision. Equal vectors are one class from the start, a bucket of many vectors is split into
blocks of bounded size that are compared two by two, and each link is counted in the first table that it meets
in, so no list of pairs ever exists: a block gives counts per vector and a spanning forest of its links.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..scratch import cut
from .common import connected_components, sorted_groups, table
from .exact_dedup import exact_dedup


@dataclass(frozen=True)
class Hashing:
    """width 1 and 12 directions let a pair at cosine 0.98 (distance 0.2) meet in a table with probability 0.12,
    so in one of 32 tables with 0.985; closer pairs meet more often, unrelated ones (distance 1.4) with 1e-7."""

    tables: int = 32
    directions: int = 12
    width: float = 1.0
    seed: int = 17

    def signatures(self, unit: np.ndarray) -> np.ndarray:
        """(vectors x tables) 64-bit bucket names of unit vectors."""
        rng = np.random.default_rng([self.seed, unit.shape[1]])
        a = rng.standard_normal((unit.shape[1], self.tables * self.directions))
        b = rng.uniform(0, self.width, self.tables * self.directions)
        cells = np.floor((unit @ a + b) / self.width).astype(np.int64).reshape(len(unit), self.tables, self.directions)
        weights = rng.integers(1, 2**62, self.directions, dtype=np.int64) | 1
        mixed = (cells * weights).sum(axis=2)
        return mixed ^ (mixed >> 29)


def unit_rows(vectors: pd.Series) -> np.ndarray:
    x = np.stack([np.asarray(v, dtype=np.float64) for v in vectors])
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def links_in_block(ids: np.ndarray, copies: np.ndarray, side: np.ndarray, unit: np.ndarray, signs: np.ndarray, t: int, least: float) -> tuple[np.ndarray, np.ndarray]:
    """(links per row weighted by copies, smallest id reachable inside the block) of one block.

    side: 0 and 1 where the block pairs two parts, so that only links across are counted; -1 where all pairs are.
    """
    linked = unit @ unit.T >= least
    np.fill_diagonal(linked, False)
    if side[0] >= 0:
        linked &= side[:, None] != side[None, :]
    for k in range(t):
        if not linked.any():
            break
        linked &= signs[:, k][:, None] != signs[:, k][None, :]
    counts = linked @ copies
    reach = ids.copy()
    while True:
        least_near = np.where(linked, reach[None, :], np.iinfo(np.int64).max).min(axis=1)
        now = np.minimum(reach, least_near)
        if (now == reach).all():
            return counts, reach
        reach = now


def near_vectors(vectors: DataFrame, least: float = 0.98, hashing: Hashing = Hashing(), block: int = 1500, vec_col: str = "embedding", id_col: str = "vec_id", label_col: str = "label") -> DataFrame:
    """``vectors`` with n_links, component_id and kept added (clashing columns replaced).

    Only vectors with equal labels link. Vectors that are null, empty, zero or hold null or non-finite components,
    and those without a label, link with nothing: n_links 0, own component, kept. So do vectors of different
    lengths with each other. Repeated rows are copies of each other and count as links. Null ids stay null. Rows that
    share an id but not the vector are one vertex of the link graph, each with the links of its own vector. Vectors of
    any length are compared whole; an empty table gives an empty result.
    """
    rows = vectors.select(*[c for c in vectors.columns if c not in ("n_links", "component_id", "kept")])
    v = F.col(vec_col).cast("array<double>")
    sane = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    ok = F.coalesce(F.col(label_col).isNotNull() & F.col(id_col).isNotNull() & sane & F.exists(v, lambda x: x != 0), F.lit(False))
    content = F.concat_ws(":", F.col(label_col).cast("string"), F.array_join(v.cast("array<string>"), ","))
    valid = rows.where(ok).withColumn("__content", content)
    marked = cut(exact_dedup(valid, "__content", id_col, keep="min").select(F.col(id_col).alias("id"), F.col("keep_id").alias("cid"), F.col("group_size").alias("n"), F.col(label_col).cast("string").alias("label"), F.col("text_sha256").alias("sha"), F.when(F.col("kept"), v).alias("v")), "vectors")
    classes = marked.where(F.col("v").isNotNull()).dropDuplicates(["cid", "sha"]).select("cid", F.xxhash64("sha").alias("h"), "n", "label", F.size("v").alias("dim"), "v")
    tables = hashing.tables

    def signs(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for _, same in b.groupby("dim"):
                s = hashing.signatures(unit_rows(same["v"]))
                yield pd.DataFrame({"cid": np.repeat(same["cid"].to_numpy(), tables), "h": np.repeat(same["h"].to_numpy(), tables), "label": np.repeat(same["label"].to_numpy(), tables), "dim": np.repeat(same["dim"].to_numpy(), tables), "t": np.tile(np.arange(tables), len(same)), "s": s.reshape(-1)})

    signed = classes.select("cid", "h", "label", "dim", "v").mapInPandas(signs, "cid long, h long, label string, dim int, t int, s long").select("cid", "h", "t", F.xxhash64("label", "dim", "t", "s").alias("bucket"))
    signed = cut(signed, "signatures")
    shared = signed.groupBy("t", "bucket").agg(F.count("*").alias("m")).where("m > 1")
    # a bucket of m vectors has ceil(m / block) parts; a vector goes to each pair of parts that holds its own
    parts = F.ceil(F.col("m") / block).cast("int")
    own = F.pmod(F.xxhash64("cid", "h", F.lit(5)), F.col("parts")).cast("int")
    met = signed.join(shared, ["t", "bucket"]).withColumn("parts", parts).withColumn("own", own).drop("m")
    pairs = F.transform(F.sequence(F.lit(0), F.col("parts") - 1), lambda p: F.struct(F.least(p, "own").alias("i"), F.greatest(p, "own").alias("j")))
    spread = met.withColumn("p", F.explode(pairs)).select("cid", "h", "t", "bucket", "own", F.col("p.i").alias("i"), F.col("p.j").alias("j"))
    keys = ["t", "bucket", "i", "j"]
    blocks = spread.join(classes.select("cid", "h", "n", "label", "v"), ["cid", "h"]).repartition(*keys).sortWithinPartitions(*keys, "cid")

    def compare(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        out = []
        for g in sorted_groups(batches, keys):
            if len(g) < 2 or g["label"].nunique() > 1 or len({len(x) for x in g["v"]}) > 1:
                # one vector alone, or a clash of bucket names, which is settled by label and length below
                subs = [x for _, x in g.groupby([g["label"], g["v"].map(len)]) if len(x) > 1]
            else:
                subs = [g]
            for x in subs:
                unit = unit_rows(x["v"])
                across = x["i"].iat[0] != x["j"].iat[0]
                side = (x["own"].to_numpy() == x["j"].to_numpy()).astype(int) if across else np.full(len(x), -1)
                counts, reach = links_in_block(x["cid"].to_numpy(), x["n"].to_numpy(), side, unit, hashing.signatures(unit), int(x["t"].iat[0]), least)
                at = counts > 0
                out.append(pd.DataFrame({"cid": x["cid"].to_numpy()[at], "h": x["h"].to_numpy()[at], "links": counts[at], "root": reach[at]}))
            if len(out) > 500:
                yield pd.concat(out)
                out = []
        if out:
            yield pd.concat(out)

    found = cut(blocks.select(*keys, "own", "cid", "h", "n", "label", "v").mapInPandas(compare, "cid long, h long, links long, root long"), "links")
    links = found.groupBy("cid", "h").agg(F.sum("links").alias("links"))
    # an id with several vectors joins their classes
    torn = marked.groupBy("id").agg(F.min("cid").alias("root"), F.max("cid").alias("last")).where("root <> last").select("id", "root")
    comps = connected_components(found.select("cid", "root").unionByName(marked.join(torn, "id").select("cid", "root")), "cid", "root")
    # classes that link with nothing have no row in either
    members = marked.select("id", "cid", "sha", F.xxhash64("sha").alias("h"), "n").distinct().join(links, ["cid", "h"], "left").join(comps.withColumnRenamed("node", "cid"), "cid", "left")
    members = members.select(F.col("id").alias("__id"), F.col("sha").alias("__sha"), (F.col("n") - 1 + F.coalesce("links", F.lit(0))).alias("__links"), F.coalesce("comp", "cid").alias("__comp"))
    out = rows.withColumn("__ok", ok).withColumn("__of", F.when(F.col("__ok"), F.sha2(content, 256)))
    out = out.join(members, (F.col(id_col) == F.col("__id")) & (F.col("__of") == F.col("__sha")), "left")
    # an id may stand both for a sound and an unsound vector
    out = out.withColumn("n_links", F.when(F.col("__ok"), F.col("__links")).otherwise(F.lit(0)).cast("long")).withColumn("component_id", F.when(F.col("__ok"), F.col("__comp")).otherwise(F.col(id_col)))
    return out.drop("__ok", "__of", "__id", "__sha", "__links", "__comp").withColumn("kept", F.coalesce(F.col(id_col) == F.col("component_id"), F.lit(True)))


def op4_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """vec_id, n_links, component_id, kept for every vector of embeddings."""
    return near_vectors(table(spark, sf_dir, "embeddings").select("vec_id", "embedding", "label")).select("vec_id", "n_links", "component_id", "kept")


SQL: dict[str, str] = {}
