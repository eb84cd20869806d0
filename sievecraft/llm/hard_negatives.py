"""Hard-negative mining with rotated one-bit codes.

Every vector is rotated by a random matrix with orthonormal columns into more dimensions than it has and reduced to the
signs there. Beside its signs it keeps its norm, the norm of the code vector (the signs rotated back) and their
alignment, the part of the vector that lies along the code vector. Of an anchor, whose rotated components are bit planes
of small integers, the product with a code vector is a few popcounts. With the alignment that gives an estimate of
the product with the vector itself; what the estimate misses is the product of two residuals, each at a right
angle to the code vector, and so at most the product of their norms (Cauchy-Schwarz). The interval is certain: pairs
whose interval can't enter a result are dropped, all others are scored in exact integers.

The anchors are a stated set of queries: rows are dealt to parts of bounded size, and every part meets all anchors
block by block.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..scratch import cut
from .centroid_clustering import int_components
from .common import table

#: Rows of a part, about; anchors of a block; rows that a block of anchors meets at once.
PART_ROWS, ANCHORS, ROWS = 1 << 15, 128, 2048
POSITIVES, NEGATIVES = 5, 3
LOWEST = np.iinfo(np.int64).min
_FOUND = "arid long, slot int, score long, id long, rid long"


@dataclass(frozen=True)
class Codes:
    """Signs of rotated vectors. words: 64-bit words of a code; planes: bits of an anchor's rotated components."""

    words: int = 4
    planes: int = 6
    seed: int = 11

    def rotation(self, dim: int) -> np.ndarray:
        """dim x bits; its rows are orthonormal where there are at least as many bits as dimensions, else at most so."""
        bits = max(64 * self.words, -(-dim // 64) * 64)
        q, _ = np.linalg.qr(np.random.default_rng([self.seed, dim]).standard_normal((bits, dim)))
        return np.ascontiguousarray(q.T)

    def encode(self, x: np.ndarray) -> dict[str, np.ndarray]:
        """bits (rows x words), along (alignment over the code vector's norm), code (its squared norm) and rest (norm of the residual) of rows of numbers."""
        r = self.rotation(x.shape[1])
        x = x.astype(np.float64)
        signs = x @ r >= 0
        code = np.where(signs, 1.0, -1.0) @ r.T
        square = np.maximum((code**2).sum(axis=1), 1e-30)
        along = (x * code).sum(axis=1) / square
        rest = np.sqrt(np.maximum((x**2).sum(axis=1) - along**2 * square, 0))
        bits = np.packbits(signs, axis=1, bitorder="little").view(np.uint64)
        return {"bits": bits, "along": along, "code": square, "rest": rest}

    def planes_of(self, x: np.ndarray) -> dict[str, np.ndarray]:
        """Bit planes (planes x rows x words) of the anchors' rotated components, with step, least value, sums and rounding."""
        r = self.rotation(x.shape[1])
        y = x.astype(np.float64) @ r
        low = y.min(axis=1)
        step = np.maximum((y.max(axis=1) - low) / (2**self.planes - 1), 1e-30)
        q = np.clip(np.rint((y - low[:, None]) / step[:, None]), 0, 2**self.planes - 1).astype(np.int64)
        off = np.abs(y - low[:, None] - step[:, None] * q).sum(axis=1)  # a sign times each component's rounding is at most this
        planes = np.stack([np.packbits((q >> k) & 1 > 0, axis=1, bitorder="little").view(np.uint64) for k in range(self.planes)])
        return {"planes": planes, "low": low, "step": step, "sum": q.sum(axis=1).astype(np.float64), "off": off, "norm": (x.astype(np.float64) ** 2).sum(axis=1), "bits": np.full(len(x), float(y.shape[1]))}


def intervals(anchors: dict[str, np.ndarray], rows: dict[str, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """(low, high), anchors x rows: bounds of the integer products, widened for rounding."""
    bits = rows["bits"]
    ones = np.bitwise_count(bits).sum(axis=1, dtype=np.int64).astype(np.float64)
    inside = np.zeros((anchors["planes"].shape[1], len(bits)))
    for k, plane in enumerate(anchors["planes"]):
        for w in range(bits.shape[1]):
            inside += float(1 << k) * np.bitwise_count(plane[:, w, None] & bits[None, :, w])
    # signs . (low + step q) = low (2 ones - bits) + step (2 bits.q - sum q)
    dot = anchors["low"][:, None] * (2 * ones[None] - anchors["bits"][:, None]) + anchors["step"][:, None] * (2 * inside - anchors["sum"][:, None])
    off = anchors["off"][:, None]
    # the anchor's own part at a right angle to the code vector, at its longest for any product in dot +- off
    least = np.maximum(np.abs(dot) - off, 0)
    away = np.sqrt(np.maximum(anchors["norm"][:, None] - least**2 / rows["code"][None], 0))
    middle = rows["along"][None] * dot
    reach = np.abs(rows["along"])[None] * off + rows["rest"][None] * away
    reach += 1e-9 * (np.abs(middle) + reach + np.sqrt(anchors["norm"])[:, None] * rows["rest"][None]) + 1e-6
    return middle - reach, middle + reach


def best(keys: np.ndarray, score: np.ndarray, ids: np.ndarray, rids: np.ndarray, most: int) -> np.ndarray:
    """Places of the ``most`` first of each key by score (higher first), id, row."""
    order = np.lexsort((rids, ids, -score, keys))
    k = keys[order]
    heads = np.flatnonzero(np.r_[True, k[1:] != k[:-1]]) if len(k) else np.zeros(0, dtype=np.int64)
    place = np.arange(len(k)) - np.repeat(heads, np.diff(np.r_[heads, len(k)]))
    return order[place < most]


class Mined:
    """The best of each slot of a block of anchors: what has been scored, and the score that a newcomer must reach."""

    def __init__(self, low: np.ndarray, high: np.ndarray, most: int):
        self.low, self.high, self.most = low, high, most  # anchors x slots: least and largest score of a slot
        self.need = low.copy()
        self.slot = self.score = self.ids = self.rids = np.zeros(0, dtype=np.int64)

    def expect(self, low: np.ndarray, high: np.ndarray, allowed: np.ndarray) -> np.ndarray:
        """Pairs (anchors x rows) that may enter a slot, from their bounds; rows sure to lie in a slot raise what it needs."""
        out = np.zeros(low.shape, dtype=bool)
        for j in range(self.low.shape[1]):
            lo, hi = self.low[:, j, None].astype(np.float64), self.high[:, j, None].astype(np.float64)
            sure = np.where(allowed & (low >= lo) & (high <= hi), low, -np.inf)
            if sure.shape[1] >= self.most:
                kth = np.partition(sure, -self.most, axis=1)[:, -self.most]
                at = np.isfinite(kth)
                self.need[at, j] = np.maximum(self.need[at, j], np.floor(kth[at]).astype(np.int64))
            out |= (lo <= hi) & (low <= hi) & (high >= self.need[:, j, None].astype(np.float64))
        return out & allowed

    def take(self, anchor: np.ndarray, score: np.ndarray, ids: np.ndarray, rids: np.ndarray) -> None:
        """Exactly scored pairs."""
        slots = self.low.shape[1]
        for j in range(slots):
            at = (score >= self.need[anchor, j]) & (score <= self.high[anchor, j])
            self.slot = np.r_[self.slot, anchor[at] * slots + j]
            self.score, self.ids, self.rids = np.r_[self.score, score[at]], np.r_[self.ids, ids[at]], np.r_[self.rids, rids[at]]
        keep = best(self.slot, self.score, self.ids, self.rids, self.most)
        self.slot, self.score, self.ids, self.rids = self.slot[keep], self.score[keep], self.ids[keep], self.rids[keep]
        # best() leaves the slots in order: a full one needs its last score
        count = np.bincount(self.slot, minlength=self.low.size)
        full = np.flatnonzero(count >= self.most)
        last = self.score[np.cumsum(count)[full] - 1]
        self.need.reshape(-1)[full] = np.maximum(self.need.reshape(-1)[full], last)


def scored(a: np.ndarray, x: np.ndarray, at: np.ndarray, row: np.ndarray, block: int = 1 << 14) -> np.ndarray:
    """Integer products of pairs."""
    out = np.empty(len(at), dtype=np.int64)
    for k in range(0, len(at), block):
        out[k : k + block] = np.einsum("ij,ij->i", a[at[k : k + block]], x[row[k : k + block]])
    return out


def _matrix(values, dim: int, kind) -> np.ndarray:
    return np.frombuffer(b"".join(values), dtype=kind).reshape(len(values), dim)


def mine_part(rows: pd.DataFrame, anchors: pd.DataFrame, dim: int, codes: Codes, same: bool, most: int) -> pd.DataFrame:
    """The best of every slot of a block of anchors among the rows of a part.

    rows: rid, id, label (a number per label), x, bits, along, code, rest. anchors: rid, label, x, low, high (their slots' bounds).
    """
    x, a = rows["x"], _matrix(anchors["x"].tolist(), dim, np.int64)
    mined = Mined(np.stack(anchors["low"].to_numpy()), np.stack(anchors["high"].to_numpy()), most)
    planes = codes.planes_of(a)
    label, rid = anchors["label"].to_numpy(), anchors["rid"].to_numpy()
    for k in range(0, len(rows["rid"]), ROWS):
        part = {c: v[k : k + ROWS] for c, v in rows.items()}
        allowed = (label[:, None] == part["label"][None]) == same
        if same:
            allowed &= rid[:, None] != part["rid"][None]
        near = np.flatnonzero(allowed.any(axis=0))
        if not len(near):
            continue
        if len(near) < len(part["rid"]):
            part, allowed = {c: v[near] for c, v in part.items()}, allowed[:, near]
        at, row = np.nonzero(mined.expect(*intervals(planes, part), allowed))
        if len(at):
            mined.take(at, scored(a, part["x"], at, row), part["id"][row], part["rid"][row])
    slots = mined.low.shape[1]
    return pd.DataFrame({"arid": rid[mined.slot // slots], "slot": (mined.slot % slots).astype(np.int32), "score": mined.score, "id": mined.ids, "rid": mined.rids})


def encoded(vectors: DataFrame, codes: Codes, id_col: str, vec_col: str, label: Column, anchor: Column) -> DataFrame:
    """Rows that take part: rid (a number of the row), id, label (a number), anchor, dim, components and code as bytes."""
    ints = vectors.select(F.monotonically_increasing_id().alias("rid"), F.col(id_col).cast("long").alias("id"), label.alias("label"), F.coalesce(anchor, F.lit(False)).alias("anchor"), int_components(F.col(vec_col)).alias("x"))
    ints = ints.where("label IS NOT NULL AND id IS NOT NULL AND size(x) > 0").withColumn("dim", F.size("x"))
    whole = ints.schema["label"].dataType.simpleString() in ("tinyint", "smallint", "int", "bigint")
    ints = ints.withColumn("label", F.col("label").cast("long") if whole else F.xxhash64("label"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for dim, same in b.groupby("dim"):
                x = np.stack([np.asarray(v, dtype=np.int64) for v in same["x"]])
                c = codes.encode(x)
                yield pd.DataFrame({**{k: same[k] for k in ("rid", "id", "label", "anchor")}, "dim": dim, "x": [r.tobytes() for r in x], "bits": [r.tobytes() for r in c["bits"]], "along": c["along"], "code": c["code"], "rest": c["rest"]})

    return cut(ints.mapInPandas(run, "rid long, id long, label long, anchor boolean, dim int, x binary, bits binary, along double, code double, rest double"), "codes")


def mined(rows: DataFrame, anchors: DataFrame, dim_codes: Codes, same: bool, most: int, parts: int) -> DataFrame:
    """(arid, slot, score, id, rid): the best of each part; ``anchors``: rid, label, dim, x, low, high.

    Rows stand before the anchors in their part, so a task holds the rows of its part and some blocks of anchors.
    """
    none = F.array().cast("array<bigint>")
    left = rows.select(F.pmod(F.xxhash64("rid"), F.lit(parts)).cast("int").alias("part"), F.lit(0).alias("turn"), "rid", "id", "label", "dim", "x", "bits", "along", "code", "rest", none.alias("low"), none.alias("high"))
    zero = F.lit(0.0)
    right = anchors.select(F.explode(F.sequence(F.lit(0), F.lit(parts - 1))).alias("part"), F.lit(1).alias("turn"), "rid", F.lit(0).cast("long").alias("id"), "label", "dim", "x", F.lit(b"").alias("bits"), zero.alias("along"), zero.alias("code"), zero.alias("rest"), "low", "high")
    dealt = left.unionByName(right).repartitionById(parts, "part").sortWithinPartitions("part", "turn")

    def arrays(g: pd.DataFrame, dim: int) -> dict[str, np.ndarray]:
        g = g.sort_values(["label", "rid"])
        return {c: g[c].to_numpy() for c in ("rid", "id", "label", "along", "code", "rest")} | {"x": _matrix(g["x"], dim, np.int64), "bits": np.stack([np.frombuffer(v, np.uint64) for v in g["bits"]])}

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now, held, groups, block = None, [], {}, []

        def flush() -> Iterator[pd.DataFrame]:
            if held:
                groups.update({int(dim): arrays(g, int(dim)) for dim, g in pd.concat(held).groupby("dim")})
                held.clear()
            if block:
                for dim, g in pd.concat(block).groupby("dim"):
                    g = g.sort_values(["label", "rid"])  # so a block meets few labels
                    for k in range(0, len(g) if int(dim) in groups else 0, ANCHORS):
                        found = mine_part(groups[int(dim)], g.iloc[k : k + ANCHORS], int(dim), dim_codes, same, most)
                        if len(found):
                            yield found
                block.clear()

        for b in batches:
            for part, g in b.groupby("part"):
                if part != now:
                    yield from flush()
                    held.clear()
                    groups.clear()
                    now = part
                own = g["turn"] == 0
                if own.any():
                    held.append(g[own])
                if not own.all():
                    block.append(g[~own])
                    if sum(map(len, block)) >= 32 * ANCHORS:
                        yield from flush()
        yield from flush()

    return dealt.mapInPandas(run, _FOUND)


def first_of(found: DataFrame, most: int) -> DataFrame:
    """The first ``most`` of each anchor's slot over all parts, with their place (from 1); every task passes on as many at most."""
    order = Window.partitionBy("arid", "slot").orderBy(F.desc("score"), "id", "rid")
    return found.withColumn("place", F.row_number().over(order)).where(F.col("place") <= most)


def hard_negatives(vectors: DataFrame, anchor: Column, label: Column | None = None, positives: int = POSITIVES, negatives: int = NEGATIVES, least: int = 50, most: int = 95, codes: Codes = Codes(), part_rows: int = PART_ROWS, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score): per anchor and positive the first negatives.

    Scores are inner products of the components as floor(256 * x). An anchor's positives are its first ``positives`` other
    rows of its label; negatives are the first ``negatives`` rows of other labels whose score is from ``least`` to
    ``most`` percent of the positive's. Higher scores come first, ties by smaller id. ``anchor`` says which rows are
    anchors, ``label`` is the label column.

    Rows with a null id or label, a null or empty vector, or a component that is null, not finite or of 2^27 / 256 and
    more take no part. Vectors of different lengths never meet. Rows that share an id are rows of their own (ties among
    them by their place in the table), so an anchor's copy is a positive of it. Anchors without a positive, and
    positives without a negative, give no row. Other columns are left out, whatever their names. An empty table gives an
    empty result.
    """
    rows = encoded(vectors, codes, id_col, vec_col, F.col("label") if label is None else label, anchor)
    n = rows.count()
    # small parts use all cores; beyond that they have part_rows rows
    parts = max(1, -(-n // part_rows), min(int(vectors.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-n // 1024)))
    chosen = rows.where("anchor").select("rid", "id", "label", "dim", "x")
    any_score = chosen.select("rid", "label", "dim", "x", F.array(F.lit(LOWEST)).alias("low"), F.array(F.lit(np.iinfo(np.int64).max)).alias("high"))
    near = cut(first_of(mined(rows, any_score, codes, True, positives, parts), positives).select("arid", (F.col("place") - 1).alias("slot"), F.col("score").alias("positive_score"), F.col("id").alias("positive_id")), "positives")
    share = lambda percent: F.col("positive_score").cast("decimal(25,0)") * percent / 100
    bounds = near.groupBy("arid").agg(F.array_sort(F.collect_list(F.struct("slot", F.ceil(share(least)).cast("long").alias("low"), F.floor(share(most)).cast("long").alias("high")))).alias("b"))
    # a row per anchor has a slot per positive; missing ones are empty ranges
    padded = lambda c, fill: F.concat(F.col(f"b.{c}"), F.array_repeat(F.lit(fill).cast("long"), positives - F.size("b")))
    ranges = chosen.join(bounds, chosen["rid"] == bounds["arid"]).select("rid", "label", "dim", "x", padded("low", 1).alias("low"), padded("high", 0).alias("high"))
    far = first_of(mined(rows, ranges, codes, False, negatives, parts), negatives)
    out = far.select("arid", "slot", F.col("place").alias("rank"), F.col("id").alias("negative_id"), F.col("score").alias("negative_score")).join(near, ["arid", "slot"])
    return out.join(chosen.select(F.col("rid").alias("arid"), F.col("id").alias("anchor_id")), "arid").select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")


def op11_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score for the anchors of embeddings."""
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives(table(spark, sf_dir, "embeddings").select("vec_id", "embedding", "label"), F.col("vec_id") % 50 == 0, label)


SQL = {
    "op11_hard_negatives": """
        WITH v AS MATERIALIZED (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
                list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS e FROM embeddings
            WHERE label IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(CAST(x AS DOUBLE)))) = len(embedding)),
        s AS MATERIALIZED (SELECT a.vec_id AS anchor_id, b.vec_id AS id, a.label = b.label AS same,
                CAST(list_sum(list_transform(range(1, len(a.e) + 1), lambda i: a.e[i] * b.e[i])) AS BIGINT) AS score
            FROM v a JOIN v b ON a.vec_id <> b.vec_id AND len(a.e) = len(b.e) WHERE a.vec_id % 50 = 0),
        pos AS (SELECT anchor_id, id AS positive_id, score AS positive_score FROM s WHERE same
            QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, id) <= 5)
        SELECT anchor_id, positive_id, CAST(row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY score DESC, id) AS INTEGER) AS rank,
               id AS negative_id, positive_score, score AS negative_score
        FROM pos JOIN s USING (anchor_id) WHERE NOT same AND 50 * positive_score <= 100 * score AND 100 * score <= 95 * positive_score
        QUALIFY row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY score DESC, id) <= 3
    """
}
