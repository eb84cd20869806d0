"""N-gram Jaccard self-join by token-combination prefixes.

A document's set holds hashes of its distinct shingles (tokens), ordered by hash. Two sets as similar as asked
share a token of their prefixes (the first n - ceil(least * n) + 1). Tokens that few documents have in their
prefix are indexed alone. A document whose prefix holds a frequent token is indexed by combinations as well: its
prefix is extended to the whole set, which is dealt into three more hash classes than two linked sets can differ
in, so that three classes at least are equal in both; each class's combination of tokens is a key. Documents that
share a key are candidates, and every link is verified on the whole sets.

Candidates of a key are compared with its smallest document first. Keys whose documents are then not yet one
component are gone through further: their documents outside the key's largest component meet all others in blocks
of bounded size, first as sketches (sizes of token classes), which rule out nearly all documents, then the rest with
whole sets. Blocks give a row per document or component that is joined to another, never pairs.
"""

from __future__ import annotations

import hashlib
import itertools
import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..scratch import cut, discard
from .common import Buckets, connected_components, sorted_groups, table, whole_groups
from .exact_dedup import exact_dedup
from .words import chunks, mix, split_words

SHINGLE, LEAST = 4, 0.85
#: A token in the prefixes of more documents than this is frequent.
FREQUENT = 8
#: Sizes are rounded up to powers of this ratio to fix the number of classes of a combination index.
LADDER = 1.5
#: Token classes whose sizes are a set's sketch: the sketches of linked sets can't differ by more than the sets. With few
#: classes differing tokens cancel out, and sets of some hundred tokens that are far from linked stay plausible.
CLASSES = 512
#: Up to so many classes, empty ones are keys too.
ALL_EMPTY = 64
#: Rows of a star or block that meet in one task, and tokens of a block's side.
BLOCK, BLOCK_TOKENS = 1000, 4_000_000
#: Keys, documents or pairs that a task remembers so as not to tell them again; forgetting only costs rows.
REMEMBERED = 200_000
#: Plausible pairs per document up to which a block's pairs are verified one by one.
FEW = 8
_ODD = np.uint64(0x9E3779B97F4A7C15)
_NO_DOC = np.iinfo(np.int64).min


def shingle_sets(texts: list[bytes], size: int = SHINGLE) -> list[np.ndarray]:
    """Sorted distinct 64-bit shingle hashes of each text, A-Z lower-cased; a text of fewer words is one shingle."""
    w = split_words([t.lower() for t in texts])
    h = w.hashes()
    weights = np.random.default_rng(size).integers(1, 2**62, size, dtype=np.uint64) | np.uint64(1)
    n = len(h) - size + 1
    if n > 0:
        g = h[:n] * weights[0]
        for j in range(1, size):
            g += h[j : n + j] * weights[j]
        g = mix(g)
    out = []
    for a, b in zip(w.first[:-1].tolist(), w.first[1:].tolist()):
        if b - a >= size:
            out.append(np.unique(g[a : b - size + 1]))
        elif b > a:
            out.append(mix(np.array([(h[a:b] * weights[: b - a]).sum() + np.uint64(b - a)], dtype=np.uint64)))
        else:
            out.append(np.zeros(0, dtype=np.uint64))
    return out


def prefix_length(n: int, least: float) -> int:
    return n - math.ceil(round(least * n, 9)) + 1


def class_counts(n: int, least: float) -> list[int]:
    """Numbers of classes under which a set of ``n`` must be indexed: one for each rounded size that the larger of a linked pair can have."""
    steps = range(math.ceil(round(math.log(n, LADDER), 9)), math.ceil(round(math.log(max(n, math.floor(round(n / least, 9))), LADDER), 9)) + 1)
    return [math.floor((1 - least) / (1 + least) * 2 * LADDER**k + 1e-9) + 3 for k in steps]


def combinations(tokens: np.ndarray, least: float) -> np.ndarray:
    """A key for each class of tokens; of empty classes, a key for each three.

    Of the three or more classes that two linked sets have alike, one holds tokens or all are empty in both. With more
    than ``ALL_EMPTY`` classes the second needs nearly every differing token in a class of its own, which is less
    likely (1e-20) than equal hashes of two shingles, and isn't indexed.
    """
    keys = []
    spread = mix(tokens.copy())
    for count in class_counts(len(tokens), least):
        of = (spread >> np.uint64(17)) % np.uint64(count)
        order = np.argsort(of, kind="stable")
        starts = np.flatnonzero(np.r_[True, np.diff(of[order]) > 0])
        full = of[order][starts]
        keys.append(mix(np.add.reduceat(spread[order], starts) + full * _ODD + np.uint64(count)))
        if count <= ALL_EMPTY and len(full) <= count - 3:
            empty = np.setdiff1d(np.arange(count, dtype=np.uint64), full)
            three = np.array(list(itertools.combinations(empty.tolist(), 3)), dtype=np.uint64)
            keys.append(mix(three @ np.array([count**2, count, 1], dtype=np.uint64) * _ODD + np.uint64(count)))
    return np.concatenate(keys)


def _blocks(key: np.ndarray, doc: np.ndarray, buckets: Buckets) -> list[tuple]:
    """Entries dealt to buckets, one compressed block each."""
    place = mix(key.copy()) % np.uint64(buckets.parts * buckets.subs)
    order = np.argsort(place, kind="stable")
    edges = np.r_[0, np.flatnonzero(np.diff(place[order])) + 1, len(order)] if len(order) else [0]
    out = []
    for a, b in zip(edges[:-1], edges[1:]):
        at = order[a:b]
        p = int(place[at[0]])
        out.append((p // buckets.subs, p % buckets.subs, "entries", zstandard.compress(key[at].tobytes() + doc[at].astype("<i8").tobytes(), 1)))
    return out


class Indexer:
    """Turns chunks of sets into blocks of index entries; equal sets of a chunk are indexed once.

    A key that more than ``most`` documents of a chunk have goes to its bucket as a marker only, once per task. With
    ``flag``, its documents are told as flagged, else they travel as members of the key, spread over all tasks: no
    task gets the documents of a hot key.
    """

    def __init__(self, keys_of, buckets: Buckets, most: int, flag: bool):
        self.keys_of, self.buckets, self.most, self.flag = keys_of, buckets, most, flag
        self.marked: set[int] = set()

    def blocks(self, ids: np.ndarray, sets: list[np.ndarray], turn: int) -> list[tuple]:
        seen: set[bytes] = set()
        keys, docs = [], []
        for d, s in zip(ids.tolist(), sets):
            if len(s) and (mark := hashlib.blake2b(s.tobytes(), digest_size=16).digest()) not in seen:
                seen.add(mark)
                k = np.unique(self.keys_of(s))
                keys.append(k)
                docs.append(np.full(len(k), d, dtype=np.int64))
        if not keys:
            return []
        key, doc = np.concatenate(keys), np.concatenate(docs)
        values, inverse, n = np.unique(key, return_inverse=True, return_counts=True)
        many = n[inverse] > self.most
        out = []
        if many.any():
            blob = _long_blob(np.unique(doc[many])) if self.flag else _long_blob(np.r_[key[many].astype(np.int64), doc[many]])
            out.append((turn % self.buckets.parts, 0, "flagged" if self.flag else "hot", blob))
        if len(self.marked) > REMEMBERED:
            self.marked.clear()
        common = np.array([v for v in values[n > self.most].tolist() if v not in self.marked], dtype=np.uint64)
        self.marked.update(common.tolist())
        key, doc = np.r_[key[~many], common], np.r_[doc[~many], np.full(len(common), _NO_DOC)]
        return out + _blocks(key, doc, self.buckets)


def sketch(tokens: np.ndarray) -> bytes:
    """Sizes of the set's token classes, one byte each (larger ones as 255)."""
    return np.minimum(np.bincount(((tokens >> np.uint64(40)) % np.uint64(CLASSES)).astype(np.int64), minlength=CLASSES), 255).astype(np.uint8).tobytes()


def _long_blob(values: np.ndarray) -> bytes:
    return zstandard.compress(values.astype("<i8").tobytes(), 1)


def deal_prefixes(buckets: Buckets, least: float, shingle: int, frequent: int):
    """mapInPandas function: (doc_id, text) -> blocks of prefix tokens, flagged documents, and a row per document's set."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        index = Indexer(lambda s: s[: prefix_length(len(s), least)], buckets, frequent, True)
        rows = ((d, t.encode()) for b in batches for d, t in zip(b["doc_id"].tolist(), b["text"].tolist()))
        for turn, chunk in enumerate(chunks(rows, lambda r: len(r[1]), 1 << 22)):
            chunk.sort(key=lambda r: r[0])
            ids = np.array([r[0] for r in chunk], dtype=np.int64)
            sets = shingle_sets([r[1] for r in chunk], shingle)
            out = index.blocks(ids, sets, turn)
            digests = b"".join(hashlib.blake2b(s.tobytes(), digest_size=16).digest() for s in sets)
            sizes = np.array([len(s) for s in sets], dtype=np.int64)
            sketches = b"".join(map(sketch, sets))
            out.append((turn % buckets.parts, 0, "sets", zstandard.compress(ids.tobytes() + sizes.tobytes() + digests + sketches, 1)))
            yield pd.DataFrame(out, columns=["part", "sub", "kind", "blob"])

    return run


def deal_combinations(buckets: Buckets, least: float, shingle: int, frequent: int):
    """mapInPandas function: blocks of combination keys of the documents (doc_id, text)."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        index = Indexer(lambda s: combinations(s, least), buckets, frequent, False)
        rows = ((d, t.encode()) for b in batches for d, t in zip(b["doc_id"].tolist(), b["text"].tolist()))
        for turn, chunk in enumerate(chunks(rows, lambda r: len(r[1]), 1 << 22)):
            chunk.sort(key=lambda r: r[0])
            out = index.blocks(np.array([r[0] for r in chunk], dtype=np.int64), shingle_sets([r[1] for r in chunk], shingle), turn)
            yield pd.DataFrame(out, columns=["part", "sub", "kind", "blob"])

    return run


def gather(frequent: int):
    """mapInPandas function: sorted blocks -> rows (kind, grp, doc, n, digest, sketch): sets, flagged documents, members of keys.

    Keys with the same documents are one group. A key with more than ``frequent`` documents flags them (0: never).
    A marked key keeps its own name, as its other members travel elsewhere.
    """

    columns = ["kind", "grp", "doc", "n", "digest", "sketch"]

    def frame(kind: str, doc, grp=None, n=None, digest=None, sketches=None) -> pd.DataFrame:
        size = len(doc)
        full = lambda x: [None] * size if x is None else x
        return pd.DataFrame({"kind": [kind] * size, "grp": pd.array(full(grp), dtype="Int64"), "doc": doc, "n": pd.array(full(n), dtype="Int64"), "digest": full(digest), "sketch": full(sketches)}, columns=columns)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        # told and flagged only save rows that are made distinct later, so they may forget
        held, now, told, flagged = [], None, set(), set()

        def flush():
            if not held:
                return
            key, doc = np.concatenate([h[0] for h in held]), np.concatenate([h[1] for h in held])
            held.clear()
            order = np.lexsort((doc, key))
            key, doc = key[order], doc[order]
            same = np.r_[True, (key[1:] != key[:-1]) | (doc[1:] != doc[:-1])]
            key, doc = key[same], doc[same]
            starts = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
            sizes = np.diff(np.r_[starts, len(key)])
            marked = doc[starts] == _NO_DOC
            names = np.add.reduceat(mix(doc.astype(np.uint64)), starts).astype(np.int64)
            if frequent:
                over = (sizes > frequent) | marked
                yield from flag(np.unique(doc[np.repeat(over, sizes) & (doc != _NO_DOC)]))
                use = ~over & (sizes > 1)
            else:
                names[marked] = key[starts[marked]].astype(np.int64)
                use = sizes > 1
            if len(told) > REMEMBERED:
                told.clear()
            pick = []
            for i in np.flatnonzero(use).tolist():
                if (name := int(names[i])) not in told:
                    told.add(name)
                    pick.append(i)
            if pick:
                pick = np.array(pick)
                rows = np.repeat(starts[pick], sizes[pick]) + np.arange(sizes[pick].sum()) - np.repeat(np.cumsum(sizes[pick]) - sizes[pick], sizes[pick])
                grp = np.repeat(names[pick], sizes[pick])
                real = doc[rows] != _NO_DOC
                yield frame("member", doc[rows][real], grp[real])

        def flag(docs):
            if len(flagged) > REMEMBERED:
                flagged.clear()
            if new := set(docs.tolist()) - flagged:
                flagged.update(new)
                yield frame("flagged", list(new))

        for b in batches:
            for part, sub, kind, blob in zip(b["part"], b["sub"], b["kind"], b["blob"]):
                data = zstandard.decompress(blob)
                if kind == "sets":
                    n = len(data) // (32 + CLASSES)
                    sketches = [data[i : i + CLASSES] for i in range(32 * n, len(data), CLASSES)]
                    yield frame("set", np.frombuffer(data, "<i8", n), n=np.frombuffer(data, "<i8", n, 8 * n), digest=[data[i : i + 16] for i in range(16 * n, 32 * n, 16)], sketches=sketches)
                elif kind == "flagged":
                    yield from flag(np.frombuffer(data, "<i8"))
                elif kind == "hot":
                    n = len(data) // 16
                    yield frame("member", np.frombuffer(data, "<i8", n, 8 * n), np.frombuffer(data, "<i8", n))
                else:
                    if (part, sub) != now:
                        yield from flush()
                        now = (part, sub)
                    n = len(data) // 16
                    held.append((np.frombuffer(data, "<u8", n), np.frombuffer(data, "<i8", n, 8 * n)))
        yield from flush()

    return run


_GATHERED = "kind string, grp long, doc long, n long, digest binary, sketch binary"
_BLOCKS = "part int, sub int, kind string, blob binary"


class Bits:
    """A set of ids as a bit map of 16 bits an id: tells ids that aren't in it most of the time, never one that is."""

    #: More ids than this (a map of 4 MB) are joined instead.
    MOST = 1 << 21

    def __init__(self, words: np.ndarray):
        self.words = words

    @staticmethod
    def _at(ids: np.ndarray, size: int) -> np.ndarray:
        return mix(ids.astype(np.int64).astype(np.uint64)) % np.uint64(size)

    def has(self, ids: np.ndarray) -> np.ndarray:
        at = self._at(ids, len(self.words) * 8)
        return (self.words[at >> np.uint64(3)] >> (at & np.uint64(7)).astype(np.uint8)) & 1 == 1

    @classmethod
    def of(cls, ids: DataFrame, rows: int) -> Bits:
        """From the column ``doc``; every task makes a map of its own, and equal bytes are OR-ed in Spark."""
        size = max(1 << 12, 1 << (16 * rows).bit_length())

        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            words = np.zeros(size // 8, dtype=np.uint8)
            for b in batches:
                at = cls._at(b["doc"].to_numpy(), size)
                np.bitwise_or.at(words, at >> np.uint64(3), np.uint8(1) << (at & np.uint64(7)).astype(np.uint8))
            longs = words.view("<i8")
            at = np.flatnonzero(longs)
            yield pd.DataFrame({"at": at, "bits": longs[at]})

        merged = ids.select("doc").mapInPandas(run, "at long, bits long").groupBy("at").agg(F.bit_or("bits").alias("bits")).toPandas()
        words = np.zeros(size // 64, dtype=np.int64)
        words[merged["at"].to_numpy(dtype=np.int64)] = merged["bits"].to_numpy(dtype=np.int64)
        return cls(words.view(np.uint8))


def map_chosen(named: DataFrame, ids: DataFrame, n: int, run, schema: str) -> DataFrame:
    """mapInPandas over the rows (doc_id, text) of the ``n`` documents ``ids`` (doc, distinct), and a few others where a bit map tells them."""
    if n > Bits.MOST:
        return named.join(ids.select(F.col("doc").alias("doc_id")), "doc_id", "left_semi").select("doc_id", "text").mapInPandas(run, schema)
    bits = Bits.of(ids, n)
    # one function, as two chained ones would be two Python workers per task
    return named.select("doc_id", "text").mapInPandas(lambda batches: run(b[bits.has(b["doc_id"].to_numpy())] for b in batches), schema)


def stars(pairs: DataFrame, carried: DataFrame) -> DataFrame:
    """Rows (a, slot, b, carried columns of b), sorted, of distinct pairs a < b; first in each slot comes a itself as b.

    The partners of one document meet it in tasks of at most about ``BLOCK`` of them, so what is carried for it travels
    once per task, and for a partner once per pair.
    """
    wide = pairs.groupBy("a").agg(F.count("*").alias("m")).where(F.col("m") > BLOCK)
    slot = F.when(F.col("m").isNotNull(), F.pmod(F.xxhash64("b", F.lit(7)), F.ceil(F.col("m") / BLOCK))).otherwise(0).cast("int")
    dealt = pairs.join(wide, "a", "left").select("a", "b", slot.alias("slot"))
    hubs = dealt.select("a", "slot").distinct().select("a", F.col("a").alias("b"), "slot")
    return dealt.unionByName(hubs).join(carried.withColumnRenamed("doc", "b"), "b").repartition("a", "slot").sortWithinPartitions("a", "slot", "b")


def star_starts(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Where the rows of a star begin in some rows of ``stars``, and their end."""
    return np.r_[0, np.flatnonzero((a[1:] != a[:-1]) | (b[1:] == a[1:])) + 1, len(a)]


def plausible(pairs: DataFrame, sketches: DataFrame, least: float) -> DataFrame:
    """Pairs (a, b) that sizes and sketches don't rule out: linked sets differ in at most (1 - least) / (1 + least) of both sizes' sum."""
    percent = round(least * 100)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        hub, own, size = None, np.zeros(CLASSES, dtype=np.int16), 0
        for rows in batches:
            if not len(rows):
                continue
            a, b, n = (rows[c].to_numpy(dtype=np.int64) for c in ("a", "b", "n"))
            x = np.frombuffer(b"".join(rows["sketch"]), dtype=np.uint8).reshape(len(rows), CLASSES).astype(np.int16)
            ok = np.zeros(len(rows), dtype=bool)
            edges = star_starts(a, b)
            for lo, hi in zip(edges[:-1].tolist(), edges[1:].tolist()):
                if b[lo] == a[lo]:
                    hub, own, size = a[lo], x[lo], int(n[lo])
                    lo += 1
                if lo < hi and hub == a[lo]:
                    differ = np.abs(x[lo:hi] - own).sum(axis=1, dtype=np.int64)
                    ok[lo:hi] = ((100 + percent) * differ <= (100 - percent) * (n[lo:hi] + size)) & (100 * np.minimum(n[lo:hi], size) >= percent * np.maximum(n[lo:hi], size))
            yield pd.DataFrame({"a": a[ok], "b": b[ok]})

    return stars(pairs.distinct(), sketches).select("a", "slot", "b", "n", "sketch").mapInPandas(run, "a long, b long")


def texts_of(named: DataFrame, ids: DataFrame, keep=cut) -> DataFrame | None:
    """(doc, blob): compressed texts of the documents ``ids`` (doc); None if there are none. ``keep`` writes tables as ``cut`` does."""
    ids = keep(ids.distinct(), "wanted")
    if not (n := ids.count()):
        return None

    def compress(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield pd.DataFrame({"doc": b["doc_id"].to_numpy(dtype=np.int64), "blob": [zstandard.compress(t.encode(), 3) for t in b["text"]]})

    return keep(map_chosen(named, ids, n, compress, "doc long, blob binary").dropDuplicates(["doc"]), "texts")


def verify_stars(pairs: DataFrame, texts: DataFrame, least: float, shingle: int) -> DataFrame:
    """Those pairs (a, b), a < b, whose whole sets are as similar as asked."""
    rows = stars(pairs, texts)
    percent = round(least * 100)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        hub, own = None, np.zeros(0, dtype=np.uint64)
        for b in batches:
            for at in range(0, len(b), 128):
                x = b.iloc[at : at + 128]
                a, other = x["a"].to_numpy(), x["b"].to_numpy()
                sets = shingle_sets([zstandard.decompress(t) for t in x["blob"]], shingle)
                sizes = np.array([len(s) for s in sets])
                shared = np.zeros(len(x), dtype=np.int64)
                total = np.zeros(len(x), dtype=np.int64)
                edges = star_starts(a, other)
                for lo, hi in zip(edges[:-1], edges[1:]):
                    if other[lo] == a[lo]:
                        hub, own = a[lo], sets[lo]
                        lo += 1
                    if lo < hi and hub == a[lo] and len(own):
                        values = np.concatenate(sets[lo:hi])
                        hit = own[np.minimum(np.searchsorted(own, values), len(own) - 1)] == values
                        shared[lo:hi] = np.bincount(np.repeat(np.arange(hi - lo), sizes[lo:hi]), weights=hit, minlength=hi - lo)
                        total[lo:hi] = sizes[lo:hi] + len(own)
                good = (shared > 0) & (100 * shared >= percent * (total - shared))
                yield pd.DataFrame({"a": a[good], "b": other[good]})

    return rows.select("a", "slot", "b", "blob").mapInPandas(run, "a long, b long")


def shared_tokens(left: list[np.ndarray], right: list[np.ndarray], columns: int = 2048) -> np.ndarray:
    """How many tokens each set of ``left`` has in common with each of ``right``: a product of 0/1 matrices, some columns at a time."""
    out = np.zeros((len(left), len(right)), dtype=np.float32)
    values = [np.concatenate(x) for x in (left, right)]
    common = np.intersect1d(*values)
    if not len(common):
        return out
    sides = []
    for v, sets in zip(values, (left, right)):
        row = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
        at = np.minimum(np.searchsorted(common, v), len(common) - 1)
        real = np.flatnonzero(common[at] == v)
        real = real[np.argsort(at[real], kind="stable")]
        sides.append((at[real], row[real], len(sets)))
    for lo in range(0, len(common), columns):
        width = min(columns, len(common) - lo)
        m = []
        for at, row, n in sides:
            a, b = np.searchsorted(at, [lo, lo + width])
            x = np.zeros((n, width), dtype=np.float32)
            x[row[a:b], at[a:b] - lo] = 1
            m.append(x)
        out += m[0] @ m[1].T
    return out


def plausible_in_block(comp: np.ndarray, size: np.ndarray, x: np.ndarray, side: np.ndarray, least: float) -> tuple[np.ndarray, tuple[np.ndarray, np.ndarray] | None]:
    """(which documents have one of another component that sizes and sketches ``x`` don't rule out, the pairs if they are few).

    side: -1 where all pairs of the block count, else 0 and 1, and pairs across count. Few: up to ``FEW`` per document.
    """
    percent = round(least * 100)
    rows, cols = (np.arange(len(comp)),) * 2 if side[0] < 0 else (np.flatnonzero(side == 0), np.flatnonzero(side == 1))
    found = np.zeros(len(comp), dtype=bool)
    pairs, total = [], 0
    y, m, c = x[cols], size[cols], comp[cols]
    for at in range(0, len(rows), 32):
        r = rows[at : at + 32]
        n = size[r][:, None]
        differ = np.abs(x[r][:, None, :] - y[None, :, :]).sum(axis=2, dtype=np.int32)
        ok = ((100 + percent) * differ <= (100 - percent) * (n + m)) & (100 * np.minimum(n, m) >= percent * np.maximum(n, m)) & (comp[r][:, None] != c)
        if side[0] < 0:
            ok &= r[:, None] < cols
        found[r] |= ok.any(axis=1)
        found[cols] |= ok.any(axis=0)
        total += int(ok.sum())
        if total <= FEW * len(comp):
            i, j = np.nonzero(ok)
            pairs.append((r[i], cols[j]))
    few = total <= FEW * len(comp)
    return found, (np.concatenate([p for p, _ in pairs]), np.concatenate([q for _, q in pairs])) if few and pairs else None


def joined_components(comp: np.ndarray, sets: list[np.ndarray], side: np.ndarray, least: float) -> tuple[np.ndarray, np.ndarray]:
    """(component, smallest component that links of the block join it to), for those that are joined; side as above."""
    rows, cols = (np.arange(len(sets)),) * 2 if side[0] < 0 else (np.flatnonzero(side == 0), np.flatnonzero(side == 1))
    percent = round(least * 100)
    shared = shared_tokens([sets[i] for i in rows], [sets[i] for i in cols]).astype(np.int64)
    size = np.array([len(s) for s in sets])
    linked = (shared > 0) & (100 * shared >= percent * (size[rows][:, None] + size[cols][None, :] - shared)) & (comp[rows][:, None] != comp[cols][None, :])
    i, j = np.nonzero(linked)
    names, at = np.unique(comp, return_inverse=True)
    root = np.arange(len(names))
    if len(i):
        u, v = np.unique(np.stack([at[rows[i]], at[cols[j]]]), axis=1)
        while True:
            now = root.copy()
            np.minimum.at(now, u, root[v])
            np.minimum.at(now, v, now[u])
            if (now == root).all():
                break
            root = now
    moved = np.flatnonzero(root != np.arange(len(names)))
    return names[moved], names[root[moved]]


def join_blocks(labelled: DataFrame, sketches: DataFrame, texts_for, least: float, shingle: int, keep=cut) -> DataFrame | None:
    """Links (a, b) between components that share a group: labelled has grp, doc, n (tokens), comp. None where there can't be any.

    In each group, documents outside its largest component meet all others. Both kinds are dealt into parts of at
    most about ``BLOCK`` rows and ``BLOCK_TOKENS`` tokens; each two parts meet in a task of their own. Documents of the
    largest component don't meet each other, so each travels once per part of the rest. Where sketches leave few pairs of
    a block, these are verified as stars are; else its remaining documents meet again with their whole sets. Blocks
    left with the same documents are one.
    """
    sizes = labelled.groupBy("grp", "comp").agg(F.count("*").alias("m"), F.sum("n").alias("t"))
    per = sizes.groupBy("grp").agg(F.count("*").alias("comps"), F.sum("m").alias("m"), F.sum("t").alias("t"), F.max(F.struct("m", "t", "comp")).alias("main")).where("comps > 1")
    count = lambda m, t: F.ceil(F.greatest(m / BLOCK, t / BLOCK_TOKENS)).cast("int")
    one = (F.col("m") <= BLOCK) & (F.col("t") <= BLOCK_TOKENS)
    per = per.select("grp", F.when(~one, F.col("main.comp")).alias("main"), F.when(one, 0).otherwise(count(F.col("main.m"), F.col("main.t"))).alias("p"), F.when(one, 1).otherwise(count(F.col("m") - F.col("main.m"), F.col("t") - F.col("main.t"))).alias("q"))
    rest = F.coalesce(F.col("comp") != F.col("main"), F.lit(True))
    hashed = F.xxhash64("doc", F.lit(3))
    dealt = labelled.join(per, "grp").withColumn("rest", rest).withColumn("own", F.when(F.col("rest"), F.pmod(hashed, F.col("q"))).otherwise(F.pmod(hashed, F.col("p"))).cast("int"))
    upto = lambda n: F.when(n > 0, F.sequence(F.lit(0), n - 1)).otherwise(F.array().cast("array<int>"))
    place = lambda i, j, side: F.struct(i.alias("i"), j.alias("j"), side.cast("int").alias("side"))
    own = F.col("own")
    among = F.transform(upto(F.col("q")), lambda x: place(F.least(x, own), F.greatest(x, own), F.when(x == own, -1).otherwise((x < own).cast("int"))))
    beside = F.transform(upto(F.col("p")), lambda x: place(-1 - x, own, F.lit(1)))
    others = F.transform(upto(F.col("q")), lambda x: place(-1 - own, x, F.lit(0)))
    spread = dealt.withColumn("x", F.explode(F.when(F.col("rest"), F.concat(among, beside)).otherwise(others))).select("grp", "x.i", "x.j", "x.side", "doc", "comp")
    keys = ["grp", "i", "j"]
    rows = spread.join(sketches, "doc").repartition(*keys).sortWithinPartitions(*keys, "doc")

    columns = ["name", "side", "doc", "comp", "other"]

    def blocks_of(batches):
        for g, starts in whole_groups(batches, keys):
            arrays = [g[c].to_numpy() for c in ("doc", "comp", "n", "side")]
            sketched = g["sketch"].tolist()
            for lo, hi in zip(starts[:-1].tolist(), starts[1:].tolist()):
                yield lo, hi, arrays, sketched

    def narrow(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        out, told = [], set()
        for lo, hi, (all_doc, all_comp, all_n, all_side), sketched in blocks_of(batches):
            side = all_side[lo:hi]
            if hi - lo < 2 or side[0] >= 0 and (side == side[0]).all():
                continue
            x = np.frombuffer(b"".join(sketched[lo:hi]), dtype=np.uint8).reshape(hi - lo, CLASSES).astype(np.int16)
            doc, comp = all_doc[lo:hi], all_comp[lo:hi]
            at, pairs = plausible_in_block(comp, all_n[lo:hi], x, side, least)
            if not at.any():
                continue
            if pairs is None:
                name = mix((doc[at] * 4 + side[at]).astype(np.uint64)).sum().astype(np.int64)
                out += zip(itertools.repeat(name), side[at].tolist(), doc[at].tolist(), comp[at].tolist(), itertools.repeat(0))
            else:
                p, q = doc[pairs[0]], doc[pairs[1]]
                if len(told) > REMEMBERED:
                    told.clear()
                new = set(zip(np.minimum(p, q).tolist(), np.maximum(p, q).tolist())) - told
                told.update(new)
                out += [(None, 0, i, 0, j) for i, j in new]
            if len(out) > 10_000:
                yield pd.DataFrame(out, columns=columns).astype({"name": "Int64"})
                out = []
        yield pd.DataFrame(out, columns=columns).astype({"name": "Int64"})

    left = rows.select(*keys, "side", "doc", "comp", "n", "sketch").mapInPandas(narrow, "name long, side int, doc long, comp long, other long")
    left = keep(left.distinct(), "blocks")
    pairs = left.where("name IS NULL").select(F.col("doc").alias("a"), F.col("other").alias("b"))
    blocks = left.where("name IS NOT NULL").select("name", "side", "doc", "comp")
    texts = texts_for(pairs.select(F.explode(F.array("a", "b")).alias("doc")).unionByName(blocks.select("doc")))
    if texts is None:
        return None

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        kept: dict[int, np.ndarray] = {}
        size = 0
        for g in sorted_groups(batches, ["name"]):
            docs = g["doc"].tolist()
            if size > BLOCK_TOKENS:
                kept, size = {}, 0
            new = [(d, t) for d, t in zip(docs, g["blob"]) if d not in kept]
            for (d, _), x in zip(new, shingle_sets([zstandard.decompress(t) for _, t in new], shingle)):
                kept[d] = x
                size += len(x)
            a, b = joined_components(g["comp"].to_numpy(), [kept[d] for d in docs], g["side"].to_numpy(), least)
            if len(a):
                yield pd.DataFrame({"a": b, "b": a})

    met = blocks.join(texts, "doc").repartition("name").sortWithinPartitions("name", "doc")
    joined = met.select("name", "side", "doc", "comp", "blob").mapInPandas(run, "a long, b long")
    return joined.unionByName(verify_stars(pairs, texts, least, shingle)).distinct()


def jaccard_components(docs: DataFrame, least: float = LEAST, shingle: int = SHINGLE, frequent: int = FREQUENT, text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """(doc_id, n_shingles, component_id): a row per row of ``docs``; clashing columns are no matter, others are left out.

    Null and empty texts, and texts without words, have no shingles and link with nothing. A row without an id
    links with nothing and has no component. Ids are taken to be unique; rows that repeat one are one document.
    Texts of any length are read whole; an empty table gives an empty result.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    named = rows.where("doc_id IS NOT NULL")
    buckets = Buckets.of(named, "text")
    made: list[DataFrame] = []

    def keep(df: DataFrame, name: str) -> DataFrame:
        made.append(cut(df, name))
        return made[-1]

    spread = lambda blocks: blocks.repartitionById(buckets.parts, "part").sortWithinPartitions("part", "sub")
    blocks = named.mapInPandas(deal_prefixes(buckets, least, shingle, frequent), _BLOCKS)
    found = keep(spread(blocks).mapInPandas(gather(frequent), _GATHERED), "prefixes")
    members = found.where("kind = 'member'").select("grp", "doc")
    flagged = keep(found.where("kind = 'flagged'").select("doc").distinct(), "flagged")
    if n_flagged := flagged.count():
        more = map_chosen(named, flagged, n_flagged, deal_combinations(buckets, least, shingle, frequent), _BLOCKS)
        combined = keep(spread(more).mapInPandas(gather(0), _GATHERED).select("grp", "doc"), "combinations")
        members = members.unionByName(combined)
    # documents with equal sets are one from here on: the smallest stands for all
    sets = found.where("kind = 'set'").select("doc", "n", F.hex("digest").alias("digest"))
    sets = cut(exact_dedup(sets.where("n > 0"), "digest", "doc", keep="min").select("doc", "n", F.col("keep_id").alias("rep")).distinct(), "sets")
    sketches = found.where("kind = 'set' AND n > 0").select("doc", "n", "sketch").dropDuplicates(["doc"])
    members = members.join(sets.select("doc", "n", "rep"), "doc").select("grp", F.col("rep").alias("doc"), "n").distinct()
    sizes = members.groupBy("grp").agg(F.count("*").alias("size"), F.min("doc").alias("rep")).where("size > 1")
    members = keep(members.join(sizes, "grp").select("grp", "doc", "n", "rep"), "members")
    stars = members.where("doc <> rep").select(F.col("rep").alias("a"), F.col("doc").alias("b"))
    near = keep(plausible(stars, sketches, least), "near")
    texts = texts_of(named, near.select(F.explode(F.array("a", "b")).alias("doc")), keep)
    if texts is None:
        links = near.select("a", "b")
    else:
        links = keep(verify_stars(near, texts, least, shingle), "links")
    comps = connected_components(links)
    labelled = members.join(comps.withColumnRenamed("node", "doc"), "doc", "left").select("grp", "doc", "n", F.coalesce("comp", "doc").alias("comp"))
    new = join_blocks(labelled, sketches, lambda ids: texts_of(named, ids, keep), least, shingle, keep)
    if new is not None:
        comps = connected_components(links.unionByName(keep(new, "links")))
    # what follows reads the sets and the components only
    for t in made:
        discard(t)
    out = sets.join(comps.withColumnRenamed("node", "rep"), "rep", "left").select(F.col("doc").alias("doc_id"), F.col("n").alias("n_shingles"), F.coalesce("comp", "rep").alias("component_id")).dropDuplicates(["doc_id"])
    return rows.select("doc_id").join(out, "doc_id", "left").select("doc_id", F.coalesce("n_shingles", F.lit(0)).cast("long").alias("n_shingles"), F.coalesce("component_id", "doc_id").alias("component_id"))


def op3_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, n_shingles, component_id for every document."""
    return jaccard_components(table(spark, sf_dir, "documents").select("doc_id", "text"))


SQL = {
    "op3_ngram_join": r"""
        WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws FROM documents),
        s AS (SELECT DISTINCT doc_id, hash(array_to_string(ws[i:i + 3], ' ')) AS t
              FROM (SELECT doc_id, ws, unnest(range(1, greatest(len(ws) - 3, least(len(ws), 1)) + 1)) AS i FROM w)),
        n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
        pre AS (SELECT doc_id, n, t FROM (SELECT doc_id, n, t, row_number() OVER (PARTITION BY doc_id ORDER BY t) AS r FROM s JOIN n USING (doc_id)) WHERE r <= n - ceil(0.85 * n) + 1),
        cand AS (SELECT DISTINCT a.doc_id AS a, b.doc_id AS b, a.n AS na, b.n AS nb FROM pre a JOIN pre b ON a.t = b.t AND a.doc_id < b.doc_id AND 100 * a.n >= 85 * b.n AND 100 * b.n >= 85 * a.n),
        pairs AS (SELECT c.a, c.b, any_value(na) AS na, any_value(nb) AS nb, count(*) AS x FROM cand c JOIN s p ON p.doc_id = c.a JOIN s q ON q.doc_id = c.b AND q.t = p.t GROUP BY c.a, c.b),
        link AS (SELECT a, b FROM pairs WHERE 100 * x >= 85 * (na + nb - x)),
        e AS (SELECT a, b FROM link UNION ALL SELECT b, a FROM link),
        reach(x, y) AS (SELECT DISTINCT a, a FROM e UNION SELECT reach.x, e.b FROM reach JOIN e ON e.a = reach.y),
        comp AS (SELECT x AS doc_id, min(y) AS c FROM reach GROUP BY x)
        SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, coalesce(c, d.doc_id) AS component_id
        FROM documents d LEFT JOIN n USING (doc_id) LEFT JOIN comp USING (doc_id)
    """
}
