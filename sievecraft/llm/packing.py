"""Best-fit packing by exact-complement hashing.

Documents become token pieces in one distributed pass. The planner sees only how many pieces there are of each
length (at most ``capacity`` numbers, whatever the corpus): for each length it looks up single, pair and triple
length sums that fill the gap exactly and consumes them in bulk under the availability counts; what is left is
packed best-fit, longest first, again in bulk. The plan maps the rank of a piece among those of its length to a
sequence and offset, and is applied to all pieces in parallel.
"""

from __future__ import annotations

import json
import os
import re
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..scratch import cut
from .common import table

CAPACITY = 2048
#: Id that ends every document.
SEPARATOR = 0


def tokenizer_path(name: str) -> str:
    """A path as it is; a bare name is looked up among the installed public tokenizers."""
    if os.path.isabs(name):
        return name
    import public_tokenizers

    return public_tokenizers.path(name)


def byte_ranks(path: str) -> tuple[dict[bytes, int], dict[str, int], str] | None:
    """(token bytes -> id, added tokens -> id, split pattern) of a byte-level BPE file whose merges come in the order of their ids.

    None for other files, and for added tokens that take in what stands around them, hold spaces or start one another.
    """
    with open(path, encoding="utf-8") as f:
        data = json.load(f)
    model, pre = data["model"], data.get("pre_tokenizer") or {}
    plain = model.get("type") == "BPE" and pre.get("type") == "ByteLevel" and not pre.get("add_prefix_space") and pre.get("use_regex", True) and not data.get("normalizer") and not model.get("ignore_merges")
    added = {t["content"]: t["id"] for t in data.get("added_tokens", [])}
    alone = not any(t.get("lstrip") or t.get("rstrip") or t.get("single_word") or re.search(r"\s", t["content"]) for t in data.get("added_tokens", []))
    if not plain or not alone or any(x != y and x.startswith(y) for x in added for y in added):
        return None
    # printable stand-ins of bytes: those that are printable themselves, the others from 256 on
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    byte_of = {chr(c): c for c in own} | {chr(256 + i): c for i, c in enumerate(c for c in range(256) if c not in own)}
    ranks = {bytes(byte_of[c] for c in t): i for t, i in model["vocab"].items() if t not in added}
    merged = [model["vocab"]["".join(m if isinstance(m, list) else m.split(" "))] for m in model["merges"]]
    if merged != sorted(merged) or len(merged) + 256 != len(ranks):
        return None
    return ranks, added, r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


class ByteBpe:
    """ids of whole texts as the tokenizers library gives them, with a bounded memory of space-led pieces.

    Strings of added tokens in a text become those tokens, as the library's default has it. The byte-level pattern
    never joins a non-space character with a space behind it, so a text may be cut before every space that follows a
    non-space and its pieces encoded on their own. Other texts are encoded whole. Where the file's merges come in the
    order of their ids, tiktoken gives the same ids from the same file faster.
    """

    SPACES = re.compile(r"\s ")

    def __init__(self, name: str, most: int = 200_000, longest: int = 64):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        path = tokenizer_path(name)
        self.whole, self.added = False, ()
        if got := byte_ranks(path):
            import tiktoken

            ranks, added, pattern = got
            encoding = tiktoken.Encoding(name, pat_str=pattern, mergeable_ranks=ranks, special_tokens=added)
            self._ids = encoding.encode_ordinary
            self.added = tuple(added)
            self._ids_with_added = lambda t: encoding.encode(t, allowed_special="all", disallowed_special=())
        else:
            tokenizer = Tokenizer.from_file(path)
            added = [t.content for t in tokenizer.get_added_tokens_decoder().values()]
            self.whole = any(re.search(r"\s", t) for t in added) or any(t.lstrip or t.rstrip for t in tokenizer.get_added_tokens_decoder().values())
            self._ids = lambda t: tokenizer.encode(t, add_special_tokens=False).ids
        self.cache: dict[str, bytes] = {}
        self.most, self.longest = most, longest

    def _encode(self, text: str) -> bytes:
        return array("I", self._ids(text)).tobytes()

    def _piece(self, piece: str) -> bytes:
        got = self._encode(f" {piece}")
        if len(piece) <= self.longest:
            self.cache[piece] = got
        return got

    def encode(self, text: str) -> bytes:
        """Little-endian unsigned 32-bit ids."""
        if any(a in text for a in self.added):
            return array("I", self._ids_with_added(text)).tobytes()
        if self.whole or self.SPACES.search(text):
            return self._encode(text)
        if len(self.cache) > self.most:
            self.cache.clear()
        head, *pieces = text.split(" ")
        known, piece = self.cache, self._piece
        return self._encode(head) + b"".join([known[p] if p in known else piece(p) for p in pieces])


def pieces_of(docs: DataFrame, tokenizer: str = "byte_bpe_50k.json", capacity: int = CAPACITY, text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32): every document's ids and a separator, cut where it is too long."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        bpe = ByteBpe(tokenizer)
        end = np.array([SEPARATOR], dtype="<u4").tobytes()
        for b in batches:
            for at in range(0, len(b), 256):
                rows = []
                for doc, text in zip(b[id_col].iloc[at : at + 256].tolist(), b["__text"].iloc[at : at + 256].tolist()):
                    got = bpe.encode(text) + end
                    n = len(got) // 4
                    first = n - (-(-n // capacity) - 1) * capacity
                    for k, (lo, hi) in enumerate(zip([0, *range(first, n, capacity)], [*range(first, n, capacity), n])):
                        rows.append((doc, k, lo, hi - lo, zlib.crc32(got[4 * lo : 4 * hi])))
                yield pd.DataFrame(rows, columns=["doc_id", "piece", "start", "length", "ids_crc32"]).astype({"doc_id": "Int64"})

    return docs.select(F.col(id_col).cast("long").alias(id_col), F.coalesce(F.col(text_col), F.lit("")).alias("__text")).mapInPandas(run, "doc_id long, piece int, start long, length long, ids_crc32 long")


def exact_fills(counts: np.ndarray, length: int, capacity: int) -> tuple[int, ...] | None:
    """One to three available lengths that fill the gap beside ``length`` exactly; fewest first, then the largest."""
    gap = capacity - length
    left = counts.copy()
    left[length] -= 1
    if gap == 0:
        return ()
    if left[gap] > 0:
        return (gap,)

    def pair(total: int, left: np.ndarray) -> tuple[int, int] | None:
        if total < 2:
            return None
        small = np.arange(1, total // 2 + 1)
        ok = (left[small] > 0) & (left[total - small] > 0)
        if total % 2 == 0:
            ok[-1] = left[total // 2] > 1
        at = int(np.argmax(ok)) if ok.any() else -1
        return None if at < 0 else (total - int(small[at]), int(small[at]))

    if two := pair(gap, left):
        return two
    for a in np.flatnonzero(left[: gap - 1])[::-1]:  # the largest of three first
        left[a] -= 1
        if two := pair(gap - int(a), left):
            return (int(a), *two)
        left[a] += 1
    return None


def plan_packing(counts: np.ndarray, capacity: int = CAPACITY) -> list[tuple[tuple[int, ...], int]]:
    """[(lengths of a sequence, how many such sequences)] for counts[length]; uses every piece once.

    Every step uses up a length or a kind of open sequence, so the plan's size depends on the capacity alone.
    """
    counts = counts.astype(np.int64).copy()
    plan: list[tuple[tuple[int, ...], int]] = []
    rest = np.zeros_like(counts)
    for length in range(capacity, 0, -1):
        while counts[length] > 0:
            fill = exact_fills(counts, length, capacity)
            if fill is None:
                break
            use = (length, *fill)
            times = min(int(counts[x]) // use.count(x) for x in set(use))
            for x in use:
                counts[x] -= times
            plan.append((use, times))
        rest[length], counts[length] = counts[length], 0
    kinds: dict[int, list[list]] = {}  # gap -> [[lengths, how many]]
    for length in range(capacity, 0, -1):
        n = int(rest[length])
        while n:
            gap = min((g for g in kinds if g >= length), default=None)
            if gap is None:
                each = capacity // length
                if n >= each:
                    kinds.setdefault(capacity - each * length, []).append([(length,) * each, n // each])
                if n % each:
                    kinds.setdefault(capacity - n % each * length, []).append([(length,) * (n % each), 1])
                break
            kind = kinds[gap][-1]
            times = min(n, kind[1])
            n -= times
            kind[1] -= times
            if not kind[1]:
                kinds[gap].pop()
                if not kinds[gap]:
                    del kinds[gap]
            kinds.setdefault(gap - length, []).append([(*kind[0], length), times])
    return plan + [(tuple(k), n) for ks in kinds.values() for k, n in ks]


def plan_slots(plan: list[tuple[tuple[int, ...], int]]) -> dict[int, np.ndarray]:
    """length -> rows (first rank, base sequence, how many of it in a sequence, offset of the first), by rank."""
    cursor: dict[int, int] = {}
    slots: dict[int, list] = {}
    base = 0
    for use, times in plan:
        at = 0
        for x in sorted(set(use), reverse=True):
            m = use.count(x)
            slots.setdefault(x, []).append((cursor.get(x, 0), base, m, at))
            cursor[x] = cursor.get(x, 0) + m * times
            at += m * x
        base += times
    return {x: np.array(rows, dtype=np.int64) for x, rows in slots.items()}


def pack(docs: DataFrame, tokenizer: str = "byte_bpe_50k.json", capacity: int = CAPACITY, text_col: str = "text", id_col: str = "doc_id", bucket_rows: int = 1000) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32, sequence_id, offset): every piece with its place.

    Null texts count as empty; an empty text still has its separator, so it is one piece of length 1. Texts of any
    length are encoded whole and cut into pieces. Repeated rows and null ids are packed like any other row; an empty
    table gives an empty result; other columns are left out.

    Pieces of one length are ranked in buckets of about ``bucket_rows``, dealt by hash, and shifted by the buckets
    before, so one very common length isn't gathered in a task. The sums that are broadcast for it are at most
    100,000 and one per length, as buckets grow beyond that.
    """
    pieces = cut(pieces_of(docs, tokenizer, capacity, text_col, id_col), "pieces")
    counts = np.zeros(capacity + 1, dtype=np.int64)
    for r in pieces.groupBy("length").agg(F.count("*").alias("n")).collect():
        counts[r.length] = r.n
    each = max(bucket_rows, int(counts.sum()) // 100_000)
    buckets = F.lit((-(-counts // each)).astype(np.int32).clip(1))
    pieces = pieces.withColumn("bucket", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), F.element_at(buckets, F.col("length").cast("int") + 1)).cast("int"))
    sums = pieces.groupBy("length", "bucket").agg(F.count("*").alias("n"))
    before = sums.withColumn("before", F.sum("n").over(W.partitionBy("length").orderBy("bucket")) - F.col("n")).drop("n")
    slots = plan_slots(plan_packing(counts, capacity))
    local = F.row_number().over(W.partitionBy("bucket", "length").orderBy("doc_id", "piece", "ids_crc32")) - 1
    ranked = pieces.withColumn("local", local).join(F.broadcast(before), ["length", "bucket"]).withColumn("rank", F.col("local") + F.col("before"))

    def place(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            length, rank = b["length"].to_numpy(), b["rank"].to_numpy()
            seq, off = np.zeros(len(b), dtype=np.int64), np.zeros(len(b), dtype=np.int64)
            for x in np.unique(length):
                mine = np.flatnonzero(length == x)
                s = slots[int(x)]
                row = s[np.searchsorted(s[:, 0], rank[mine], side="right") - 1]
                q = rank[mine] - row[:, 0]
                seq[mine] = row[:, 1] + q // row[:, 2]
                off[mine] = row[:, 3] + q % row[:, 2] * x
            yield b.drop(columns=["rank"]).assign(doc_id=b["doc_id"].astype("Int64"), sequence_id=seq, offset=off)

    return ranked.select("doc_id", "piece", "start", "length", "ids_crc32", "rank").mapInPandas(place, "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")


def op9_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All pieces of all documents with their sequence and offset."""
    return pack(table(spark, sf_dir, "documents").select("doc_id", "text"))


SQL: dict[str, str] = {}
