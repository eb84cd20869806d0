"""Substring dedup by super-k-mer partitioning.

A window is ``k`` consecutive words of a document. Its minimiser is the smallest hash among its runs of ``m``
words; consecutive windows with one minimiser form a super-k-mer, which travels as one packed string to the
minimiser's bucket, so equal windows always meet. In a bucket, equal strings are merged, windows are sorted by
hash, compared word by word, and those that a smaller document has are marked. Marks return to the documents.

Skew: every task merges its own equal strings and keeps only those of the smallest document, so a passage that
many documents hold is one string per chunk; minimisers that hold a large share of all strings, found by a pass
over the whole corpus, are ranked behind all others, so windows around them are dealt by a rarer one.
"""

from __future__ import annotations

import hashlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Buckets, table
from .words import chunks, mix, split_words

WINDOW, MINIMISER = 13, 3
#: Longest super-k-mer in windows; longer runs (a text of one repeated word) are cut.
LONGEST = 64
#: Share of all strings from which a minimiser counts as hot; at most 4/3 of its inverse are.
HOT_SHARE = 1 / 2000
TOP = np.uint64(1 << 63)
_MARK_SCHEMA = "doc_id long, key long, start int, n int"


def minimisers(h: np.ndarray, k: int, m: int, hot: np.ndarray) -> np.ndarray:
    """The minimiser of each window of ``k`` words, from word hashes; hot ones come last in the order."""
    n = len(h) - m + 1
    weights = np.random.default_rng(m).integers(1, 2**62, m, dtype=np.uint64) | np.uint64(1)
    g = h[:n] * weights[0]
    for j in range(1, m):
        g += h[j : n + j] * weights[j]
    g = mix(g) >> np.uint64(1)
    if len(hot):
        at = np.minimum(np.searchsorted(hot, g), len(hot) - 1)
        g[hot[at] == g] |= TOP
    width, step = k - m + 1, 1
    while step * 2 <= width:
        g = np.minimum(g[:-step], g[step:])
        step *= 2
    rest = width - step
    return np.minimum(g[: len(g) - rest], g[rest:]) if rest else g


def super_kmers(texts: list[bytes], k: int, m: int, hot: np.ndarray):
    """(words, text, first window, windows, minimiser) of the super-k-mers of some texts."""
    w = split_words(texts)
    n = len(w.start)
    none = np.zeros(0, dtype=np.int64)
    if n < k:
        return w, none, none, none, none.astype(np.uint64)
    low = minimisers(w.hashes(), k, m, hot)
    count = np.diff(w.first)
    text = np.repeat(np.arange(len(texts)), count)[: len(low)]
    valid = np.arange(len(low)) + k <= w.first[text + 1]
    new = np.ones(len(low), dtype=bool)
    new[1:] = (low[1:] != low[:-1]) | (text[1:] != text[:-1])
    run_start = np.maximum.accumulate(np.where(new, np.arange(len(low)), 0))
    new |= (np.arange(len(low)) - run_start) % LONGEST == 0
    starts = np.flatnonzero(new & valid)
    # the windows that cross into the next text stand at a run's end: count only valid ones
    upto = np.r_[0, np.cumsum(valid)]
    ends = np.r_[np.flatnonzero(new)[1:], len(low)][np.searchsorted(np.flatnonzero(new), starts)]
    return w, text[starts], starts, upto[ends] - upto[starts], low[starts]


def hot_minimisers(docs: DataFrame, k: int, m: int, share: float = HOT_SHARE) -> np.ndarray:
    """Minimisers that hold at least ``share`` of all super-k-mers, sorted; at most 4/3 of its inverse.

    Every chunk reports those with a quarter of the share, so what a hot one misses in chunks that don't report
    it is at most a quarter.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        seen: Counter[int] = Counter()
        for texts in chunks((t.encode() for b in batches for t in b["text"]), len):
            *_, low = super_kmers(texts, k, m, np.zeros(0, dtype=np.uint64))
            values, n = np.unique(low, return_counts=True)
            at = n >= max(2, share / 4 * len(low))
            seen.update(dict(zip(values[at].astype(np.int64).tolist(), n[at].tolist())))
            seen[-1] += len(low)
            if len(seen) > 200_000:
                yield pd.DataFrame(seen.items(), columns=["v", "n"])
                seen.clear()
        yield pd.DataFrame(seen.items(), columns=["v", "n"])

    counts = docs.select("text").mapInPandas(run, "v long, n long").groupBy("v").agg(F.sum("n").alias("n"))
    total = counts.where("v = -1").agg(F.sum("n")).first()[0] or 0
    rows = counts.where((F.col("v") >= 0) & (F.col("n") >= max(2, 0.75 * share * total))).collect()
    return np.sort(np.array([r.v for r in rows], dtype=np.int64).astype(np.uint64))


def pack(docs: np.ndarray, keys: np.ndarray, starts: np.ndarray, contents: list[bytes]) -> bytes:
    """Super-k-mers of one bucket as a compressed block; strings hold no line feeds, as words don't."""
    body = b"\n".join(contents)
    return zstandard.compress(np.int64(len(docs)).tobytes() + docs.astype(np.int64).tobytes() + keys.astype(np.int64).tobytes() + starts.astype(np.int32).tobytes() + body, 3)


def unpack(blob: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray, list[bytes]]:
    data = zstandard.decompress(blob)
    n = int(np.frombuffer(data, np.int64, 1)[0])
    docs, keys = np.frombuffer(data, np.int64, n, 8), np.frombuffer(data, np.int64, n, 8 + 8 * n)
    starts = np.frombuffer(data, np.int32, n, 8 + 16 * n)
    return docs, keys, starts, data[8 + 20 * n :].split(b"\n") if n else []


def deal(k: int, m: int, hot: np.ndarray, buckets: Buckets, most: int = 1 << 22):
    """mapInPandas function: (doc_id, key, text) -> blocks (part, sub, marks, blob). With marks, the blob has marks of the task itself."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sent: dict[bytes, int] = {}  # strings that several documents of a chunk had, with the smallest document sent
        rows = ((d, x, t.encode()) for b in batches for d, x, t in zip(b["doc_id"].tolist(), b["key"].tolist(), b["text"].tolist()))
        turn = 0
        for chunk in chunks(rows, lambda r: len(r[2]), most):
            chunk.sort(key=lambda r: r[0])
            ids, keys = np.array([r[0] for r in chunk]), np.array([r[1] for r in chunk])
            w, text, first, n, low = super_kmers([r[2] for r in chunk], k, m, hot)
            if not len(text):
                continue
            buffer = w.buffer.tobytes()
            contents = [buffer[a:b] for a, b in zip(w.start[first].tolist(), w.end[first + n - 1 + k - 1].tolist())]
            doc = ids[text]
            least: dict[bytes, int] = {}
            several: set[bytes] = set()
            own = np.ones(len(contents), dtype=bool)
            for i, (c, d) in enumerate(zip(contents, doc.tolist())):
                first_doc = least.setdefault(c, d)
                if first_doc < d:
                    own[i] = False
                    several.add(c)
                elif sent and sent.get(c, d) < d:
                    own[i] = False
            if len(sent) > 100_000:
                sent.clear()
            for c in several:
                sent[c] = min(least[c], sent.get(c, least[c]))
            start = first - w.first[text]
            place = mix(low.copy()) % np.uint64(buckets.parts * buckets.subs)
            out = []
            mine = np.flatnonzero(own)
            order = mine[np.argsort(place[mine], kind="stable")]
            edges = np.r_[0, np.flatnonzero(np.diff(place[order])) + 1, len(order)] if len(order) else [0]
            for a, b in zip(edges[:-1], edges[1:]):
                at = order[a:b]
                p = int(place[at[0]])
                out.append((p // buckets.subs, p % buckets.subs, False, pack(doc[at], keys[text[at]], start[at], [contents[i] for i in at])))
            gone = np.flatnonzero(~own)
            if len(gone):
                # neighbours of one text follow each other: join their intervals
                joint = (text[gone][1:] == text[gone][:-1]) & (start[gone][1:] == start[gone][:-1] + n[gone][:-1])
                heads = np.flatnonzero(np.r_[True, ~joint])
                size = np.add.reduceat(n[gone], heads)
                at = gone[heads]
                blob = zstandard.compress(np.rec.fromarrays([doc[at], keys[text[at]], start[at].astype(np.int32), size.astype(np.int32)], dtype=_MARKS).tobytes(), 3)
                out.append((turn % buckets.parts, 0, True, blob))
                turn += 1
            yield pd.DataFrame(out, columns=["part", "sub", "marks", "blob"])

    return run


_MARKS = np.dtype([("doc_id", "<i8"), ("key", "<i8"), ("start", "<i4"), ("n", "<i4")])


def count_windows(k: int, doc: np.ndarray, key: np.ndarray, start: np.ndarray, contents: list[bytes]) -> pd.DataFrame:
    """Marks (doc_id, key, start, n) of one bucket: windows that a smaller document holds too."""
    ids: dict[bytes, int] = {}
    of = np.array([ids.setdefault(c, len(ids)) for c in contents], dtype=np.int64)
    distinct = list(ids)
    least = np.full(len(distinct), np.iinfo(np.int64).max)
    np.minimum.at(least, of, doc)
    # windows of distinct strings, a few MB of strings at a time: hash, string, place in the joined buffer
    weights = np.random.default_rng(k).integers(1, 2**62, k, dtype=np.uint64) | np.uint64(1)
    found, buffers, base, seen = [], [], 0, 0
    for part in chunks(iter(distinct), len, 1 << 21, 1 << 20):
        w = split_words(part)
        h = w.hashes()
        content = np.repeat(np.arange(len(part)), np.diff(w.first))
        at = np.flatnonzero(np.arange(len(h)) + k <= w.first[content + 1])
        sums = h[at] * weights[0]
        for j in range(1, k):
            sums += h[at + j] * weights[j]
        found.append((sums, content[at] + seen, w.start[at] + base, w.end[at + k - 1] + base))
        buffers.append(w.buffer.tobytes())
        base += len(buffers[-1])
        seen += len(part)
    value, content, a, b = map(np.concatenate, zip(*found))
    windows = np.bincount(content, minlength=len(distinct))
    order = np.argsort(value, kind="stable")
    ranked = value[order]
    same = ranked[1:] == ranked[:-1]
    low = least[content]  # smallest document of each window
    inside = np.flatnonzero(np.r_[same, False] | np.r_[False, same])
    if len(inside):
        buffer = b"".join(buffers)
        groups = np.split(inside, np.flatnonzero(np.diff(ranked[inside])) + 1)
        for g in groups:
            mine = order[g].tolist()
            # equal hashes: the windows themselves decide
            best: dict[bytes, int] = {}
            texts = [buffer[a[i] : b[i]] for i in mine]
            for i, t in zip(mine, texts):
                best[t] = min(best.get(t, low[i]), low[i])
            for i, t in zip(mine, texts):
                low[i] = best[t]
    begin = np.cumsum(windows) - windows  # first window of each string
    whole = doc > least[of]
    out = [np.rec.fromarrays([doc[whole], key[whole], start[whole], windows[of[whole]]], dtype=_MARKS)]
    # strings of the smallest document itself: only windows that another string shows in a smaller one
    hit = np.zeros(len(distinct), dtype=bool)
    hit[content[low < least[content]]] = True
    rows = []
    for i in np.flatnonzero(~whole & hit[of]).tolist():
        c = of[i]
        for x in np.flatnonzero(low[begin[c] : begin[c] + windows[c]] < doc[i]).tolist():
            rows.append((doc[i], key[i], start[i] + x, 1))
    if rows:
        out.append(np.array(rows, dtype=_MARKS))
    return pd.DataFrame.from_records(np.concatenate([np.asarray(x) for x in out]))


def compare(k: int):
    """mapInPandas function: blocks sorted by sub-bucket -> marks."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held, now = [], None

        def flush():
            if held:
                docs, keys, starts, contents = zip(*held)
                held.clear()
                yield count_windows(k, np.concatenate(docs), np.concatenate(keys), np.concatenate(starts), [c for cs in contents for c in cs])

        for b in batches:
            for part, sub, marks, blob in zip(b["part"], b["sub"], b["marks"], b["blob"]):
                if marks:
                    yield pd.DataFrame.from_records(np.frombuffer(zstandard.decompress(blob), _MARKS))
                    continue
                if (part, sub) != now:
                    yield from flush()
                    now = (part, sub)
                held.append(unpack(blob))
        yield from flush()

    return run


def removed_words(docs: DataFrame, k: int = WINDOW, m: int = MINIMISER, hot_share: float = HOT_SHARE) -> DataFrame:
    """Marks (doc_id, key, start, n): n windows from word ``start`` on that a document with a smaller id holds too.

    ``docs``: doc_id, key (hash of the text), text, none null.
    """
    buckets = Buckets.of(docs, "text")
    hot = hot_minimisers(docs, k, m, hot_share)
    blocks = docs.mapInPandas(deal(k, m, hot, buckets), "part int, sub int, marks boolean, blob binary")
    return blocks.repartitionById(buckets.parts, "part").sortWithinPartitions("part", "sub").mapInPandas(compare(k), _MARK_SCHEMA)


def substring_dedup(docs: DataFrame, k: int = WINDOW, m: int = MINIMISER, text_col: str = "text", id_col: str = "doc_id", hot_share: float = HOT_SHARE) -> DataFrame:
    """(doc_id, n_words, n_removed, kept): every row's words without those covered by windows of a smaller document.

    Null texts have no words. A row without an id neither removes nor loses words. Rows that share an id don't
    remove each other's words. Windows are judged on the input, not on what is left. Texts of any length are read
    whole; texts below ``k`` words have no window. Other columns are left out. An empty table gives an empty result.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text")).withColumn("key", F.xxhash64("text"))
    marks = removed_words(rows.where("doc_id IS NOT NULL").select("doc_id", "key", "text"), k, m, hot_share)
    per = marks.groupBy("doc_id", "key").agg(F.collect_list("start").alias("starts"), F.collect_list("n").alias("ns"))

    def compress(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield b[["doc_id", "key"]].astype({"doc_id": "Int64"}).assign(blob=[zstandard.compress(t.encode(), 3) for t in b["text"]])

    joined = rows.select("doc_id", "key", "text").mapInPandas(compress, "doc_id long, key long, blob binary").join(per, ["doc_id", "key"], "left")

    def keep(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for doc, text, starts, ns in zip(b["doc_id"].tolist(), b["blob"], b["starts"], b["ns"]):
                words = zstandard.decompress(text).split()
                left = words
                if starts is not None and len(starts):
                    depth = np.zeros(len(words) + 1, dtype=np.int64)
                    np.add.at(depth, starts, 1)
                    np.add.at(depth, np.asarray(starts) + np.asarray(ns) + k - 1, -1)
                    left = [w for w, d in zip(words, np.cumsum(depth[:-1]).tolist()) if not d]
                out.append((doc, len(words), len(words) - len(left), b" ".join(left).decode()))
            yield pd.DataFrame(out, columns=["doc_id", "n_words", "n_removed", "kept"]).astype({"doc_id": "Int64"})

    return joined.select("doc_id", "blob", "starts", "ns").mapInPandas(keep, "doc_id long, n_words long, n_removed long, kept string")


def op2_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256 for every document."""
    out = substring_dedup(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


SQL = {
    "op2_substring_dedup": r"""
        WITH w AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents),
        win AS (SELECT doc_id, i, array_to_string(ws[i:i + 12], ' ') AS t
                FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 11)) AS i FROM w WHERE len(ws) >= 13)),
        low AS (SELECT t, min(doc_id) AS d FROM win GROUP BY t HAVING count(*) > 1),
        dup AS (SELECT doc_id, i FROM win JOIN low USING (t) WHERE doc_id > d),
        gone AS (SELECT DISTINCT doc_id, unnest(range(i, i + 13)) AS p FROM dup),
        per AS (SELECT doc_id, list(p) AS ps FROM gone GROUP BY doc_id),
        word AS (SELECT doc_id, unnest(ws) AS x, unnest(range(1, len(ws) + 1)) AS p FROM w),
        kept AS (SELECT doc_id, count(*) AS n, string_agg(x, ' ' ORDER BY p) AS s FROM word ANTI JOIN gone USING (doc_id, p) GROUP BY doc_id)
        SELECT w.doc_id, len(ws) AS n_words, len(ws) - coalesce(n, 0) AS n_removed, sha256(coalesce(s, '')) AS kept_sha256
        FROM w LEFT JOIN kept USING (doc_id)
    """
}
