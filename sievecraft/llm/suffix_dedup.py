"""Substring dedup over bytes by bucket-pointer refinement of suffixes.

A window is ``window`` consecutive bytes of a document. Spark deals windows by the q-gram of smallest hash inside them:
consecutive windows with one such q-gram travel as one packed string to the q-gram's bucket, so equal windows meet
whatever surrounds them. In a bucket, the suffixes of all strings whose q-gram occurs more than once are sorted as far
as a window reaches: buckets of equal 8-grams come first, and each bucket with several suffixes is refined by sorting
on the bucket pointers of the suffixes 8 bytes later, which gives pointers of depth 16, whose own pointers at offset 16
give depth 32, and so on; every update serves all later sorts. What shares a bucket at full depth is equal byte for byte,
without any hash. All but the first of a bucket are marked, and marks return to the documents.

Skew: every task merges its equal strings and keeps the first of them, so a passage that many documents hold is one
string per chunk of texts; q-grams that hold a large share of all strings, found by a pass over the whole corpus, come
last in the order of hashes, so only windows that lie in such passages with all their q-grams are dealt by them.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Buckets, table
from .words import chunks, mix

WINDOW = 100
#: Bytes of the q-grams that deal windows to buckets; a multiple of 8.
GRAM = 16
#: Bytes of texts whose strings are merged and packed together, and of those that are hashed together; longer texts are cut into pieces that overlap.
CHUNK, HASHED = 1 << 22, 1 << 19
#: Share of all strings from which a q-gram counts as hot; at most 4/3 of its inverse are.
HOT_SHARE = 1 / 2000
TOP = np.uint64(1 << 63)
MARKS = np.dtype([("doc_id", "<i8"), ("key", "<i8"), ("start", "<i4"), ("n", "<i4")])
_MARK_SCHEMA = "doc_id long, key long, start int, n int"
_STRING = np.dtype([("doc", "<i8"), ("key", "<i8"), ("start", "<i4"), ("h", "<u4"), ("n", "u1")])


def eights(data: np.ndarray) -> np.ndarray:
    """The 8 bytes from each place as a row; the last 7 places have none."""
    return np.lib.stride_tricks.sliding_window_view(data, 8)


def loaded(rows: np.ndarray, at: np.ndarray) -> np.ndarray:
    """The 8 bytes at each of some places as a number."""
    return rows[at].view(np.uint64).ravel()


def pieces(text: bytes, window: int, most: int) -> Iterator[tuple[int, bytes]]:
    """(first byte, piece) of a text; pieces of about ``most`` bytes overlap so that each window lies in one."""
    for at in range(0, len(text) - window + 1, most):
        yield at, text[at : at + most + window - 1]


def packed_strings(texts: list[bytes], window: int, gram: int, hot: np.ndarray):
    """(data, text, first byte in data, first byte in the text, windows, q-gram hash) of the packed strings of texts that hold a window at least.

    A string's windows have one and the same q-gram, by value and place (the leftmost of smallest hash), so two
    places of one window are always in two strings.
    """
    size = np.array([len(t) for t in texts], dtype=np.int64)
    data = np.frombuffer(b"".join(texts) + bytes(8), dtype=np.uint8)
    n = len(data) - 8
    word = eights(data)[:n].copy().view(np.uint64).ravel()
    weights = np.random.default_rng(gram).integers(1, 2**62, gram // 8, dtype=np.uint64) | np.uint64(1)
    places = n - gram + 1
    g = word[:places] * weights[0]
    for j in range(1, len(weights)):
        g += word[8 * j : 8 * j + places] * weights[j]
    g = mix(g) >> np.uint64(1)
    if len(hot):
        at = np.minimum(np.searchsorted(hot, g), len(hot) - 1)
        g[hot[at] == g] |= TOP
    low = (g & np.uint64(0xFFFFFFFF00000000)) | np.arange(places, dtype=np.uint64)
    width, step = window - gram + 1, 1
    while step * 2 <= width:
        low = np.minimum(low[:-step], low[step:])
        step *= 2
    low = np.minimum(low[: len(low) - (width - step)], low[width - step :])
    end = np.cumsum(size)
    new = np.r_[True, low[1:] != low[:-1]]
    valid = np.ones(n, dtype=bool)
    for k in range(1, window):  # windows that would run into the next text
        valid[end - k] = False
    valid = valid[: len(low)]
    new[end[:-1]] = True
    heads = np.flatnonzero(new)
    upto = np.r_[0, np.cumsum(valid, dtype=np.int32)]
    windows = upto[np.r_[heads[1:], len(low)]] - upto[heads]
    at = heads[windows > 0]
    text = np.searchsorted(end, at, side="right")
    return data, text, at, at - (end - size)[text], windows[windows > 0].astype(np.int64), g[(low[at] & np.uint64(0xFFFFFFFF)).astype(np.int64)]


def equal_runs(rows: np.ndarray, at: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(order, new): strings ordered so that equal ones follow each other, and where another one begins.

    ``at``, ``size``: first byte and bytes (8 or more) of each string. Neighbours in the order of a hash are compared byte
    for byte; strings of one hash that aren't equal may be torn into several runs, but a run is always of equal ones.
    """
    by_size = np.argsort(-size, kind="stable")
    s, f = size[by_size], at[by_size]
    x = s.astype(np.uint64)
    for o in range(0, int(s[0]) - 7, 8):
        m = int(np.searchsorted(-s, -(o + 8), side="right"))
        x[:m] = mix(x[:m] * np.uint64(0x9E3779B97F4A7C15) + loaded(rows, f[:m] + o))
    x = mix(x * np.uint64(0x9E3779B97F4A7C15) + loaded(rows, f + s - 8))
    by_hash = np.argsort(x, kind="stable")
    s, f, x = s[by_hash], f[by_hash], x[by_hash]
    near = np.flatnonzero((x[1:] == x[:-1]) & (s[1:] == s[:-1]))
    new = np.ones(len(s), dtype=bool)
    if len(near):
        a, b, n = f[near], f[near + 1], s[near]
        same = loaded(rows, a + n - 8) == loaded(rows, b + n - 8)
        for o in range(0, int(n.max()) - 7, 8):
            has = np.flatnonzero(n >= o + 8)
            same[has] &= loaded(rows, a[has] + o) == loaded(rows, b[has] + o)
        new[near[same] + 1] = False
    return by_size[by_hash], new


def ranks(doc: np.ndarray, key: np.ndarray, start: np.ndarray) -> np.ndarray:
    """Dense ranks of (doc, key, start); equal ones share a rank."""
    order = np.lexsort((start, key, doc))
    d, k, s = doc[order], key[order], start[order]
    out = np.empty(len(doc), dtype=np.int64)
    out[order] = np.cumsum(np.r_[False, (d[1:] != d[:-1]) | (k[1:] != k[:-1]) | (s[1:] != s[:-1])]) if len(doc) else 0
    return out


def firsts(rank: np.ndarray, order: np.ndarray, new: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(first, later): one string of each run with the run's smallest rank; those of larger rank."""
    heads = np.flatnonzero(new)
    run = np.cumsum(new) - 1
    least = np.minimum.reduceat(rank[order], heads)
    is_least = rank[order] == least[run]
    pick = np.full(len(heads), len(order))
    np.minimum.at(pick, run[is_least], np.flatnonzero(is_least))
    return order[pick], order[~is_least]


def marks_of(doc: np.ndarray, key: np.ndarray, start: np.ndarray, n: np.ndarray) -> np.ndarray:
    """Marked windows; runs that follow each other become one."""
    if not len(doc):
        return np.zeros(0, dtype=MARKS)
    order = np.lexsort((start, key, doc))
    doc, key, start, n = doc[order], key[order], start[order].astype(np.int64), n[order].astype(np.int64)
    apart = (doc[1:] != doc[:-1]) | (key[1:] != key[:-1]) | (start[1:] != start[:-1] + n[:-1])
    heads = np.flatnonzero(np.r_[True, apart])
    return np.rec.fromarrays([doc[heads], key[heads], start[heads], np.add.reduceat(n, heads)], dtype=MARKS)


def refined(buffer: np.ndarray, size: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray]:
    """(places, new): windows that occur more than once in strings laid end to end, in suffix order, and where a bucket begins.

    buffer: the strings and 8 more bytes; size: their bytes. A bucket pointer is the place of the bucket's first suffix
    in the sorted order, so pointers order suffixes as their bytes do, as deep as they have been refined.
    """
    n = len(buffer) - 8
    end = np.repeat(np.cumsum(size), size)
    left = (end - np.arange(n)).astype(np.int32)  # bytes up to the string's end
    word = eights(buffer)[:n].copy().view(">u8").ravel().astype(np.uint64)
    active = np.flatnonzero(left >= 8)
    active = active[np.argsort(word[active])]
    value = word[active]
    del word, end
    pointer = np.zeros(n, dtype=np.int64)
    old = np.zeros(len(active), dtype=np.int64)
    depth = 8
    while True:
        new = np.r_[True, value[1:] != value[:-1]]
        at = np.arange(len(active))
        bucket = np.r_[True, old[1:] != old[:-1]]
        first = np.maximum.accumulate(np.where(new, at, 0))
        pointer[active] = old + first - np.maximum.accumulate(np.where(bucket, at, 0))
        several = ~new
        several[:-1] |= ~new[1:]
        active, new = active[several], new[several]
        if depth == window or not len(active):
            return active, new
        offset = min(depth, window - depth)
        active = active[left[active] >= depth + offset]
        if not len(active):
            return active, np.zeros(0, dtype=bool)
        value = (pointer[active] << 32) | pointer[active + offset]
        order = np.argsort(value)
        active, value = active[order], value[order]
        old = value >> 32
        depth += offset


def laid_out(data: np.ndarray, at: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The strings end to end."""
    begin = np.cumsum(size) - size
    return data[np.repeat(at - begin, size) + np.arange(int(size.sum()))]


def bucket_marks(s: np.ndarray, data: np.ndarray, window: int) -> np.ndarray:
    """Marks of one bucket. s: its strings; data: their bytes end to end and 8 more."""
    size = s["n"].astype(np.int64) + window - 1
    at = np.cumsum(size) - size
    # a q-gram that stands in one string only has no window twice
    _, gram, count = np.unique(s["h"], return_inverse=True, return_counts=True)
    use = np.flatnonzero(count[gram] > 1)
    if not len(use):
        return np.zeros(0, dtype=MARKS)
    rank = ranks(s["doc"], s["key"], s["start"])
    order, new = equal_runs(eights(data), at[use], size[use])
    first, later = firsts(rank[use], order, new)
    first, later = use[first], use[later]
    out = [marks_of(s["doc"][later], s["key"][later], s["start"][later], s["n"][later])]
    # of equal strings the first stands for all; q-grams of several different strings are refined
    different = np.bincount(gram[first], minlength=len(count))
    first = first[different[gram[first]] > 1]
    if len(first):
        buffer = np.r_[laid_out(data, at[first], size[first]), np.zeros(8, dtype=np.uint8)]
        places, new = refined(buffer, size[first], window)
        if len(places):
            begin = np.cumsum(size[first]) - size[first]
            string = np.searchsorted(begin, places, side="right") - 1
            inside = places - begin[string]
            turn = rank[first][string] * window + inside  # a string has fewer windows than a window bytes
            least = np.minimum.reduceat(turn, np.flatnonzero(new))
            again = turn > least[np.cumsum(new) - 1]
            of = first[string[again]]
            out.append(marks_of(s["doc"][of], s["key"][of], s["start"][of] + inside[again], np.ones(len(of), dtype=np.int64)))
    return np.concatenate(out)


def hot_grams(docs: DataFrame, window: int, gram: int, share: float) -> np.ndarray:
    """q-grams that hold at least ``share`` of all packed strings, sorted; at most 4/3 of its inverse.

    Every chunk of texts reports those with a quarter of the share, so what a hot one misses in chunks that don't report it
    is at most a quarter.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        seen: Counter[int] = Counter()
        for texts in chunks((p for b in batches for t in b["text"] for _, p in pieces(t.encode(), window, HASHED)), len, HASHED):
            low = packed_strings(texts, window, gram, np.zeros(0, dtype=np.uint64))[5]
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


def packed(s: np.ndarray, body: np.ndarray) -> bytes:
    """A block: strings column by column, bytes of one place together, ids as differences; then their bytes."""
    columns = [np.diff(s[c], prepend=s[c].dtype.type(0)) if c == "doc" else np.ascontiguousarray(s[c]) for c in _STRING.names]
    planes = [c.view(np.uint8).reshape(len(s), -1).T.tobytes() for c in columns]
    return zstandard.compress(b"".join([np.int64(len(s)).tobytes(), *planes, body.tobytes()]), 6)


def unpacked(blob: bytes) -> tuple[np.ndarray, np.ndarray]:
    """(strings, their bytes) of a block."""
    data = zstandard.decompress(blob)
    n = int(np.frombuffer(data, np.int64, 1)[0])
    s, at = np.empty(n, dtype=_STRING), 8
    for c in _STRING.names:
        size = _STRING[c].itemsize
        column = np.ascontiguousarray(np.frombuffer(data, np.uint8, n * size, at).reshape(size, n).T).view(_STRING[c]).ravel()
        s[c] = np.cumsum(column) if c == "doc" else column
        at += n * size
    return s, np.frombuffer(data, np.uint8, -1, at)


def deal(window: int, gram: int, hot: np.ndarray, buckets: Buckets, most: int = CHUNK, hashed: int = HASHED):
    """mapInPandas function: (doc_id, key, text) -> blocks (part, sub, marks, blob). With marks, the blob has marks of the task itself."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rows = ((d, x, a, p) for b in batches for d, x, t in zip(b["doc_id"].tolist(), b["key"].tolist(), b["text"].tolist()) for a, p in pieces(t.encode(), window, hashed))
        turn = 0
        for chunk in chunks(rows, lambda r: len(r[3]), most, 1 << 16):
            ids, keys, begin = (np.array([r[c] for r in chunk], dtype=np.int64) for c in range(3))
            parts, texts, before = [], 0, 0
            for some in chunks(iter(chunk), lambda r: len(r[3]), hashed, 1 << 16):
                data, text, at, *rest = packed_strings([r[3] for r in some], window, gram, hot)
                parts.append((data[:-8], text + texts, at + before, *rest))
                texts, before = texts + len(some), before + len(data) - 8
            parts.append((np.zeros(8, dtype=np.uint8), *[p[:0] for p in parts[0][1:]]))
            data, text, at, start, n, low = map(np.concatenate, zip(*parts))
            doc, key, start, size = ids[text], keys[text], start + begin[text], n + window - 1
            order, new = equal_runs(eights(data), at, size)
            first, later = firsts(ranks(doc, key, start), order, new)
            place = mix(low[first]) % np.uint64(buckets.parts * buckets.subs)
            mine = first[np.argsort(place, kind="stable")]
            place = np.sort(place).astype(np.int64)
            out = []
            strings = np.rec.fromarrays([doc[mine], key[mine], start[mine], mix(low[mine] + np.uint64(1)).astype(np.uint32), n[mine]], dtype=_STRING)
            edges = np.r_[np.flatnonzero(np.r_[True, place[1:] != place[:-1]]), len(mine)]
            for a, b in zip(edges[:-1].tolist(), edges[1:].tolist()):
                s = strings[a:b]
                p = int(place[a])
                out.append((p // buckets.subs, p % buckets.subs, False, packed(s, laid_out(data, at[mine[a:b]], size[mine[a:b]]))))
            if len(later):
                m = marks_of(doc[later], key[later], start[later], n[later])
                out.append((turn % buckets.parts, 0, True, zstandard.compress(m.tobytes(), 3)))
                turn += 1
            yield pd.DataFrame(out, columns=["part", "sub", "marks", "blob"])

    return run


def compare(window: int):
    """mapInPandas function: blocks sorted by sub-bucket -> marks."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held, now = [], None

        def flush() -> Iterator[pd.DataFrame]:
            if held:
                strings, bodies = zip(*held)
                held.clear()
                found = bucket_marks(np.concatenate(strings), np.concatenate([*bodies, np.zeros(8, dtype=np.uint8)]), window)
                if len(found):
                    yield pd.DataFrame.from_records(found)

        for b in batches:
            for part, sub, marks, blob in zip(b["part"], b["sub"], b["marks"], b["blob"]):
                if marks:
                    yield pd.DataFrame.from_records(np.frombuffer(zstandard.decompress(blob), MARKS))
                    continue
                if (part, sub) != now:
                    yield from flush()
                    now = (part, sub)
                held.append(unpacked(blob))
        yield from flush()

    return run


def repeated_windows(docs: DataFrame, window: int = WINDOW, gram: int = GRAM, hot_share: float = HOT_SHARE) -> DataFrame:
    """Marks (doc_id, key, start, n): n windows from byte ``start`` on that also start earlier: in a smaller document, or before in the same.

    ``docs``: doc_id, key (hash of the text, orders documents that share an id), text, none null.
    """
    if gram % 8 or not 8 <= gram <= window <= 255:
        raise ValueError("a q-gram has a multiple of 8 bytes, a window as many at least and 255 at most")
    buckets = Buckets.of(docs, "text")
    hot = hot_grams(docs, window, gram, hot_share)
    blocks = docs.mapInPandas(deal(window, gram, hot, buckets), "part int, sub int, marks boolean, blob binary")
    return blocks.repartitionById(buckets.parts, "part").sortWithinPartitions("part", "sub").mapInPandas(compare(window), _MARK_SCHEMA)


def suffix_dedup(docs: DataFrame, window: int = WINDOW, gram: int = GRAM, text_col: str = "text", id_col: str = "doc_id", hot_share: float = HOT_SHARE) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept): every row's UTF-8 bytes without those covered by a window that also starts earlier.

    Earlier is in a document of a smaller id, or before in the same one; windows may overlap themselves, are judged on the
    input, not on what is left, and never cross documents. ``kept`` is binary, as a cut may fall inside a character.
    Null texts count as empty; texts below a window lose nothing; texts of any length are read whole. A row without an id
    neither removes nor loses bytes. Rows that share an id are ordered by the hash of their texts, and those that share
    the text too are one document, each returned with the same result. Other columns are left out, whatever their
    names. An empty table gives an empty result.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    alone = rows.where("doc_id IS NOT NULL").groupBy("doc_id").agg(F.count("*").alias("n")).where("n > 1").isEmpty()
    rows = rows.withColumn("key", F.lit(0).cast("long") if alone else F.xxhash64("text"))  # where ids tell all documents apart, nothing else need travel
    marks = repeated_windows(rows.where("doc_id IS NOT NULL").select("doc_id", "key", "text"), window, gram, hot_share)
    per = marks.groupBy("doc_id", "key").agg(F.collect_list("start").alias("starts"), F.collect_list("n").alias("ns"))

    def compress(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield b[["doc_id", "key"]].astype({"doc_id": "Int64"}).assign(blob=[zstandard.compress(t.encode(), 3) for t in b["text"]])

    joined = rows.select("doc_id", "key", "text").mapInPandas(compress, "doc_id long, key long, blob binary").join(per, ["doc_id", "key"], "left")

    def keep(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for doc, blob, starts, ns in zip(b["doc_id"].tolist(), b["blob"], b["starts"], b["ns"]):
                text = zstandard.decompress(blob)
                removed = spans = 0
                left = text
                if starts is not None and len(starts):
                    depth = np.zeros(len(text) + 1, dtype=np.int32)
                    np.add.at(depth, starts, 1)
                    np.add.at(depth, np.asarray(starts) + np.asarray(ns) + window - 1, -1)
                    gone = np.cumsum(depth[:-1]) > 0
                    left = np.frombuffer(text, np.uint8)[~gone].tobytes()
                    removed, spans = int(gone.sum()), int(gone[0]) + int((gone[1:] & ~gone[:-1]).sum())
                out.append((doc, len(text), removed, spans, left))
            yield pd.DataFrame(out, columns=["doc_id", "n_bytes", "n_removed", "n_spans", "kept"]).astype({"doc_id": "Int64"})

    return joined.select("doc_id", "blob", "starts", "ns").mapInPandas(keep, "doc_id long, n_bytes long, n_removed long, n_spans long, kept binary")


def op12_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 for every document."""
    out = suffix_dedup(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


SQL = {
    "op12_suffix_dedup": """
        WITH t AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
        win AS (SELECT doc_id, unnest(range(0, len(h) // 2 - 99)) AS s,
                       unnest(list_transform(range(0, len(h) // 2 - 99), lambda i: md5_number(substr(h, 2 * i + 1, 200)))) AS w
                FROM t WHERE len(h) >= 200),
        dup AS (SELECT doc_id, s FROM (SELECT doc_id, s, row_number() OVER (PARTITION BY w ORDER BY doc_id, s) AS r FROM win) WHERE r > 1),
        begun AS (SELECT doc_id, s, CASE WHEN s <= lag(s) OVER (PARTITION BY doc_id ORDER BY s) + 100 THEN 0 ELSE 1 END AS b FROM dup),
        numbered AS (SELECT doc_id, s, sum(b) OVER (PARTITION BY doc_id ORDER BY s ROWS UNBOUNDED PRECEDING) AS k FROM begun),
        span AS (SELECT doc_id, k, min(s) AS a, max(s) + 100 AS e FROM numbered GROUP BY doc_id, k),
        gap AS (SELECT doc_id, k, coalesce(lag(e) OVER (PARTITION BY doc_id ORDER BY k), 0) AS f, a AS u FROM span
                UNION ALL SELECT t.doc_id, 1000000000, coalesce(m, 0), len(h) // 2
                FROM t LEFT JOIN (SELECT doc_id, max(e) AS m FROM span GROUP BY doc_id) USING (doc_id)),
        kept AS (SELECT doc_id, string_agg(substr(h, 2 * f + 1, 2 * (u - f)), '' ORDER BY k) AS hx, sum(u - f) AS n FROM gap JOIN t USING (doc_id) GROUP BY doc_id),
        spans AS (SELECT doc_id, count(*) AS c FROM span GROUP BY doc_id)
        SELECT t.doc_id, len(h) // 2 AS n_bytes, CAST(len(h) // 2 - n AS BIGINT) AS n_removed, coalesce(c, 0) AS n_spans, sha256(unhex(hx)) AS kept_sha256
        FROM t JOIN kept USING (doc_id) LEFT JOIN spans USING (doc_id)
    """
}
