"""Secret scans: fixed patterns, plus character Markov models of random strings and ordinary identifiers.

Everything runs as DataFrame expressions. Spans come from the pieces between matches, as built-in functions
give matches without their places. The two models are tables of character pairs, counted in Spark over a
labelled sample (values that the patterns found are random, words and identifiers of the remaining text are
ordinary) and brought to the driver as at most 2 x 66 x 66 counts; a token's log-likelihood ratio per
transition decides.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table


def _either_case(word: str) -> str:
    return "".join(f"[{c.upper()}{c}]" if c.isalpha() else c for c in word)


#: Fixed by the contract, in the order that equal starts are listed: kind -> (pattern, group whose length counts, least length).
KINDS = {
    "assign": ("(" + "|".join(map(_either_case, ("password", "passwd", "secret", "token"))) + "|" + _either_case("api") + "_?" + _either_case("key") + r")[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", 2, 12),
    # runs of one class are maximal, so a least length inside the pattern drops the same matches as one after it
    "access": ("AKIA[A-Z0-9]{14,}", 0, 18),
    "hex": ("[0-9a-f]{16,}", 0, 16),
}
MARKOV = "markov"
#: Characters of candidate tokens; any other has the last place of the model.
ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_="
SIZE = len(ALPHABET) + 1
CANDIDATE = "[A-Za-z0-9+/_=]{20,}"
#: Documents in the labelled sample, about; all of them where the table has fewer.
SAMPLE_DOCS = 4000

def bound(value: Column, then) -> Column:
    """``then`` of a value that is computed once: inside a lambda anything but a lambda variable is computed again for each element."""
    return F.element_at(F.transform(F.array(value), then), 1)


def before_each(values: Column, kind: str, merge, width: int = 64) -> Column:
    """What ``merge`` (associative, from 0) makes of all values before each one; ``kind`` is its type.

    Arrays can only be grown by copying them, so chunks of ``width`` values are summed, the sums carried on, and each
    chunk filled from its own start: no text's cost grows with the square of its matches.
    """
    zero, empty = F.lit(0).cast(kind), F.array().cast(f"array<{kind}>")
    grow = lambda vs, start: F.aggregate(vs, F.struct(start.alias("at"), empty.alias("out")), lambda a, v: F.struct(merge(a["at"], v).cast(kind).alias("at"), F.concat(a["out"], F.array(a["at"])).alias("out")), lambda a: a["out"])
    cut = lambda vs: F.transform(F.sequence(F.lit(0), F.floor((F.size(vs) - 1) / width).cast("int")), lambda k: F.slice(vs, k * width + 1, F.lit(width)))
    sums = lambda chunks: F.transform(chunks, lambda c: F.aggregate(c, zero, lambda a, v: merge(a, v).cast(kind)))
    filled = lambda chunks: F.flatten(F.zip_with(chunks, grow(sums(chunks), zero), lambda c, start: grow(c, start)))
    return bound(values, lambda vs: F.when(F.size(vs) > 0, bound(cut(vs), filled)).otherwise(empty))


SPAN = "struct<start:int,end:int,len:int,token:string>"


def find_spans(text: Column, pattern: str, group: int = 0) -> Column:
    """array<struct<start, end, len, token>> of leftmost non-overlapping matches in code points; len is the group's length.

    The text is gone through once for a test, and only where that finds something for the matches and the gaps before them.
    A match is a match of the pattern by itself too, which gives its group.
    """
    matches = F.arrays_zip(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("w"), F.split(text, pattern, -1).alias("gap"))
    # behind the last match there is one more gap
    sized = F.transform(F.filter(matches, lambda m: m["w"].isNotNull()), lambda m: F.struct(m["w"].alias("w"), F.length(m["w"]).alias("size"), (F.length(m["gap"]) + F.length(m["w"])).alias("n")))
    length = lambda m: F.length(F.regexp_extract(m["w"], pattern, group)) if group else m["size"]
    span = lambda m, before: F.struct((before + m["n"] - m["size"]).alias("start"), (before + m["n"]).alias("end"), length(m).alias("len"), m["w"].alias("token"))
    spans = bound(sized, lambda ms: F.zip_with(ms, before_each(F.transform(ms, lambda m: m["n"]), "int", lambda a, v: a + v), span))
    return F.when(F.rlike(text, F.lit(pattern)), spans).otherwise(F.array().cast(f"array<{SPAN}>"))


def base_spans(text: Column) -> dict[str, Column]:
    """Spans of each fixed kind; matches that are too short are dropped after matching."""
    return {k: F.filter(find_spans(text, p, g), _at_least(n)) for k, (p, g, n) in KINDS.items()}


def _at_least(n: int):
    # a second parameter, even one with a default, would be the element's index
    return lambda span: span.len >= n


def fit_markov(docs: DataFrame, text_col: str = "text", id_col: str = "doc_id", sample_docs: int = SAMPLE_DOCS) -> np.ndarray:
    """Log-likelihood ratios, random over ordinary, of all character pairs (SIZE x SIZE, flattened).

    The sample is every m-th document by a hash of its id, m so that about ``sample_docs`` remain; the bound is
    for the models' labelled rows only, every document is scored. Random transitions are mixed half with the
    uniform distribution, so strings over other alphabets than the sample's count as random as well.
    """
    every = max(1, docs.count() // max(1, sample_docs))
    text = F.coalesce(F.col(text_col), F.lit(""))
    sample = docs.where(F.pmod(F.xxhash64(F.col(id_col)), F.lit(every)) == 0).select(text.alias("t"))
    value = lambda p, g, n: F.filter(F.regexp_extract_all(F.col("t"), F.lit(p), F.lit(g)), lambda v: F.length(v) >= n)
    values = [value(*kind) for kind in KINDS.values()]
    rest = reduce(lambda c, k: F.regexp_replace(c, k[0], " "), KINDS.values(), F.col("t"))
    # shorter than any candidate, so that what is to be judged never counts as ordinary
    words = F.regexp_extract_all(rest, F.lit("(?<![A-Za-z0-9+/_=])[A-Za-z_][A-Za-z0-9_]{5,18}(?![A-Za-z0-9+/_=])"), F.lit(0))
    tokens = sample.select(F.explode(F.array(F.struct(F.lit(1).alias("random"), F.concat(*values).alias("v")), F.struct(F.lit(0).alias("random"), words.alias("v")))).alias("x")).select("x.random", F.explode("x.v").alias("v"))
    chars = tokens.select("random", F.split("v", "").alias("c"))
    n = F.size("c") - 1
    pairs = chars.where(n >= 1).select("random", F.explode(F.zip_with(F.slice("c", F.lit(1), n), F.slice("c", F.lit(2), n), lambda x, y: F.concat(x, y))).alias("p"))
    counts = np.zeros((2, SIZE, SIZE))
    place = lambda c: ALPHABET.find(c) if c in ALPHABET else SIZE - 1
    for r in pairs.groupBy("random", "p").count().collect():
        counts[r.random, place(r.p[0]), place(r.p[1])] += r["count"]
    rows = counts.sum(axis=2, keepdims=True)
    random = 0.5 * (counts[1] + 0.5) / (rows[1] + 0.5 * SIZE) + 0.5 / SIZE
    # ordinary transitions lean on how common the next character is, as most pairs are rare
    common = (counts[0].sum(axis=0) + 0.1) / (counts[0].sum() + 0.1 * SIZE)
    plain = (counts[0] + 5 * common) / (rows[0] + 5)
    return np.log(random / plain).reshape(-1)


def mean_llr(token: Column, model: np.ndarray) -> Column:
    """Mean log-likelihood ratio of the token's transitions."""
    codes = np.full(128, SIZE - 1, dtype=np.int32)
    for i, c in enumerate(ALPHABET):
        codes[ord(c)] = i
    at = F.transform(F.split(token, ""), lambda c: F.element_at(F.lit(codes), F.least(F.ascii(c), F.lit(127)) + 1))
    n = F.size(at) - 1
    each = F.zip_with(F.slice(at, F.lit(1), n), F.slice(at, F.lit(2), n), lambda x, y: F.element_at(F.lit(model), x * SIZE + y + 1))
    return F.aggregate(each, F.lit(0.0), lambda a, x: a + x) / n


def apart(spans: Column, others: Column) -> Column:
    """Those of ``spans`` (start, end, token) that overlap none of ``others`` (start, end).

    Both are laid out by place: an other at its start, a span at its end, before others that start there. A span is free if no
    other before it reaches beyond its start.
    """
    place = lambda key, other, reach, start, end, token: F.struct(key.alias("key"), F.lit(other).alias("other"), reach.cast("int").alias("reach"), start.alias("start"), end.alias("end"), token.cast("string").alias("token"))
    items = F.array_sort(F.concat(F.transform(others, lambda b: place(b["start"], 1, b["end"], b["start"], b["end"], F.lit(None))), F.transform(spans, lambda s: place(s["end"], 0, F.lit(0), s["start"], s["end"], s["token"]))))
    reached = lambda xs: F.zip_with(xs, before_each(F.transform(xs, lambda x: x["reach"]), "int", F.greatest), lambda x, top: F.struct(x["start"].alias("start"), x["end"].alias("end"), x["token"].alias("token"), ((x["other"] == 0) & (top <= x["start"])).alias("free")))
    kept = F.transform(F.filter(bound(items, reached), lambda x: x["free"]), lambda x: F.struct(x["start"].alias("start"), x["end"].alias("end"), x["token"].alias("token")))
    plain = F.transform(spans, lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), s["token"].alias("token")))
    return F.when((F.size(others) > 0) & (F.size(spans) > 0), kept).otherwise(plain)


def _free_name(docs: DataFrame, name: str) -> str:
    """The name, with underscores added until no column has it."""
    while name.lower() in {c.lower() for c in docs.columns}:
        name += "_"
    return name


def secret_scan(docs: DataFrame, model: np.ndarray | None = None, text_col: str = "text", id_col: str = "doc_id", least_llr: float = 3.0) -> DataFrame:
    """``docs`` with ``secrets`` added: array<struct<start, end, kind>> by start, then kind as listed.

    Starts are in code points, ends exclusive. The Markov models add tokens of 20 or more characters whose mean
    ratio reaches ``least_llr`` and that overlap no span of a fixed pattern. Null texts count as
    empty and have no spans; texts of any length are scanned whole; repeated rows are scanned each. A column ``secrets``
    of the input is replaced, all others stay. An empty table gives an empty result.
    """
    model = fit_markov(docs, text_col, id_col) if model is None else model
    text = F.coalesce(F.col(text_col), F.lit(""))
    kinds = base_spans(text)
    rank = {k: i for i, k in enumerate([*KINDS, MARKOV])}
    tag = lambda spans, kind: F.transform(spans, lambda s: F.struct(s.start.alias("start"), F.lit(rank[kind]).alias("rank"), s.end.alias("end"), F.lit(kind).alias("kind")))
    base = _free_name(docs, "__base")
    out = docs.withColumn(base, F.concat(*[tag(s, k) for k, s in kinds.items()]))
    spans = find_spans(text, CANDIDATE)
    found = F.filter(apart(spans, F.col(base)), lambda s: mean_llr(s.token, model) >= least_llr)
    merged = F.array_sort(F.concat(F.col(base), tag(found, MARKOV)))
    return out.withColumn("secrets", F.transform(merged, lambda s: F.struct(s.start.alias("start"), s.end.alias("end"), s.kind.alias("kind")))).drop(base)


def redact(text: Column, secrets: Column, mark: str = "[secret]") -> Column:
    """The text with every span of ``secrets`` (by start; they may overlap) replaced by a mark; texts without spans as they are.

    Only texts with spans are taken apart, into code points, so each gap is copied once.
    """
    # a gap begins where the spans so far end
    ends = F.transform(secrets, lambda s: s["end"])
    begun = F.zip_with(secrets, before_each(ends, "int", F.greatest), lambda s, at: F.struct(s["start"].alias("start"), at.alias("at")))
    gap = lambda chars, a, n: F.array_join(F.slice(chars, a + 1, n), "")
    pieces = lambda chars: F.transform(F.filter(begun, lambda s: s["start"] >= s["at"]), lambda s: F.concat(gap(chars, s["at"], s["start"] - s["at"]), F.lit(mark)))
    rest = lambda chars: bound(F.array_max(ends), lambda last: gap(chars, last, F.greatest(F.size(chars) - last, F.lit(0))))
    return F.when(F.size(secrets) > 0, bound(F.split(text, ""), lambda chars: F.concat(F.array_join(pieces(chars), ""), rest(chars)))).otherwise(text)


def op8_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base_sha256, spans for every document."""
    scanned = secret_scan(table(spark, sf_dir, "documents").select("doc_id", "text"))
    line = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s.kind, s.start, s.end)), ",")
    of = lambda k: F.filter("secrets", lambda s: s.kind == k)
    base = F.filter("secrets", lambda s: s.kind != MARKOV)
    return scanned.select("doc_id", *[F.size(of(k)).cast("long").alias(f"n_{k}") for k in KINDS], F.sha2(line(base), 256).alias("base_sha256"), line(F.col("secrets")).alias("spans"))


SQL: dict[str, str] = {}
