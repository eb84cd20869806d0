"""URL filters by a Bloom filter cascade.

Level 1 encodes the listed keys. Level 2 encodes the keys of the corpus that pass level 1 without being
listed, level 3 the listed keys that pass level 2, and so on until no false positive is left. Over the key
universe it was built from (all distinct keys that the corpus's urls give), a cascade answers membership
exactly: the first level that a key fails decides it. Testing a key reads bits of constants, so urls are
judged without a join or shuffle.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..scratch import cut, discard
from .common import ascii_lower, table

#: Fixed by the contract: (verdict, host, path); a rule's name is host + path.
RULES = (
    ("allow", "com", "/"),
    ("block", "example.com", "/en/"),
    ("allow", "www.example.com", "/en/"),
    ("block", "net", "/es/"),
    ("block", "net", "/fr/"),
)
#: Words whose presence in a host (split at dots and hyphens) the method lists, where no rule fits.
HOST_WORDS = ("casino", "poker", "bets", "betting", "slots", "pills", "viagra", "pharmacy", "porn", "xxx", "adult", "loans", "payday", "warez", "torrent")


@dataclass(frozen=True)
class Level:
    """One Bloom filter: 64-bit words and the number of hashes; seeds differ by level."""

    words: np.ndarray
    hashes: int
    seed: int

    def test(self, key: Column) -> Column:
        """Whether the key's bits are set. The filter stands in the plan once a test, not once a hash."""
        bits, words = len(self.words) * 64, F.lit(self.words)

        def set_at(k: Column) -> Column:
            at = F.pmod(F.xxhash64(key, F.lit(self.seed), k), F.lit(bits))
            return F.getbit(F.element_at(words, (F.shiftright(at, 6) + 1).cast("int")), (at % 64).cast("int")) == 1

        return F.forall(F.array(*[F.lit(k) for k in range(self.hashes)]), set_at)


def bloom_level(keys: DataFrame, n: int, seed: int, bits_per_key: float = 12.0, hashes: int = 5, most_bits: int = 1 << 26) -> Level:
    """Encode the column ``key`` of ``keys`` (n rows). Bits are OR-ed per 64-bit word before they leave a task.

    The filter is the only thing sent to the driver, at most ``most_bits`` / 8 bytes (8 MB), however many keys
    there are; with more keys the rate of false positives rises and the cascade gets more levels.
    """
    size = int(min(most_bits, max(64, -(-int(n * bits_per_key) // 64) * 64)))
    at = F.explode(F.array(*[F.pmod(F.xxhash64("key", F.lit(seed), F.lit(k)), F.lit(size)) for k in range(hashes)])).alias("at")
    rows = keys.select(at).groupBy((F.shiftright("at", 6)).alias("w")).agg(F.bit_or(F.call_function("shiftleft", F.lit(1).cast("long"), (F.col("at") % 64).cast("int"))).alias("bits")).collect()
    words = np.zeros(size // 64, dtype=np.int64)
    for r in rows:
        words[r.w] = r.bits
    return Level(words, hashes, seed)


def build_cascade(universe: DataFrame, most_levels: int = 64, **options) -> list[Level]:
    """Levels for ``universe`` (key, listed: distinct keys); raises if they don't end, which needs equal hashes."""
    own, other = universe.where("listed").select("key"), universe.where("NOT listed").select("key")
    levels: list[Level] = []
    while (n := own.count()) and len(levels) < most_levels:
        level = bloom_level(own, n, len(levels), **options)
        levels.append(level)
        own, other = other.where(level.test(F.col("key"))), own
    if n:
        raise ValueError("the cascade doesn't end: keys with equal hashes on both sides")
    return levels


def in_cascade(levels: list[Level], key: Column) -> Column:
    """Whether the key is listed: exact for keys of the universe. Null keys aren't."""
    # the first level that fails decides: failing an odd one means not listed, an even one listed
    answer = F.lit(len(levels) % 2 == 1)
    for i in reversed(range(len(levels))):
        answer = F.when(levels[i].test(key), answer).otherwise(F.lit(i % 2 == 1))
    return F.coalesce(F.when(key.isNotNull(), answer), F.lit(False))


def url_parts(url: Column) -> tuple[Column, Column]:
    """(host, path): host follows the first :// up to / ? # or the end, path then up to ? # or the end."""
    rest = F.when(F.contains(url, F.lit("://")), F.substring(url, F.locate("://", url) + F.lit(3), F.length(url)))
    rest = F.coalesce(rest, F.lit(""))
    host = F.regexp_extract(rest, r"^([^/?#]*)", 1)
    path = F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)
    return ascii_lower(host), path


def rule_keys(host: Column, path: Column, rules) -> list[Column]:
    """A candidate key for each shape of rule (labels of its host, length of its path), longest rule first; null where it can't fit."""
    shapes = {(h.count(".") + 1, len(p)) for _, h, p in rules}
    longest = {s: max(len(h) + len(p) for _, h, p in rules if (h.count(".") + 1, len(p)) == s) for s in shapes}
    labels = F.split(host, r"\.", -1)
    return [F.when((F.size(labels) >= n) & (F.length(path) >= m), F.concat(F.substring_index(host, ".", -n), F.substring(path, 1, m))) for n, m in sorted(shapes, key=lambda s: (-longest[s], s))]


def word_keys(host: Column) -> Column:
    """Array of keys for the host's words."""
    return F.transform(F.array_distinct(F.split(host, r"[.\-]")), lambda w: F.concat(F.lit("word:"), w))


def host_keys(host: Column) -> Column:
    """Array of keys for a host and the hosts above it; an empty host has none."""
    labels = F.when(host != "", F.size(F.split(host, r"\.", -1))).otherwise(0)
    return F.when(labels > 0, F.transform(F.sequence(F.lit(1), labels), lambda n: F.concat(F.lit("host:"), F.array_join(F.slice(F.split(host, r"\.", -1), -n, n), ".")))).otherwise(F.array().cast("array<string>"))


def url_filter(pages: DataFrame, rules=RULES, words=HOST_WORDS, url_col: str = "url", blocked: DataFrame | None = None, **options) -> DataFrame:
    """``pages`` with host, path, rule and verdict (clashing columns replaced).

    A rule fits its host and all its subdomains if the path starts with the rule's; of those that fit, the one
    with the longest name wins. Without a rule, the method blocks a host with a listed word and allows any
    other, urls that are null, empty or lack :// included. An empty table gives an empty result; repeated rows are
    judged each, and urls are read whole, whatever their length.

    ``blocked`` (host) lists further hosts, as many as there are: one that is a url's host or a parent of it blocks the
    url where no rule fits. It is joined once with the distinct keys of the corpus to tell the listed
    ones; urls then meet the cascade only. Null and empty hosts in it list nothing.

    All of a url's keys that are in no rule or list are in the universe too, so the cascade is exact for it.
    """
    host, path = url_parts(F.col(url_col))
    base = pages.select(*[c for c in pages.columns if c not in ("host", "path", "rule", "verdict")], host.alias("host"), path.alias("path"))
    keys = rule_keys(F.col("host"), F.col("path"), rules)
    named = {h + p: verdict for verdict, h, p in rules}
    listed = [*named, *[f"word:{w}" for w in words]]
    others = word_keys(F.col("host"))
    if blocked is not None:
        others = F.concat(others, host_keys(F.col("host")))
    every = F.concat(F.array(*keys), others)
    universe = base.select(F.explode(F.array_distinct(every)).alias("key")).where("key IS NOT NULL").distinct()
    # listed keys that no url has needn't be stored: only keys of the universe are ever asked for
    universe = universe.withColumn("listed", F.col("key").isin(listed))
    if blocked is not None:
        hosts = blocked.select(F.concat(F.lit("host:"), ascii_lower(F.col("host"))).alias("key")).where("key > 'host:'").distinct()
        universe = universe.join(hosts.withColumn("__more", F.lit(True)), "key", "left").select("key", (F.col("listed") | F.coalesce("__more", F.lit(False))).alias("listed"))
    universe = cut(universe, "url-keys")
    levels = build_cascade(universe, **options)
    discard(universe)
    # keys of one shape have different lengths of text, so the longest listed key is searched by length
    tested = base.withColumn("__listed", F.transform(every, lambda k: in_cascade(levels, k)))
    hits = F.filter(F.array(*keys), lambda k, i: F.element_at("__listed", i + 1))
    best = F.aggregate(hits, F.lit(None).cast("string"), lambda a, k: F.when(a.isNull() | (F.length(k) > F.length(a)), k).otherwise(a))
    by_rule = F.create_map(*[F.lit(x) for pair in named.items() for x in pair])
    in_list = F.exists(F.slice("__listed", len(keys) + 1, F.size("__listed")), lambda x: x)
    verdict = F.when(F.col("rule").isNotNull(), F.element_at(by_rule, F.col("rule"))).when(in_list, F.lit("block")).otherwise(F.lit("allow"))
    return tested.withColumn("rule", best).withColumn("verdict", verdict).drop("__listed")


def op7_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """page_id, host, path, rule, verdict for every page."""
    return url_filter(table(spark, sf_dir, "pages").select("page_id", "url")).select("page_id", "host", "path", "rule", "verdict")


_RULE_ROWS = ", ".join(f"('{v}', '{h}', '{p}')" for v, h, p in RULES)
SQL = {
    "op7_url_filter": f"""
        WITH rules(verdict, h, p) AS (VALUES {_RULE_ROWS}),
        rest AS (SELECT page_id, CASE WHEN contains(url, '://') THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS r FROM pages),
        parts AS (SELECT page_id, translate(regexp_extract(r, '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
                         regexp_extract(r, '^[^/?#]*([^?#]*)', 1) AS path FROM rest),
        best AS (SELECT page_id, arg_max(h || p, length(h || p)) AS rule, arg_max(verdict, length(h || p)) AS verdict
                 FROM parts JOIN rules ON (host = h OR ends_with(host, '.' || h)) AND starts_with(path, p) GROUP BY page_id)
        SELECT page_id, host, path, rule,
               coalesce(verdict, CASE WHEN list_has_any(string_split_regex(host, '[.-]'), {list(HOST_WORDS)}) THEN 'block' ELSE 'allow' END) AS verdict
        FROM parts LEFT JOIN best USING (page_id)
    """
}
