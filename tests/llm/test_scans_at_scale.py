"""Costs that must not grow with the square of a text's matches, keys that must not gather rows, and scopes of the grammar."""

import random
import re
import string
import time

import numpy as np
from pyspark.sql import functions as F

from sievecraft.llm import exact_dedup, secret_scan, toxicity

ALNUM = string.ascii_letters + string.digits


def lines(n):
    r = random.Random(n)
    return "\n".join(f"token={''.join(r.choices(ALNUM, k=14))} {''.join(r.choices(string.ascii_letters, k=24))}" for _ in range(n))


def test_secret_scan_is_linear_in_matches(spark):
    took = {}
    for n in (2000, 2000, 16_000):  # the first run compiles
        df = spark.createDataFrame([(1, lines(n), "kept")], "doc_id long, text string, __base string")
        began = time.time()
        found = secret_scan.secret_scan(df, np.full(secret_scan.SIZE**2, 5.0)).withColumn("clean", secret_scan.redact(F.col("text"), F.col("secrets")))
        (row,) = found.select(F.size("secrets").alias("n"), F.length("clean").alias("left"), "__base").collect()
        took[n] = time.time() - began
        assert (row.n, row.left, row["__base"]) == (2 * n, n * (2 * len("[secret]") + 2) - 1, "kept")
    assert took[16_000] < 8 * took[2000] + 2


def test_candidates_apart_from_base_spans(spark):
    r = random.Random(3)
    rows = []
    for _ in range(60):
        at, spans = 0, []
        for _ in range(r.randint(0, 8)):
            a = at + r.randint(0, 5)
            at = a + r.randint(1, 6)
            spans.append((a, at, "t"))
        base = sorted((a, a + r.randint(1, 9)) for a in r.sample(range(50), r.randint(0, 6)))
        rows.append((spans, base))
    df = spark.createDataFrame(rows, "spans array<struct<start:int,end:int,token:string>>, base array<struct<start:int,end:int>>")
    got = df.select("spans", "base", secret_scan.apart(F.col("spans"), F.col("base")).alias("free")).collect()
    for x in got:
        assert [tuple(f) for f in x.free] == [tuple(s) for s in x.spans if not any(b.start < s.end and s.start < b.end for b in x.base)]


def test_markov_ratio_by_hand(spark):
    r = random.Random(5)
    model = np.random.default_rng(5).standard_normal(secret_scan.SIZE**2)
    place = {c: i for i, c in enumerate(secret_scan.ALPHABET)}
    tokens = ["".join(r.choices(secret_scan.ALPHABET + "-é", k=r.randint(2, 50))) for _ in range(40)]
    df = spark.createDataFrame([(t,) for t in tokens], "t string")
    for row in df.select("t", secret_scan.mean_llr(F.col("t"), model).alias("m")).collect():
        at = [place.get(c, secret_scan.SIZE - 1) for c in row.t]
        assert abs(row.m - np.mean([model[a * secret_scan.SIZE + b] for a, b in zip(at, at[1:])])) < 1e-9


def test_hot_content_without_ids_is_spread(spark):
    df = spark.range(4000).select(F.lit(None).cast("long").alias("doc_id"), F.when(F.col("id") < 3000, "same").otherwise(F.col("id").cast("string")).alias("text")).repartition(8)
    out = exact_dedup.exact_dedup(df, hot_share=8)
    assert out.where("group_size = 3000 AND keep_id IS NULL AND kept").count() == 3000 and out.count() == 4000
    keep = spark.conf.get("spark.sql.adaptive.enabled")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        sizes = [r["count"] for r in exact_dedup.exact_dedup(df, hot_share=8).groupBy(F.spark_partition_id()).count().collect()]
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", keep)
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert len(sizes) == 4 and max(sizes) < 1.5 * min(sizes)


def test_negated_and_reported_insults_have_no_target():
    lex = toxicity.Lexicon(toxicity.Grammar({"idiot": (2.0, 1.0, 1.0)}, {}, np.zeros(7)))
    score = lambda t: dict(zip(toxicity.FEATURES, np.expm1(toxicity.features(t, lex)).round(6)))
    assert score("you idiot")["targeted"] == 2
    assert score("not you idiot")["targeted"] == 0 and score("not you idiot")["negated"] == 2
    assert score("he said you idiot")["targeted"] == 0 and score("he said you idiot")["reported"] == 2


def licence_texts():
    """label -> the licence with its variable parts filled in and optional parts left out, then with all parts."""
    from sievecraft.llm import license_scan as ls

    out = {}
    for label, (markup,) in ls.LICENCES.items():
        bare = re.sub(r"<<beginOptional>>.*?<<endOptional>>", "", markup, flags=re.S)
        full = markup.replace("<<beginOptional>>", "").replace("<<endOptional>>", "")
        out[label] = [re.sub(r"<<var[^>]*>>", "the Regents and Contributors", t) for t in (bare, full)]
    return out


def test_whole_licences_match_and_altered_ones_do_not():
    from sievecraft.llm import license_scan as ls

    scanner = ls.Scanner({}, ls.LICENCES)
    for label, texts in licence_texts().items():
        for text in texts:
            n, _, spans = scanner.scan("Copyright (c) 2020 A. Person\n\n" + text + "\nend")
            assert [s[2] for s in spans] == [label] and spans[0][1] == n - 1, label
            words = text.split()
            own = [i for i, w in enumerate(words) if len(w) > 4 and w not in ("Regents", "Contributors", "(including", "paragraph)")]
            for i in own[:: max(1, len(own) // 12)]:
                for changed in ([*words[:i], "altered", *words[i + 1 :]], [*words[:i], *words[i + 1 :]]):
                    assert scanner.scan(" ".join(changed))[2] == [], (label, words[i])


def test_two_and_three_clauses_are_told_apart():
    from sievecraft.llm import license_scan as ls

    scanner, texts = ls.Scanner({}, ls.LICENCES), licence_texts()
    assert [[s[2] for s in scanner.scan(texts[k][0])[2]] for k in ("bsd-2-clause", "bsd-3-clause")] == [["bsd-2-clause"], ["bsd-3-clause"]]


def test_typographic_quotes_do_not_hide_a_licence():
    from sievecraft.llm import license_scan as ls

    text = re.sub(r'"([^"]*)"', "\u201c\\1\u201d", licence_texts()["mit"][0])
    assert "\u201c" in text and '"' not in text
    n, places, spans = ls.Scanner({"software to": "x"}, ls.LICENCES).scan("\u201c" + text + "\u201d the \u201csoftware to\u201d")
    assert [s[2] for s in spans] == ["mit"] and places == []
    assert n == len(ls.WORD.findall(("\u201c" + text + "\u201d the \u201csoftware to\u201d").translate(ls.FOLD)))


def test_start_words_over_and_over():
    from sievecraft.llm import license_scan as ls

    scanner = ls.Scanner({}, {**ls.TEMPLATES, **ls.LICENCES})
    text = "permission this redistribution licensed " * 20_000 + licence_texts()["mit"][0]
    begin = time.monotonic()
    n, _, spans = scanner.scan(text)
    assert {s[2] for s in spans} == {"mit", "mit-text"} and n > 80_000 and time.monotonic() - begin < 30


def test_many_listed_hosts(spark):
    """A list of a million hosts, of which the urls ask for some thousands."""
    from sievecraft.llm import url_filter

    blocked = spark.range(1_000_000).selectExpr("CASE WHEN id % 2 = 0 THEN concat('H', id, '.example.org') ELSE concat('site', id, '.net') END AS host")
    blocked = blocked.unionByName(spark.createDataFrame([(None,), ("",), ("h2.example.org",)], "host string"))
    urls = spark.range(6000).selectExpr("id AS page_id", "CASE id % 4 WHEN 0 THEN concat('http://a.h', id, '.example.org/x') WHEN 1 THEN concat('http://site', id, '.net/es/') WHEN 2 THEN concat('http://xsite', id - 1, '.net/') ELSE concat('http://h', id, '.example.org:80/') END AS url")
    got = {r.page_id: (r.rule, r.verdict) for r in url_filter.url_filter(urls, blocked=blocked, bits_per_key=4.0, hashes=2).collect()}
    want = {0: (None, "block"), 1: ("net/es/", "block"), 2: (None, "allow"), 3: (None, "allow")}
    assert len(got) == 6000 and all(v == want[i % 4] for i, v in got.items())
    assert {r.verdict for r in url_filter.url_filter(urls.where("page_id % 4 = 0"), blocked=blocked.where("host IS NULL")).collect()} == {"allow"}
