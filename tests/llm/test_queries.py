"""Every opN query over the small tables: against its SQL, or against a plain statement of its contract."""

import hashlib
import re
import zlib
from collections import defaultdict

import duckdb
import numpy as np
import pyarrow.parquet as pq
import pytest

from sievecraft.llm import packing
from sievecraft.llm.queries import QUERIES, SQL

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def texts():
    t = pq.read_table(f"{SF}/documents.parquet", columns=["doc_id", "text"])
    return dict(zip(t["doc_id"].to_pylist(), [x or "" for x in t["text"].to_pylist()]))


def run(spark, number):
    (name,) = [q for q in QUERIES if q.startswith(f"op{number}_")]
    return name, QUERIES[name](spark, SF)


def sha(t):
    return hashlib.sha256(t.encode()).hexdigest()


@pytest.mark.parametrize("number", [2, 3, 7, 10])
def test_against_sql(spark, number):
    name, df = run(spark, number)
    con = duckdb.connect()
    for t in ("documents", "pages"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    want = con.sql(SQL[name])
    names = sorted(df.columns)
    assert names == sorted(want.columns)
    at = [want.columns.index(c) for c in names]
    assert sorted(tuple(r[c] for c in names) for r in df.collect()) == sorted(tuple(r[i] for i in at) for r in want.fetchall())


def test_op1(spark, texts):
    rows = {r.doc_id: r for r in run(spark, 1)[1].collect()}
    labels = {r["doc_id"]: r["toxic"] for r in pq.read_table(f"{SF}/labels.parquet").to_pylist()}
    assert set(rows) == set(texts)
    for i, r in rows.items():
        assert r.held_out == (zlib.crc32(str(i).encode()) % 5 == 0) and 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5)
    known = [i for i in labels if labels[i] is not None and i in rows]
    assert np.mean([rows[i].predicted == labels[i] for i in known]) > 0.8


def test_op4(spark):
    rows = run(spark, 4)[1].collect()
    t = pq.read_table(f"{SF}/embeddings.parquet").to_pylist()
    assert len(rows) == len(t)
    good = {r["vec_id"]: np.array(r["embedding"], dtype=float) for r in t if r["label"] is not None and r["embedding"] and None not in r["embedding"] and np.isfinite(r["embedding"]).all() and any(r["embedding"])}
    label = {r["vec_id"]: r["label"] for r in t}
    ids = sorted(good)
    x = np.stack([good[i] / np.linalg.norm(good[i]) for i in ids])
    linked = (x @ x.T >= 0.98) & (np.array([label[i] for i in ids])[:, None] == np.array([label[i] for i in ids])[None])
    np.fill_diagonal(linked, False)
    links = dict(zip(ids, linked.sum(axis=1).tolist()))
    got = {r.vec_id: r for r in rows}
    assert all(r.n_links <= links.get(i, 0) and r.kept == (i == r.component_id) for i, r in got.items())
    assert sum(r.n_links for r in rows) >= 0.99 * sum(links.values())


def test_op5(spark, texts):
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=packing.tokenizer_path("piece_bpe_32k.model"))
    rows = {r.doc_id: r for r in run(spark, 5)[1].collect()}
    assert set(rows) == set(texts)
    for i, t in texts.items():
        pieces = sp.encode(t, return_type="proto").pieces
        ids = [p.id for p in pieces]
        assert (rows[i].n_tokens, rows[i].ids_sha256, rows[i].decoded_sha256) == (len(ids), sha(",".join(map(str, ids))), sha(sp.decode(ids)))
        assert rows[i].spans_crc32 == zlib.crc32(np.array([x for p in pieces for x in (p.begin, p.end)], dtype="<u4").tobytes())


def folded(t):
    return "".join(c.lower() if c.isascii() else c for c in t)


def test_op6(spark, texts):
    phrases = {"mit license": "mit", "apache license": "apache", "general public license": "gpl"}
    rows = {r.doc_id: r for r in run(spark, 6)[1].collect()}
    for i, t in texts.items():
        w = re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", folded(t))
        found = [(k, label) for p, label in phrases.items() for k in range(len(w)) if w[k : k + len(p.split())] == p.split()]
        starts = [k for k, _ in found]
        r = rows[i]
        assert (r.n_words, r.n_base, r.first_word, r.last_word) == (len(w), len(found), min(starts, default=None), max(starts, default=None))
        assert r.base_labels == ",".join(sorted({x for _, x in found})) and set(r.base_labels.split(",")) <= set(r.labels.split(",")) | {""}
        assert 0 <= r.score <= 1 and r.labels == ",".join(sorted(set(r.labels.split(",")) - {""}))


def test_op8(spark, texts):
    assign = re.compile(r"((?:password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+))", re.I | re.A)
    rows = {r.doc_id: r for r in run(spark, 8)[1].collect()}
    for i, t in texts.items():
        found = [(m.start(), 0, m.end(), "assign") for m in assign.finditer(t) if len(m[2]) >= 12]
        found += [(m.start(), 1, m.end(), "access") for m in re.finditer("AKIA[A-Z0-9]+", t) if len(m[0]) >= 18]
        found += [(m.start(), 2, m.end(), "hex") for m in re.finditer("[0-9a-f]+", t) if len(m[0]) >= 16]
        base = [f"{k}:{a}:{b}" for a, _, b, k in sorted(found)]
        r = rows[i]
        assert (r.n_assign, r.n_access, r.n_hex) == tuple(sum(f[3] == k for f in found) for k in ("assign", "access", "hex"))
        assert r.base_sha256 == sha(",".join(base)) and set(base) <= set(r.spans.split(","))


def test_op9(spark, texts):
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(packing.tokenizer_path("byte_bpe_50k.json"))
    pieces, sequences = defaultdict(list), defaultdict(list)
    for r in run(spark, 9)[1].collect():
        pieces[r.doc_id].append(r)
        sequences[r.sequence_id].append((r.offset, r.length))
    assert set(pieces) == set(texts)
    total = 0
    for i, t in texts.items():
        ids = np.array([*tok.encode(t, add_special_tokens=False).ids, 0], dtype="<u4")
        total += len(ids)
        at = 0
        for k, r in enumerate(sorted(pieces[i], key=lambda r: r.piece)):
            assert (r.piece, r.start) == (k, at) and r.ids_crc32 == zlib.crc32(ids[at : at + r.length].tobytes()) and (r.length == 2048 or not k)
            at += r.length
        assert at == len(ids) and (len(pieces[i]) == 1 or len(ids) > 2048)
    for spots in sequences.values():
        spots.sort()
        assert [o for o, _ in spots] == [sum(n for _, n in spots[:k]) for k in range(len(spots))] and sum(n for _, n in spots) <= 2048
    assert len(sequences) <= -(-total // 2048) + 1


def test_very_long_texts(spark):
    """Texts of a megabyte and more go through every operator whole."""
    from sievecraft.llm import exact_dedup, license_scan, ngram_join, secret_scan, sentencepiece_codec, substring_dedup, toxicity
    from pyspark.sql import functions as F

    w = " ".join(f"w{i * 7919 % 50021}" for i in range(180_000))
    end = " released under the MIT License token = \"abcdefghijklmnop\" you idiot"
    df = spark.createDataFrame([(1, w + end), (2, w + end + " more"), (3, "short")], "doc_id long, text string")
    near = {r.doc_id: r.component_id for r in ngram_join.jaccard_components(df).collect()}
    assert near == {1: 1, 2: 1, 3: 3}
    gone = {r.doc_id: (r.n_words, r.n_removed) for r in substring_dedup.substring_dedup(df).collect()}
    n = len((w + end).split())
    assert gone == {1: (n, 0), 2: (n + 1, n), 3: (1, 0)}
    assert sorted(r.group_size for r in exact_dedup.exact_dedup(df).collect()) == [1, 1, 1]
    assert {r.doc_id: [p.label for p in r.licenses.places] for r in license_scan.license_scan(df).collect()} == {1: ["mit"], 2: ["mit"], 3: []}
    found = {r.doc_id: r for r in secret_scan.secret_scan(df, np.zeros(secret_scan.SIZE**2)).withColumn("clean", secret_scan.redact(F.col("text"), F.col("secrets"))).collect()}
    assert found[1].clean == found[1].text.replace('token = "abcdefghijklmnop', "[secret]")
    ids = {r.doc_id: r for r in sentencepiece_codec.encode_documents(df).collect()}
    assert ids[1].ends[-1] == len((w + end).encode()) and len(ids[1].ids) > 180_000
    lengths = defaultdict(int)
    for r in packing.pack(df).collect():
        lengths[r.doc_id] += r.length
    assert lengths[3] == 2 and lengths[1] > 180_000
    grammar = toxicity.Grammar({"idiot": (9.0, 1.0, 1.0)}, {}, np.array([-3.0, 0.0, 2.0, 0.0, 0.0, 0.0, 0.0]))
    assert {r.doc_id: r.predicted for r in toxicity.score_toxicity(df, grammar).collect()} == {1: 1, 2: 1, 3: 0}
