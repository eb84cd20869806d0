"""What ngram_tfidf writes between its stages: sums per document instead of all weights, and no term of frequent rows."""

import math

import duckdb

from sievecraft import registry
from sievecraft.functions import text

registry.load()
SF = "/root/testdata/sf0.001"


def test_weights_are_not_dealt_by_document(spark, monkeypatch):
    monkeypatch.setattr(text, "BROADCAST_TERMS", 0)
    out = registry.QUERIES["ngram_tfidf"](spark, SF)
    plan = out._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0]
    assert "Window" not in plan and plan.count("MapInArrow ") == 1
    # what is dealt for the join has a key, which frequent terms lack, and not the term beside it
    dealt = next(a.strip() for a, b in zip(plan.split("\n")[1:], plan.split("\n")) if "Exchange hashpartitioning(__key" in b)
    assert "__key" in dealt and " term#" not in dealt.split("[", 1)[1].split("CASE", 1)[0]
    con = duckdb.connect()
    con.sql(f"CREATE VIEW documents AS SELECT * FROM '{SF}/documents.parquet'")
    wanted = {r[0]: r[1:] for r in con.sql(registry.ORACLES["ngram_tfidf"]).fetchall()}
    got = {r.doc_id: (r.n, r.top, r.total) for r in out.collect()}
    assert got.keys() == wanted.keys() and len(got) > 100
    assert all(got[k][0] == wanted[k][0] and math.isclose(got[k][1], wanted[k][1], abs_tol=2e-6) and math.isclose(got[k][2], wanted[k][2], abs_tol=2e-4) for k in got)
