import numpy as np
import pytest
from pyspark.sql import functions as F

from sievecraft.llm import exact_dedup, ngram_join


@pytest.mark.parametrize("most", [0, 10])
def test_only_texts_that_occur_again_are_combined(spark, monkeypatch, most):
    """Unique texts need no combining; beyond the limit of the broadcast all rows are combined, with the same result."""
    docs = spark.createDataFrame([(i, None if i in (3, 4) else f"text {i if i > 5 else i % 2}") for i in range(40)], "doc_id long, text string")
    combined, winners = [], exact_dedup.winners
    monkeypatch.setattr(exact_dedup, "winners", lambda rows, *a: combined.append(rows.count()) or winners(rows, *a))
    monkeypatch.setattr(exact_dedup, "BROADCAST_DIGESTS", most)
    got = {r.doc_id: (r.keep_id, r.group_size, r.kept) for r in exact_dedup.exact_dedup(docs).collect()}
    assert combined == [6 if most else 40]
    groups = [(0, 2), (1, 5), (3, 4)]
    assert got == {i: (i, 1, True) for i in range(6, 40)} | {i: (max(g), 2, i == max(g)) for g in groups for i in g}


@pytest.mark.parametrize("n", [300, 600])
def test_sketches_rule_out_sets_far_from_linked(n):
    """Sets of some hundred tokens of which 0.6 are shared are no plausible pairs at 0.8; those of 0.8 are."""
    rng = np.random.default_rng(n)
    kept = lambda similarity: int(2 * similarity / (1 + similarity) * n) + 1
    sets = [rng.integers(0, 2**63, n).astype(np.uint64)]
    sets += [np.r_[sets[0][: kept(s)], rng.integers(0, 2**63, n - kept(s)).astype(np.uint64)] for s in [0.8] + [0.6] * 40]
    x = np.stack([np.frombuffer(ngram_join.sketch(s), dtype=np.uint8) for s in sets]).astype(np.int16)
    found, (i, j) = ngram_join.plausible_in_block(np.arange(len(sets)), np.full(len(sets), n), x, np.full(len(sets), -1), 0.8)
    assert (0, 1) in set(zip(i.tolist(), j.tolist()))
    assert found[2:].sum() == 0
