"""RFE by a score that is each feature's own."""

import pytest

from sievecraft import registry
from sievecraft.operators import rank as rk

registry.load()


@pytest.mark.parametrize("name", ["strategy16_rfe_logistic", "strategy16_rfe_tree"])
def test_rfe_ranks_once(spark, monkeypatch, name):
    """A feature's F doesn't depend on the others, so the table is read for it once."""
    asked, ranked = [], rk.rank_anova_f
    monkeypatch.setattr(rk, "rank_anova_f", lambda df, names, label: asked.append(len(names)) or ranked(df, names, label))
    got = registry.QUERIES[name](spark, "/root/testdata/sf0.001").count()
    assert got == 16 and asked == [16]
