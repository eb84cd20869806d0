from sievecraft import registry


def test_model_classes_score_in_one_pass(spark):
    """All models score the validation rows in one scan of the table."""
    registry.load()
    out = registry.QUERIES["model_classes"](spark, "/root/testdata/sf0.001")
    assert out._jdf.queryExecution().optimizedPlan().toString().count("Relation") == 1
    assert out.columns == ["accuracy", "f1", "fairness", "rows", "model"] and out.count() == 7
