from holdfast.plans import catalog, training
from holdfast.schema import TABLE_ROLES


def test_the_test_rows_are_explained_on_all_cores(spark, sf, monkeypatch):
    parts, explain = [], training.global_attribution
    monkeypatch.setattr(training, "global_attribution", lambda df, model: parts.append(df.rdd.getNumPartitions()) or explain(df, model))
    run = training.train(catalog.cleaned(spark, sf), TABLE_ROLES, [{"trees": 2, "depth": 2}], folds=2)
    assert parts == [spark.sparkContext.defaultParallelism] and run.attribution.count() == 51
