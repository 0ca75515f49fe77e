"""The whole flow on the small tables: train, save, score, stream."""

import pytest
from pyspark.sql import functions as F

from holdfast.operators import models
from holdfast.plans import catalog, scoring, training
from holdfast.plans.loading import score_table
from holdfast.schema import TABLE_ROLES
from holdfast.streaming import live

AT = "2024-03-04 05:06:07"


@pytest.fixture(scope="module")
def run(spark, sf):
    return training.train(
        catalog.cleaned(spark, sf), TABLE_ROLES,
        [{"trees": 2, "depth": 2, "rate": 0.3}, {"trees": 3, "depth": 2, "rate": 0.3}], folds=3)


def test_run_reports(run):
    assert 0.05 <= run.threshold <= 0.95 and 0.05 <= run.baseline_threshold <= 0.95
    rows = run.evaluation.collect()
    assert {(r.model, r.policy) for r in rows} == {
        (m, p) for m in ("boosted", "logistic") for p in ("default", "cost")}
    assert all(r.tp + r.fp + r.fn + r.tn == 30 for r in rows)
    dataset = run.dataset.first()
    assert (dataset.dataset_rows, dataset.feature_count, dataset.test_rows) == (150, 19, 30)
    money = run.financial.first()
    assert money.savings_vs_do_nothing == money.retention_policy_net_value
    assert run.attribution.count() == 51
    assert run.misses.count() == 1
    # The curve of the chosen model on the test rows.
    assert sum(r.n for r in run.calibration.collect()) == 30


def test_saved_run(spark, run, sf, tmp_path):
    run.save(str(tmp_path), "r1")
    assert training.saved_threshold(spark, str(tmp_path), "r1") == run.threshold
    assert training.saved_threshold(spark, str(tmp_path), "other") == 0.5
    assert training.saved_threshold(spark, str(tmp_path / "none"), "r1") == 0.5
    assert spark.read.parquet(f"{tmp_path}/calibration").where("run_id = 'r1'").count() == run.calibration.count()
    loaded = models.Classifier.load(spark, f"{tmp_path}/models/r1/boosted", TABLE_ROLES)
    frame = catalog.cleaned(spark, sf)
    assert (scoring.score_active(frame, loaded, AT).orderBy("customer_id").collect()
            == scoring.score_active(frame, run.model, AT).orderBy("customer_id").collect())


def test_only_active_customers_are_scored(spark, sf, run):
    scores = scoring.score_active(catalog.cleaned(spark, sf), run.model, AT, run.threshold)
    assert scores.count() == catalog.customers(spark, sf).where("churn = 'No'").count()
    wrong = scores.where(
        (F.col("churn_probability") > 0.6001) & (F.col("risk_level") != "High")
        | (F.col("churn_probability") < 0) | (F.col("churn_probability") > 1))
    assert wrong.count() == 0


def test_stream_equals_batch(spark, sf, run, tmp_path):
    raw = catalog.raw_records(spark, sf)
    raw.repartition(4).write.option("header", True).csv(str(tmp_path / "in"))
    table = score_table(spark, str(tmp_path / "db"))
    for _ in range(2):  # the second start finds nothing new
        live.start_scoring(
            live.arriving_records(spark, str(tmp_path / "in"), files_per_batch=2), run.model, table, AT,
            str(tmp_path / "checkpoint"), run.threshold, available_now=True).awaitTermination()
    streamed = sorted(map(repr, table.read().collect()))
    batch = live.predict(raw, run.model, AT, run.threshold)
    assert streamed == sorted(map(repr, batch.drop("tier").collect()))
    assert len(streamed) == 150
    assert {r.tier for r in batch.select("tier").distinct().collect()} <= {"critical", "elevated", "safe"}
