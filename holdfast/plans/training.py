"""From a cleaned customer frame to a saved model, threshold and evaluation."""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass

from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession, functions as F

from holdfast import constants as K
from holdfast.operators.attribution import global_attribution
from holdfast.operators.evaluate import best_candidate, calibration_curve, evaluation_table, miss_change
from holdfast.operators.models import (
    Classifier, candidate_results, fit_calibrated, fit_logistic, run_parallel, with_label,
)
from holdfast.operators.policy import Offer, best_threshold, policy_value
from holdfast.operators.split import assign_parts, find_cuts, holdout_quotas
from holdfast.schema import Roles
from holdfast.sources.files import write_record

BOOSTED, LOGISTIC = "boosted", "logistic"


@dataclass
class TrainingRun:
    model: Classifier
    baseline: Classifier
    threshold: float
    baseline_threshold: float
    params: dict
    candidates: DataFrame
    thresholds: DataFrame
    evaluation: DataFrame
    financial: DataFrame
    misses: DataFrame
    attribution: DataFrame
    calibration: DataFrame
    dataset: DataFrame

    def save(self, path: str, run_id: str) -> None:
        """The models, and the run's small results as tables keyed by run id."""
        spark = self.dataset.sparkSession
        self.model.save(spark, f"{path}/models/{run_id}/{BOOSTED}")
        self.baseline.save(spark, f"{path}/models/{run_id}/{LOGISTIC}")
        for name in ("candidates", "thresholds", "evaluation", "financial", "misses",
                     "attribution", "calibration", "dataset"):
            write_record(getattr(self, name), f"{path}/{name}", run_id)
        chosen = [(name, float(value)) for name, value in sorted(self.params.items())]
        write_record(
            spark.createDataFrame(chosen, "parameter string, value double"), f"{path}/parameters", run_id
        )


def saved_threshold(spark: SparkSession, path: str, run_id: str,
                    model: str = BOOSTED) -> float:
    """The operating threshold of a run; one half if the run saved none."""
    from pyspark.errors import AnalysisException

    try:
        rows = spark.read.parquet(f"{path}/thresholds")
    except AnalysisException:
        return K.DEFAULT_THRESHOLD
    found = rows.where((F.col("run_id") == run_id) & (F.col("model") == model)).take(2)
    if len(found) > 1:
        raise ValueError(f"run {run_id} has more than one threshold for {model}")
    return found[0]["threshold"] if found else K.DEFAULT_THRESHOLD


def split_frame(df: DataFrame, roles: Roles, seed: int = K.SEED) -> DataFrame:
    """Adds ``part``: 0 fit, 1 validation, 2 test. Stratified, sizes exact."""
    labelled = with_label(df, roles)
    outer = assign_parts(labelled, "y", roles.key, holdout_quotas(K.TEST_FRACTION), seed, "_outer")
    train = outer.where("_outer = 0")
    # Another seed, or the validation cut would fall on the same hash order.
    inner = find_cuts(train, "y", roles.key, holdout_quotas(0.20), seed + 1).part()
    return outer.withColumn("part", F.when(F.col("_outer") == 1, 2).otherwise(inner)).drop("_outer")


def misses(evaluation: DataFrame) -> DataFrame:
    """False negatives of both models under both policies, and the change."""
    def fn(model: str, default: bool):
        at_half = F.col("policy") == ("default" if default else "cost")
        return F.max(F.when((F.col("model") == model) & at_half, F.col("fn")))

    return evaluation.agg(
        miss_change(fn(LOGISTIC, False), fn(BOOSTED, False)).alias("reduction_pct_cost_policies"),
        miss_change(fn(LOGISTIC, True), fn(BOOSTED, True)).alias("reduction_pct_both_at_half"),
    )


def train(df: DataFrame, roles: Roles, candidates: Iterable[dict] = K.BOOSTING_CANDIDATES,
          folds: int = K.CALIBRATION_FOLDS, offer: Offer = Offer(),
          seed: int = K.SEED) -> TrainingRun:
    """Select, calibrate, choose the threshold on validation rows, refit on the
    whole training part and evaluate once on the test part."""
    candidates = list(candidates)
    spark = df.sparkSession
    parts = split_frame(df, roles, seed).persist(StorageLevel.MEMORY_AND_DISK)
    try:
        fit, valid = parts.where("part = 0"), parts.where("part = 1")
        full, test = parts.where("part < 2"), parts.where("part = 2")

        fitted: dict[int, Classifier] = {}
        results = candidate_results(fit, valid, roles, candidates, seed, fitted)
        chosen = best_candidate(results).first()["candidate"]
        params = candidates[chosen]

        def choose(model: Classifier):
            scored = model.probability(valid)
            return best_threshold(scored, offer, monthly=roles.monthly).first()

        # The threshold comes from the fits on the fit part; those on the whole training
        # part need the chosen candidate only, so all of them run side by side.
        to_choose, model, to_choose_base, baseline = run_parallel(spark, [
            lambda: fit_calibrated(fit, roles, params, folds, seed, fitted[chosen]),
            lambda: fit_calibrated(full, roles, params, folds, seed),
            lambda: fit_logistic(fit, roles),
            lambda: fit_logistic(full, roles),
        ])
        boosted_choice, logistic_choice = choose(to_choose), choose(to_choose_base)

        columns = ["y", "p", roles.monthly]
        scored = model.probability(test).select(*columns).persist(StorageLevel.MEMORY_AND_DISK)
        scored_base = baseline.probability(test).select(*columns).persist(StorageLevel.MEMORY_AND_DISK)
        table = evaluation_table(
            {
                BOOSTED: (scored, boosted_choice["threshold"]),
                LOGISTIC: (scored_base, logistic_choice["threshold"]),
            }
        )
        dataset = parts.agg(
            F.count(F.lit(1)).alias("dataset_rows"),
            F.lit(len(roles.categorical) + 3).alias("feature_count"),
            F.avg("y").alias("churn_rate"),
            F.count_if(F.col("part") == 2).alias("test_rows"),
        )
        evaluation = _small(table)
        run = TrainingRun(
            model, baseline, boosted_choice["threshold"], logistic_choice["threshold"],
            {**K.BOOSTING_DEFAULT, **params}, results,
            spark.createDataFrame(
                [(BOOSTED, boosted_choice["threshold"], boosted_choice["net_value"]),
                 (LOGISTIC, logistic_choice["threshold"], logistic_choice["net_value"])],
                "model string, threshold double, validation_net_value double",
            ),
            evaluation,
            _small(policy_value(scored, boosted_choice["threshold"], offer, monthly=roles.monthly)),
            _small(misses(evaluation)),
            # The test rows lie in as few parts as the split left; explaining them is the longest pass.
            _small(global_attribution(test.repartition(spark.sparkContext.defaultParallelism), model)),
            _small(calibration_curve(scored)),
            _small(dataset),
        )
        scored.unpersist()
        scored_base.unpersist()
        return run
    finally:
        parts.unpersist()


def _small(df: DataFrame) -> DataFrame:
    """A result of a few rows, cut loose from its inputs."""
    return df.sparkSession.createDataFrame(df.collect(), df.schema)
