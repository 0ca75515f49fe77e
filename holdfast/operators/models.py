"""Fitting, calibrating and selecting the attrition classifiers."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Sequence
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, replace
from math import ceil

from pyspark import StorageLevel, inheritable_thread_target
from pyspark.ml.classification import (
    GBTClassificationModel, GBTClassifier, LogisticRegression, LogisticRegressionModel,
)
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import IsotonicRegression, IsotonicRegressionModel
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from holdfast import constants as K
from holdfast.functions.cleaning import label_flag
from holdfast.operators import boosting
from holdfast.operators.design import Design, fit_design, with_inputs
from holdfast.operators.evaluate import evaluate
from holdfast.operators.isotonic import isotonic_steps
from holdfast.operators.split import assign_parts, fold_quotas
from holdfast.schema import Roles
from holdfast.session import ensure_checkpoint_dir

# A boosted fit is one task, or else thousands of short jobs: several side by side fill the cores.
PARALLEL_FITS = 8
# The most rows, and bins of them, that one task grows trees on; a task then holds some 0.5 GB.
ROWS_PER_TASK, BINS_PER_TASK = 2_000_000, 100_000_000
# Of more rows: those for which a part of a boosting job is worth its task, and the most for one.
ROWS_PER_PART, MOST_ROWS_PER_TASK = 40_000, 500_000


def with_label(df: DataFrame, roles: Roles) -> DataFrame:
    return df.withColumn("y", label_flag(roles.label, roles.positive))


@dataclass
class Classifier:
    """A fitted design and model, and the calibrator of the probabilities if any."""

    design: Design
    model: GBTClassificationModel | LogisticRegressionModel
    calibrator: IsotonicRegressionModel | None = None

    @property
    def roles(self) -> Roles:
        return self.design.roles

    @property
    def names(self) -> list[str]:
        return self.design.names

    def raw_probability(self, df: DataFrame) -> DataFrame:
        """The frame with the uncalibrated probability ``p``."""
        scored = self.model.transform(self.design.transform(with_inputs(df, self.roles)))
        return _with_p(scored, df.columns, vector_to_array("probability")[1])

    def probability(self, df: DataFrame) -> DataFrame:
        raw = self.raw_probability(df)
        if self.calibrator is None:
            return raw
        out = self.calibrator.transform(raw.withColumnRenamed("p", "raw_p"))
        return _with_p(out, df.columns, F.col("calibrated"))

    def encoded(self, df: DataFrame) -> DataFrame:
        """The key and the encoded row ``x``."""
        return with_inputs(df, self.roles).select(self.roles.key, self.design.row().alias("x"))

    def save(self, spark: SparkSession, path: str) -> None:
        self.design.save(spark, f"{path}/design")
        self.model.write().overwrite().save(f"{path}/model")
        if self.calibrator is not None:
            self.calibrator.write().overwrite().save(f"{path}/calibrator")

    @classmethod
    def load(cls, spark: SparkSession, path: str, roles: Roles, kind: str = "boosted") -> Classifier:
        """``kind`` is 'boosted' (with a calibrator), 'uncalibrated' or 'logistic'."""
        reader = LogisticRegressionModel if kind == "logistic" else GBTClassificationModel
        calibrator = None
        if kind == "boosted":
            calibrator = IsotonicRegressionModel.load(f"{path}/calibrator")
        return cls(Design.load(spark, f"{path}/design", roles), reader.load(f"{path}/model"), calibrator)


def _with_p(scored: DataFrame, columns: Sequence[str], p: Column) -> DataFrame:
    return scored.select(*columns, p.alias("p"))


def spread(encoded: DataFrame) -> DataFrame:
    """Encoded rows from the shared folder, in equal parts for the cores there are.

    For more rows than one task takes, boosting runs a job for each level of each tree.
    Each of these jobs would look through all exchanges behind the rows, and have as many
    tasks as the last of them was coalesced to. Few rows stay in one part, in order.
    """
    spark = encoded.sparkSession
    ensure_checkpoint_dir(spark)
    rows, cores = encoded.count(), spark.sparkContext.defaultParallelism
    parts = max(1, min(ceil(rows / min(ROWS_PER_TASK, ROWS_PER_PART)), cores), ceil(rows / MOST_ROWS_PER_TASK))
    return (encoded.coalesce(1) if parts == 1 else encoded.repartition(parts)).checkpoint()


def fit_boosted(df: DataFrame, roles: Roles, params: dict | None = None,
                seed: int = K.SEED) -> Classifier:
    """Boosted trees on the one-hot design, uncalibrated. ``df`` has ``y``.

    Rows that fit a task are grown there, without a job for each level of each tree;
    Spark's own fit over parts takes more.

    Spark's boosting has no L1/L2 leaf penalty, counts rows where others sum
    Hessians, and samples columns per node; see the README for the mapping.
    """
    v = {**K.BOOSTING_DEFAULT, **(params or {})}
    trees = GBTClassifier(
        labelCol="y", featuresCol="features", maxIter=v["trees"], maxDepth=v["depth"],
        stepSize=v["rate"], subsamplingRate=v["row_sample"],
        featureSubsetStrategy=str(v["column_sample"]), minInstancesPerNode=v["min_rows"],
        minInfoGain=v["min_gain"], maxBins=v.get("bins", 64), seed=seed, checkpointInterval=10,
    )
    rows = with_inputs(df, roles)
    design = fit_design(rows, roles)
    width, n = len(design.names), rows.count()
    if 0 < n <= ROWS_PER_TASK and n * width <= BINS_PER_TASK and trees.getMaxBins() <= boosting.MOST_BINS:
        return Classifier(design, boosting.fit_alone(trees, rows.select("y", design.row().alias("x")), width))
    return Classifier(design, trees.fit(spread(design.transform(rows).select("y", "features"))))


def balanced_weights(df: DataFrame, y: str = "y") -> tuple[DataFrame, int]:
    """The frame with a ``weight`` that gives each class half of the total, and
    its row count. Two counts reach the driver."""
    n, pos = df.agg(F.count(F.lit(1)), F.count_if(F.col(y) == 1)).first()
    if pos in (0, n):
        raise ValueError("both classes are needed")
    weight = F.when(F.col(y) == 1, n / (2.0 * pos)).otherwise(n / (2.0 * (n - pos)))
    return df.withColumn("weight", weight), n


def fit_logistic(df: DataFrame, roles: Roles, c: float = K.LOGISTIC_C,
                 max_iter: int = K.LOGISTIC_MAX_ITER) -> Classifier:
    """L2 logistic model with balanced class weights on scaled numerics.

    The total weight equals the row count, so the penalty 1/(C n) reproduces an
    objective of C times the summed loss plus half the squared norm.
    """
    weighted, rows = balanced_weights(df)
    model = LogisticRegression(
        labelCol="y", featuresCol="features", weightCol="weight", regParam=1.0 / (c * rows),
        elasticNetParam=0.0, standardization=False, maxIter=max_iter, tol=1e-6,
    )
    inputs = with_inputs(weighted, roles)
    design = fit_design(inputs, roles, scale=True)
    return Classifier(design, model.fit(design.transform(inputs).select("y", "weight", "features")))


def fit_calibrator(out_of_fold: DataFrame) -> IsotonicRegressionModel:
    """Monotone map from raw probability to observed rate, straight between blocks.

    The steps are found on the executors; Spark's own fit, which ends on the driver,
    gets the two ends of each step and has nothing left to pool.
    """
    end = F.explode(F.array_distinct(F.array("low", "high"))).alias("raw_p")
    ends = isotonic_steps(out_of_fold).select(end, "rate", F.lit(1.0).alias("w"))
    return IsotonicRegression(
        featuresCol="raw_p", labelCol="rate", weightCol="w", predictionCol="calibrated", isotonic=True
    ).fit(ends)


def run_parallel(spark: SparkSession, jobs: Sequence[Callable[[], object]]) -> list:
    """A few independent fits at a time; Spark shares the executors.

    Each fit caches its own encoded rows. Where one fills the cluster's memory,
    set spark.holdfast.parallelFits to 1.
    """
    inherit = inheritable_thread_target(spark)
    workers = int(spark.conf.get("spark.holdfast.parallelFits", str(PARALLEL_FITS)))
    with ThreadPoolExecutor(max_workers=workers) as pool:
        futures = [pool.submit(inherit(job)) for job in jobs]
        return [f.result() for f in futures]


def fit_calibrated(df: DataFrame, roles: Roles, params: dict | None = None,
                   folds: int = K.CALIBRATION_FOLDS, seed: int = K.SEED,
                   base: Classifier | None = None) -> Classifier:
    """Out-of-fold scores from stratified folds fit one calibrator; the trees
    are fitted on all rows, unless ``base`` has been fitted on the same rows already."""
    parted = assign_parts(df, "y", roles.key, fold_quotas(folds), seed, "fold").persist(
        StorageLevel.MEMORY_AND_DISK
    )
    kept: list[DataFrame] = []
    try:
        def held_out(i: int):
            """Scored once, while other folds are fitted; the calibrator passes over them thrice."""
            fold_model = fit_boosted(parted.where(F.col("fold") != i), roles, params, seed)
            scores = fold_model.raw_probability(parted.where(F.col("fold") == i)).select("y", "p")
            kept.append(scores.persist(StorageLevel.MEMORY_AND_DISK))
            scores.count()
            return scores

        whole, *scored = run_parallel(
            df.sparkSession,
            [lambda: base or fit_boosted(parted, roles, params, seed)]
            + [lambda i=i: held_out(i) for i in range(folds)],
        )
        pooled = scored[0]
        for part in scored[1:]:
            pooled = pooled.unionByName(part)
        return replace(whole, calibrator=fit_calibrator(pooled))
    finally:
        for frame in (parted, *kept):
            frame.unpersist()


def candidate_results(fit: DataFrame, valid: DataFrame, roles: Roles,
                      candidates: Iterable[dict] = K.BOOSTING_CANDIDATES,
                      seed: int = K.SEED, fitted: dict[int, Classifier] | None = None) -> DataFrame:
    """Validation accuracy at 0.50 and ranking quality, one row per candidate.

    ``fitted`` takes the candidates' models by number, for a caller that goes on with one.
    """
    candidates = list(candidates)
    fitted = {} if fitted is None else fitted

    def assess(i: int):
        model = fitted[i] = fit_boosted(fit, roles, candidates[i], seed)
        scored = model.raw_probability(valid).select("y", "p").persist(StorageLevel.MEMORY_AND_DISK)
        row = evaluate(scored, [0.5]).select("accuracy", "roc_auc").first()
        scored.unpersist()
        return i, row["accuracy"], row["roc_auc"]

    rows = run_parallel(fit.sparkSession, [lambda i=i: assess(i) for i in range(len(candidates))])
    return fit.sparkSession.createDataFrame(
        rows, "candidate int, accuracy double, roc_auc double"
    )
