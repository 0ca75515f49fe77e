"""Trees grown in one task against Spark's own, and what they are drawn with against the JVM."""

import numpy as np
import pytest
from pyspark.ml.classification import GBTClassifier
from pyspark.ml.functions import array_to_vector

from holdfast.operators import boosting, models
from holdfast.plans import catalog
from holdfast.schema import TABLE_ROLES
from holdfast.session import scratch_path


def made(n, seed=5):
    """Labels and rows: columns of two values with opposites and a copy, a constant, counts, and many values."""
    rng = np.random.default_rng(seed)
    two = rng.integers(0, 2, (n, 4)).astype(float)
    x = np.column_stack([
        two, 1 - two[:, :2], two[:, 0], np.full(n, 3.0), rng.integers(0, 9, n), np.round(rng.normal(size=n), 3), np.zeros(n) - 0.0,
        rng.uniform(200, 400, n)])
    y = (x[:, 0] + 0.3 * x[:, 8] + x[:, 9] + rng.normal(size=n) > 2).astype(int)
    return y, x


def estimator(**more):
    return GBTClassifier(labelCol="y", featuresCol="features", checkpointInterval=10, seed=42, **{
        "maxIter": 25, "maxDepth": 5, "stepSize": 0.1, "subsamplingRate": 0.8, "featureSubsetStrategy": "0.8",
        "minInstancesPerNode": 3, "maxBins": 64, **more})


def nodes(spark, model):
    path = scratch_path(spark, "test")
    model.save(path)
    return sorted(spark.read.parquet(f"{path}/data").collect(), key=lambda r: (r.treeID, r.nodeData.id))


@pytest.mark.parametrize("more", [
    {}, {"subsamplingRate": 1.0, "featureSubsetStrategy": "1.0", "minInstancesPerNode": 1, "maxIter": 8}, {"maxDepth": 1, "minInfoGain": 0.01, "maxBins": 300},
])
def test_trees_are_those_of_spark(spark, more):
    y, x = made(700)
    rows = spark.createDataFrame([(int(a), b.tolist()) for a, b in zip(y, x)], "y int, x array<double>").coalesce(1)
    trees = estimator(**more)
    if trees.getMaxBins() > boosting.MOST_BINS:
        trees = trees.setMaxBins(boosting.MOST_BINS)
    theirs = trees.fit(rows.withColumn("features", array_to_vector("x")))
    ours = boosting.fit_alone(trees, rows, x.shape[1])
    assert nodes(spark, ours) == nodes(spark, theirs)
    assert ours.treeWeights == theirs.treeWeights and ours.numFeatures == theirs.numFeatures
    assert {p.name: v for p, v in ours.extractParamMap().items()} == {p.name: v for p, v in theirs.extractParamMap().items()}


def test_draws_are_those_of_the_jvm(spark):
    jvm = spark.sparkContext._jvm
    for seed in (0, 43, -7, 2**40 + 1):
        theirs = jvm.org.apache.spark.util.random.XORShiftRandom(seed)
        assert boosting.uniform(seed, 700).tolist() == [theirs.nextDouble() for _ in range(700)]
        java, ours = jvm.java.util.Random(seed), boosting.JavaRandom(seed)
        assert [ours.long() for _ in range(9)] == [java.nextLong() & boosting.MASK for _ in range(9)]
    x = np.concatenate([np.random.default_rng(1).normal(0, 3, 500), [0.0, -0.0, 1e-12, 0.34, 0.35, -1.0397, 1.04, 700.0, 710.0, -750.0]])
    with np.errstate(over="ignore"):
        assert boosting._exp(x).tolist() == [jvm.java.lang.StrictMath.exp(float(v)) for v in x]


def test_sums_in_another_order_give_the_same_trees(monkeypatch):
    """Shared codes and what a sibling leaves; on rows without ties."""
    rng = np.random.default_rng(9)
    x = np.column_stack([rng.integers(0, 2, (3000, 11)), rng.integers(0, 30, (3000, 2)), rng.normal(size=(3000, 2))]).astype(float)
    y = (x[:, 1] + x[:, 2] + x[:, 13] + rng.normal(size=3000) > 1).astype(float)
    settings = boosting.Settings(12, 4, 0.2, 0.8, 12, 40, 0.0, 7)

    def grown():
        columns = boosting.Columns()
        for at in range(0, 3000, 1000):
            columns.add(y[at:at + 1000], x[at:at + 1000])
        return list(boosting.boosted(columns, settings, 64))

    first = grown()
    monkeypatch.setattr(boosting, "IN_ORDER", 0)
    second = grown()
    assert any(len(t) > 15 for t in first)
    for a, b in zip(first, second, strict=True):
        assert [(n["split"], n["leftChild"], n["rawCount"]) for n in a] == [(n["split"], n["leftChild"], n["rawCount"]) for n in b]
        for part in ("prediction", "impurity", "gain"):
            assert [n[part] for n in a] == pytest.approx([n[part] for n in b], rel=1e-9, abs=1e-12)


def test_many_draws_reach_past_one_lane():
    whole = boosting.uniform(3, 5000)
    assert (boosting.uniform(3, 60) == whole[:60]).all() and len(set(whole.tolist())) == 5000


def test_odd_rows_are_refused(spark):
    for row in ((2, [1.0]), (None, [1.0]), (1, [float("nan")]), (0, [float("inf")])):
        rows = spark.createDataFrame([row, (1, [0.0])], "y int, x array<double>")
        with pytest.raises(Exception, match="label must be 0 or 1"):
            boosting.fit_alone(estimator(maxIter=1), rows, 1)


def test_one_value_and_one_row(spark):
    rows = spark.createDataFrame([(1, [4.0, 4.0])], "y int, x array<double>")
    model = boosting.fit_alone(estimator(maxIter=3), rows, 2)
    assert [t.numNodes for t in model.trees] == [1, 1, 1]


def test_a_fit_that_one_task_takes_runs_no_job_for_a_level(spark, sf, monkeypatch):
    frame = models.with_label(catalog.cleaned(spark, sf), TABLE_ROLES).persist()

    def refuse(*_):
        raise AssertionError("fitted by jobs")

    monkeypatch.setattr(models.GBTClassifier, "fit", refuse)
    model = models.fit_boosted(frame, TABLE_ROLES, {"trees": 4})
    assert model.model.getNumTrees == 4 and model.probability(frame).count() == 150
    monkeypatch.setattr(models, "BINS_PER_TASK", 150 * len(model.names) - 1)
    with pytest.raises(AssertionError, match="by jobs"):
        models.fit_boosted(frame, TABLE_ROLES, {"trees": 4})
    frame.unpersist()


def test_folds_are_scored_once(spark, sf, monkeypatch):
    """The calibrator's passes read kept scores; none stay behind."""
    frame, seen, fit = models.with_label(catalog.cleaned(spark, sf), TABLE_ROLES), [], models.fit_calibrator
    monkeypatch.setattr(models, "fit_calibrator", lambda rows: seen.append(rows._jdf.queryExecution().executedPlan().toString()) or fit(rows))
    before = len(spark.sparkContext._jsc.getPersistentRDDs())
    models.fit_calibrated(frame, TABLE_ROLES, {"trees": 2, "depth": 2}, folds=3)
    assert seen[0].count("InMemoryTableScan") >= 3
    assert len(spark.sparkContext._jsc.getPersistentRDDs()) == before
