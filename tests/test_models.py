import itertools
import math

import numpy as np
import pytest
from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from holdfast.functions.cleaning import clean
from holdfast.operators import attribution, design, kernels, models
from holdfast.operators.attribution import (
    global_attribution, leaf_games, linear_attribution, top_features, tree_attribution,
)
from holdfast.plans import catalog
from holdfast.schema import RAW_ROLES, TABLE_ROLES

SHALLOW = {"trees": 3, "depth": 3, "rate": 0.3, "min_rows": 1}


@pytest.fixture(scope="module")
def frame(spark, sf):
    return models.with_label(catalog.cleaned(spark, sf), TABLE_ROLES).persist()


@pytest.fixture(scope="module")
def boosted(frame):
    return models.fit_boosted(frame, TABLE_ROLES, SHALLOW)


def test_design_of_the_four_customers(people):
    rows = design.with_inputs(clean(people), RAW_ROLES)
    fitted = design.fit_design(rows, RAW_ROLES)
    out = rows.select(fitted.row().alias("x")).collect()
    assert len(out) == 4 and all(len(r.x) == len(fitted.names) for r in out)
    assert "Contract_Month-to-month" in fitted.names and fitted.names[-1] == "has_internet_bundle"


def test_unseen_and_missing_levels_are_all_zeros(people):
    rows = design.with_inputs(clean(people), RAW_ROLES)
    fitted = design.fit_design(rows, RAW_ROLES)
    contract = [i for i, n in enumerate(fitted.names) if n.startswith("Contract_")]
    for odd in ("Weekly", None):
        row = rows.limit(1).withColumn("Contract", F.lit(odd).cast("string"))
        x = row.select(fitted.row()).first()[0]
        assert [x[i] for i in contract] == [0, 0, 0]


def test_missing_number_raises(people):
    rows = design.with_inputs(clean(people), RAW_ROLES)
    fitted = design.fit_design(rows, RAW_ROLES)
    with pytest.raises(Exception, match="clean the rows first"):
        rows.withColumn("tenure", F.lit(None).cast("double")).select(fitted.row()).collect()


def test_constant_column_scales_to_zero(people):
    rows = design.with_inputs(clean(people), RAW_ROLES).withColumn("tenure", F.lit(7.0))
    fitted = design.fit_design(rows, RAW_ROLES, scale=True)
    assert [r[0] for r in rows.select(fitted.numeric("tenure")).collect()] == [0, 0, 0, 0]


def test_fifty_one_columns(spark, sf):
    long = catalog.q_design_matrix(spark, sf)
    assert long.select("feature").distinct().count() == 51


def test_boosted_probabilities(boosted, frame):
    low, high, n = boosted.probability(frame).agg(F.min("p"), F.max("p"), F.count("*")).first()
    assert 0 <= low <= high <= 1 and n == frame.count()


def test_calibrator_pools_and_clamps(spark):
    scores = spark.createDataFrame([(0.2, 1), (0.2, 0), (0.4, 0), (0.6, 1), (0.6, 1)], "p double, y int")
    model = models.fit_calibrator(scores)
    probe = spark.createDataFrame([(0.0,), (0.2,), (0.4,), (0.6,), (0.9,)], "raw_p double")
    got = [r.calibrated for r in model.transform(probe).collect()]
    assert got == pytest.approx([1 / 3, 1 / 3, 1 / 3, 1, 1])


def test_calibrated_pipeline_on_replicated_customers(spark, people):
    copies = people.crossJoin(spark.range(5)).withColumn(
        "customerID", F.concat("customerID", F.lit("-"), "id")).drop("id")
    rows = models.with_label(clean(copies), RAW_ROLES)
    model = models.fit_calibrated(rows, RAW_ROLES, {**SHALLOW, "trees": 2})
    p = [r.p for r in model.probability(rows).collect()]
    assert len(p) == 20 and all(0 <= v <= 1 for v in p)


def test_saved_model_scores_alike(spark, boosted, frame, tmp_path):
    boosted.save(spark, str(tmp_path))
    again = models.Classifier.load(spark, str(tmp_path), TABLE_ROLES, "uncalibrated")
    before, after = (m.probability(frame).orderBy("customer_id").select("p").collect() for m in (boosted, again))
    assert before == after and again.names == boosted.names


def test_logistic_fit_is_stationary(frame):
    """The gradient of C * weighted loss + |b|^2 / 2 vanishes at the fit."""
    weighted, _ = models.balanced_weights(design.with_inputs(frame, TABLE_ROLES))
    totals = {r.y: r.w for r in weighted.groupBy("y").agg(F.sum("weight").alias("w")).collect()}
    assert totals[0] == pytest.approx(totals[1]) and sum(totals.values()) == pytest.approx(frame.count())
    model = models.fit_logistic(frame, TABLE_ROLES)
    fitted = model.model
    rows = fitted.transform(model.design.transform(weighted)).select(
        vector_to_array("features").alias("x"), vector_to_array("probability")[1].alias("p"), "y", "weight").collect()
    x = np.array([r.x for r in rows])
    slope = x.T @ np.array([r.weight * (r.p - r.y) for r in rows]) + fitted.coefficients.toArray()
    assert np.abs(slope).max() < 0.05
    assert abs(sum(r.weight * (r.p - r.y) for r in rows)) < 0.05


def test_candidates_are_compared_on_validation_rows(frame):
    results = models.candidate_results(frame, frame, TABLE_ROLES, [SHALLOW, {**SHALLOW, "trees": 1}])
    assert sorted(r.candidate for r in results.collect()) == [0, 1]


def test_values_of_one_leaf():
    shares, value = [0.3, 0.6, 0.9], 2.0
    for hit in itertools.product([0.0, 1.0], repeat=3):

        def worth(coalition):
            return value * math.prod(hit[i] if i in coalition else shares[i] for i in range(3))

        got = kernels.leaf_values(np.array([[hit]]), np.array([shares]), np.array([value]))[0, 0]
        for j in range(3):
            orders = list(itertools.permutations(range(3)))
            mine = sum(worth(set(o[:o.index(j) + 1])) - worth(set(o[:o.index(j)])) for o in orders) / len(orders)
            assert got[j] == pytest.approx(mine)


def test_values_of_long_paths_add_up():
    """Twelve features: what all of them change is the leaf's value less its expected one."""
    rng = np.random.default_rng(3)
    shares, values = rng.uniform(0, 1, (40, 12)), rng.normal(size=40)
    hits = (rng.uniform(size=(9, 40, 12)) < 0.9).astype(float)
    sums = kernels.leaf_values(hits, shares, values).sum(2)
    assert sums == pytest.approx(values * (hits.prod(2) - shares.prod(1)))


def test_block_in_steps_is_the_block(monkeypatch):
    rng = np.random.default_rng(5)
    x = rng.uniform(size=(20, 6))
    features = np.array([rng.permutation(6)[:3] for _ in range(50)])
    low = rng.uniform(0, 0.5, (50, 3))
    groups = [(features, low, low + 0.5, rng.uniform(size=(50, 3)), rng.normal(size=50))]
    whole = kernels.explain_block(x, groups)
    monkeypatch.setattr(kernels, "CELLS_PER_STEP", 200)
    assert kernels.explain_block(x, groups) == pytest.approx(whole)


def test_model_with_too_many_leaves_is_refused(spark, boosted, monkeypatch):
    monkeypatch.setattr(attribution, "MOST_BYTES", 8)
    with pytest.raises(ValueError, match="leaves"):
        leaf_games(spark, boosted)


def test_given_trees_refuse_a_missing_input(spark):
    rows = spark.createDataFrame([("a", 1, None, "One year", "DSL")],
                                 "customer_id string, tenure int, monthly_charges double, contract string, internet_service string")
    with pytest.raises(Exception, match="clean the rows first"):
        catalog.GIVEN_TREES.encoded(rows).collect()


def test_attributions_add_up_to_the_log_odds(spark, boosted, frame):
    games = leaf_games(spark, boosted)
    sums = tree_attribution(frame, boosted).groupBy("customer_id").agg(F.sum("phi").alias("s"))
    both = sums.join(boosted.probability(frame), "customer_id").select(
        "s", F.log(F.col("p") / (1 - F.col("p"))).alias("odds")).collect()
    assert len(both) == frame.count()
    for r in both:
        assert r.s + games.expected == pytest.approx(r.odds, abs=1e-9)


def test_attribution_against_all_coalitions(spark, boosted, frame):
    """Per tree and row, by walking the tree for every coalition."""
    path = f"{catalog.scratch_path(spark, 'test')}"
    boosted.model.save(path)
    nodes = {}
    for r in spark.read.parquet(f"{path}/data").collect():
        nodes.setdefault(r.treeID, {})[r.nodeData.id] = r.nodeData
    row = boosted.encoded(frame).orderBy("customer_id").first().x

    def walk(tree, node, x, known):
        n = nodes[tree][node]
        if n.leftChild < 0:
            return n.prediction
        s = n.split
        assert s.numCategories == -1
        left = x[s.featureIndex] <= s.leftCategoriesOrThreshold[0]
        if s.featureIndex in known:
            return walk(tree, n.leftChild if left else n.rightChild, x, known)
        return sum(walk(tree, c, x, known) * nodes[tree][c].rawCount for c in (n.leftChild, n.rightChild)) / n.rawCount

    got = kernels.explain_block(np.array([row]), leaf_games(spark, boosted).groups)[0]
    used = sorted({n.split.featureIndex for t in nodes.values() for n in t.values() if n.leftChild >= 0})
    want = np.zeros(len(row))
    for tree, weight in enumerate(boosted.model.treeWeights):
        mine = sorted({n.split.featureIndex for n in nodes[tree].values() if n.leftChild >= 0})
        for f in mine:
            rest = [g for g in mine if g != f]
            for size in range(len(rest) + 1):
                share = math.factorial(size) * math.factorial(len(rest) - size) / math.factorial(len(mine))
                for c in itertools.combinations(rest, size):
                    gain = walk(tree, 0, row, {*c, f}) - walk(tree, 0, row, set(c))
                    want[f] += 2 * weight * share * gain
    assert got[used] == pytest.approx(want[used], abs=1e-10)
    assert np.all(np.delete(got, used) == 0)


def test_global_attribution_averages_the_rows(frame, boosted):
    rows = tree_attribution(frame, boosted).groupBy("feature").agg(F.avg(F.abs("phi")).alias("m"))
    want = {r.feature: r.m for r in rows.collect()}
    table = global_attribution(frame, boosted)
    got = table.collect()
    assert {r.feature: r.mean_absolute_attribution for r in got} == pytest.approx(want)
    values = [r.mean_absolute_attribution for r in got]
    assert values == sorted(values, reverse=True)
    assert top_features(table).count() == 10


def test_linear_attribution_by_hand(spark):
    df = spark.createDataFrame([(1.0, 0.0), (3.0, 0.0)], "a double, b double")
    got = linear_attribution(df, {"a": (F.col("a"), 2.0), "b": (F.col("b"), 5.0)}).collect()
    assert [(r.feature, r.mean_absolute_attribution) for r in got] == [("a", 2.0), ("b", 0.0)]


def test_calibrator_does_not_round(spark):
    """Scores a fraction of a millionth apart stay apart."""
    near = [(0, 0.1000001)] * 50 + [(1, 0.1000003)] * 50
    fitted = models.fit_calibrator(spark.createDataFrame(near, "y int, p double"))
    assert list(fitted.predictions) == [0.0, 1.0]


def test_boosting_gets_rows_without_exchanges_in_equal_parts(frame, monkeypatch):
    """Its jobs, one for each level of a tree, read parts for the cores, with no plan behind them."""
    given = []
    fit = models.GBTClassifier.fit
    monkeypatch.setattr(models.GBTClassifier, "fit", lambda self, rows: given.append(rows) or fit(self, rows))
    monkeypatch.setattr(models, "ROWS_PER_TASK", 40)
    models.fit_boosted(frame, TABLE_ROLES, {**SHALLOW, "trees": 1})
    (rows,) = given
    sizes = [r["count"] for r in rows.groupBy(F.spark_partition_id()).count().collect()]
    assert sum(sizes) == frame.count() == 150 and len(sizes) == 4 and max(sizes) - min(sizes) <= 8
    assert "Scan ExistingRDD" in rows._jdf.queryExecution().executedPlan().toString()
    # More rows than a task takes mean more tasks than cores.
    monkeypatch.setattr(models, "MOST_ROWS_PER_TASK", 10)
    assert models.spread(rows).rdd.getNumPartitions() == 15


def test_few_rows_stay_in_order_in_one_part(spark):
    rows = spark.range(100, numPartitions=3).select((F.col("id") % 2).alias("y"), "id")
    kept = models.spread(rows)
    assert kept.rdd.getNumPartitions() == 1 and kept.collect() == rows.collect()
    assert models.spread(rows.limit(0)).count() == 0
