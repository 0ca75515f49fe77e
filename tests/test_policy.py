import random

import pytest

from holdfast.functions.risk import annuity
from holdfast.operators.policy import (
    Offer, best_threshold, financial_outcome, grid_curve, policy_value, threshold_curve,
)

# Who leaves, score, monthly bill. A customer is worth the bill times the annuity A.
CASES = [(1, 0.85, 60.0), (0, 0.7, 40.0), (1, 0.45, 90.0), (0, 0.4, 25.0), (0, 0.15, 70.0), (1, 0.12, 10.0), (0, 0.02, 55.0)]
A = annuity()
SCHEMA = "y int, p double, monthly_charges double"


@pytest.fixture(scope="module")
def cases(spark):
    return spark.createDataFrame(CASES, SCHEMA).persist()


@pytest.mark.parametrize("t, tp, fp, fn, tn, outreach, saved, lost, net", [
    (0.5, 1, 1, 2, 3, 100.0, 21 * A, 139 * A, 21 * A - 100),
    (1.0, 0, 0, 3, 4, 0.0, 0.0, 160 * A, 0.0),
    (0.0, 3, 4, 0, 0, 350.0, 56 * A, 104 * A, 56 * A - 350),
])
def test_outcomes(cases, t, tp, fp, fn, tn, outreach, saved, lost, net):
    row = financial_outcome(cases, t).first()
    assert (row.tp_count, row.fp_count, row.fn_count, row.tn_count) == (tp, fp, fn, tn)
    assert (row.outreach_cost, row.saved_revenue, row.lost_revenue, row.net_value) == pytest.approx(
        (outreach, saved, lost, net), abs=1e-4)


def test_best_threshold_is_the_lowest_of_the_tied(cases):
    """Every threshold above 0.40 and up to 0.45 contacts the same three."""
    row = best_threshold(cases).first()
    assert row.threshold == 0.41
    assert row.net_value == pytest.approx(52.5 * A - 150, abs=1e-9)
    assert row.savings_vs_do_nothing == pytest.approx(52.5 * A - 150, abs=1e-9)
    assert row.savings_vs_contact_all == pytest.approx(200 - 3.5 * A, abs=1e-9)


def test_curve_has_the_swept_thresholds(cases):
    found = [r.threshold for r in threshold_curve(cases).collect()]
    assert found == [round(0.05 + 0.01 * i, 2) for i in range(91)]
    assert [r.threshold for r in threshold_curve(cases, step=0.25).collect()] == [0.05, 0.3, 0.55, 0.8]


def test_one_pass_equals_one_pass_per_threshold(spark):
    rng = random.Random(7)
    # Scores on, just below and just above the grid, where a product misplaces them.
    grid = [i / 100 for i in range(101)]
    near = [s for g in grid for s in (g, min(1.0, g + 1e-16), max(0.0, g - 1e-17), g * (1 - 2e-16))]
    rows = [(rng.randint(0, 1), s, round(rng.uniform(18, 120), 2)) for s in near + [1.0, 0.0]]
    df = spark.createDataFrame(rows, SCHEMA)
    factor = annuity()
    for r in grid_curve(df).collect():
        t = r.threshold
        hit = [x for x in rows if x[1] >= t]
        tp = [x for x in hit if x[0] == 1]
        assert (r.tp_count, r.fp_count) == (len(tp), len(hit) - len(tp)), t
        net = sum(x[2] for x in tp) * factor * 0.35 - 50.0 * len(hit)
        assert r.net_value == pytest.approx(net, abs=1e-6)


def test_certain_churner_is_contacted_even_at_one(spark):
    df = spark.createDataFrame([(1, 1.0, 100.0), (0, 0.2, 50.0)], SCHEMA)
    row = financial_outcome(df, 1.0).first()
    assert (row.tp_count, row.fn_count) == (1, 0)
    best = best_threshold(df).first()
    assert best.savings_vs_do_nothing == pytest.approx(0.0)
    assert policy_value(df, 0.5).first().savings_vs_do_nothing == pytest.approx(best.net_value)


def test_missing_score_is_never_contacted(spark):
    df = spark.createDataFrame([(1, None, 100.0), (0, 0.2, 50.0)], SCHEMA)
    assert financial_outcome(df, 0.0).first().fn_count == 1
    assert grid_curve(df).where("cell = 0").first().fn_count == 1


def test_empty_input(spark):
    row = best_threshold(spark.createDataFrame([], SCHEMA)).first()
    assert (row.threshold, row.net_value) == (0.05, 0.0)


def test_partitioning_does_not_matter(cases):
    offer = Offer(cost=10.0, success=0.5)
    one, many = (best_threshold(cases.repartition(n), offer).first() for n in (1, 7))
    assert one == many


def test_a_finer_step_is_refused(spark):
    df = spark.createDataFrame([(1, 0.5, 10.0)], "y int, p double, monthly_charges double")
    with pytest.raises(ValueError, match="hundredths"):
        threshold_curve(df, step=0.005)
