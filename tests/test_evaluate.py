import random

import pytest
from pyspark.sql import functions as F

from holdfast.operators.evaluate import (
    average_precision, best_candidate, brier, calibration_curve, confusion, evaluate,
    evaluation_table, miss_change, roc_auc,
)

SCHEMA = "y int, p double"


def frame(spark, rows):
    return spark.createDataFrame(rows, SCHEMA)


def brute_auc(rows):
    pos = [p for y, p in rows if y == 1]
    neg = [p for y, p in rows if y == 0]
    return sum((a > b) + (a == b) / 2 for a in pos for b in neg) / (len(pos) * len(neg))


def brute_ap(rows):
    total, recall, out = sum(y for y, _ in rows), 0.0, 0.0
    for t in sorted({p for _, p in rows}, reverse=True):
        hit = [y for y, p in rows if p >= t]
        out += (sum(hit) / total - recall) * sum(hit) / len(hit)
        recall = sum(hit) / total
    return out


@pytest.mark.parametrize("splits", [(), (0.2, 0.5, 0.50001, 0.9)])
def test_ranking_metrics_by_brute_force(spark, splits):
    rng = random.Random(5)
    # A third of all rows share one score.
    rows = [(rng.randint(0, 1), 0.5 if rng.random() < 0.33 else round(rng.random(), 2)) for _ in range(200)]
    df = frame(spark, rows).repartition(5)
    assert roc_auc(df, splits=splits).first()[0] == pytest.approx(brute_auc(rows), rel=1e-12)
    assert average_precision(df, splits=splits).first()[0] == pytest.approx(brute_ap(rows), rel=1e-12)
    assert brier(df).first()[0] == pytest.approx(sum((p - y) ** 2 for y, p in rows) / 200)


def test_all_tied(spark):
    df = frame(spark, [(1, 0.4), (0, 0.4), (0, 0.4)])
    assert roc_auc(df).first()[0] == 0.5
    bins = calibration_curve(df, splits=()).collect()
    assert [(b.n, b.observed_rate, b.mean_predicted) for b in bins] == [(3, 0.333333, 0.4)]


def test_one_class(spark):
    row = evaluate(frame(spark, [(0, 0.4), (0, 0.7)]), [0.5]).first()
    assert row.roc_auc is None and row.avg_precision is None
    assert (row.recall, row.precision, row.accuracy) == (0.0, 0.0, 0.5)


def test_empty(spark):
    row = evaluate(frame(spark, []), [0.5]).first()
    assert (row.tp, row.tn, row.accuracy, row.roc_auc) == (0, 0, None, None)


def test_threshold_is_inclusive(spark):
    row = confusion(frame(spark, [(1, 0.5), (0, 0.5), (1, 0.49)]), [0.5]).first()
    assert (row.tp, row.fp, row.fn, row.tn) == (1, 1, 1, 0)


def test_both_policies_even_if_the_thresholds_coincide(spark):
    df = frame(spark, [(1, 0.9), (0, 0.1)])
    rows = evaluation_table({"a": (df, 0.5)}).collect()
    assert sorted(r.policy for r in rows) == ["cost", "default"]


def test_miss_change(spark):
    df = spark.createDataFrame([(9, 14), (0, 3), (84, 166)], "a int, b int")
    got = [r[0] for r in df.select(miss_change(F.col("a"), F.col("b"))).collect()]
    assert got == pytest.approx([-55.555556, 0.0, -97.619048])


def test_first_candidate_wins_a_tie(spark):
    rows = [(0, 0.8, 0.7), (1, 0.9, 0.6), (2, 0.9, 0.8), (3, 0.9, 0.8)]
    df = spark.createDataFrame(rows, "candidate int, accuracy double, roc_auc double")
    assert best_candidate(df).first().candidate == 2
