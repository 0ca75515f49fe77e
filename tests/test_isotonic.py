"""Isotonic steps against the min-max formula and over any ranges."""

import random
from fractions import Fraction

import pytest

from holdfast.operators.isotonic import isotonic_steps, pool


def min_max(points):
    """Blocks as (low, high, n, positives) from the rate of every score by its definition."""
    n, out = len(points), []
    mean = {(j, k): Fraction(sum(p[2] for p in points[j:k + 1]), sum(p[1] for p in points[j:k + 1]))
            for j in range(n) for k in range(j, n)}
    for i, (x, w, s) in enumerate(points):
        rate = max(min(mean[j, k] for k in range(i, n)) for j in range(i + 1))
        if out and out[-1][4] == rate:
            low, _, more, hits, _ = out.pop()
            out.append((low, x, more + w, hits + s, rate))
        else:
            out.append((x, x, w, s, rate))
    return [b[:4] for b in out]


@pytest.fixture(scope="module")
def scores():
    rng = random.Random(11)
    rows = [(p, int(rng.random() < p * p)) for p in (round(rng.random(), 2) for _ in range(500))]
    return rows + [(0.37, 0)] * 300 + [(0.9, 1)] * 5 + [(None, 1), (float("nan"), 1), (0.5, None)]


@pytest.mark.parametrize("splits", [(), (0.5,), tuple(i / 40 for i in range(1, 40)), None])
def test_steps_equal_the_formula(spark, scores, splits):
    """Forty ranges meet in two rounds; cut points come from the data in the last case."""
    df = spark.createDataFrame(scores, "p double, y int")
    steps = isotonic_steps(df, splits=splits, rows_per_range=7).orderBy("low").collect()
    known = [(p, y) for p, y in scores if p is not None and p == p and y is not None]
    points = [(x, sum(p == x for p, _ in known), sum(y for p, y in known if p == x)) for x in sorted({p for p, _ in known})]
    assert [tuple(r)[:4] for r in steps] == min_max(points)
    assert all(a["rate"] < b["rate"] for a, b in zip(steps, steps[1:]))
    assert all(r["rate"] == r["positives"] / r["n"] for r in steps)


def test_degenerate_scores(spark):
    def steps(rows):
        return [tuple(r) for r in isotonic_steps(spark.createDataFrame(rows, "p double, y int"), splits=(0.5,)).collect()]

    assert steps([]) == []
    assert steps([(0.3, 1), (0.3, 0)]) == [(0.3, 0.3, 2, 1, 0.5)]
    assert steps([(0.1, 1), (0.9, 0)]) == [(0.1, 0.9, 2, 1, 0.5)]


def test_whole_numbers_beyond_doubles():
    """Rates that doubles can't tell apart stay two blocks."""
    big = 10**17
    assert len(pool([(0.1, 0.1, big + 1, big), (0.2, 0.2, big + 2, big + 1)])) == 2
    assert len(pool([(0.1, 0.1, big, big // 2), (0.2, 0.2, 2, 1)])) == 1
