import random

import numpy as np
import pytest
from hypothesis import HealthCheck, given, settings, strategies as st
from pyspark.sql import functions as F

from holdfast.operators.ordered import accumulate, running_totals, split_points
from holdfast.operators.profile import charge_histogram, most_missing, profile
from holdfast.operators.quantiles import quantiles


def brute(rows, descending):
    out = {}
    for g in {r[0] for r in rows}:
        total = 0
        for k in sorted({r[1] for r in rows if r[0] == g}, reverse=descending):
            total += sum(r[2] for r in rows if r[0] == g and r[1] == k)
            out[(g, k)] = total
    return out


def collected(df):
    return {(r["g"], r["k"]): r["run_v"] for r in df.collect()}


@pytest.mark.parametrize("descending", [False, True])
@pytest.mark.parametrize("splits", [(), (3.0, 5.0, 5.5, 20.0), None])
def test_ranges_do_not_change_the_totals(spark, splits, descending):
    rng = random.Random(1)
    # One key holds a third of all rows.
    rows = [(rng.choice("ab"), 5 if rng.random() < 0.33 else rng.randint(0, 9), rng.randint(1, 5))
            for _ in range(300)]
    df = spark.createDataFrame(rows, "g string, k int, v int")
    got = running_totals(df, "k", {"v": F.sum("v")}, ["g"], descending, splits, rows_per_range=3)
    assert collected(got) == brute(rows, descending)


@settings(max_examples=5, deadline=None, suppress_health_check=list(HealthCheck))
@given(st.lists(st.tuples(st.sampled_from("ab"), st.integers(-5, 5), st.integers(0, 9)), min_size=1, max_size=40),
       st.lists(st.floats(-6, 6), max_size=3, unique=True))
def test_any_split_points(spark, rows, cuts):
    df = spark.createDataFrame(rows, "g string, k int, v int").repartition(3)
    got = running_totals(df, "k", {"v": F.sum("v")}, ["g"], splits=sorted(cuts))
    assert collected(got) == brute(rows, False)


def test_running_product_over_ranges(spark):
    rows = [(i, 1.0 - (i % 4) / 10) for i in range(40)]
    df = spark.createDataFrame(rows, "k int, v double")
    got = {r.k: r.run_v for r in accumulate(df, "k", ["v"], splits=(7.0, 20.0), how="product").collect()}
    want = np.cumprod([v for _, v in rows])
    assert [got[i] for i in range(40)] == pytest.approx(list(want))


def test_few_keys_need_no_ranges(spark):
    df = spark.range(1000).select((F.col("id") % 7).alias("k"))
    assert split_points(df, F.col("k")) == []
    assert len(split_points(df, F.col("k"), rows_per_range=2)) >= 2


def test_a_hot_key_does_not_draw_the_cuts(spark):
    hot = spark.range(100_000).select(F.lit(0.0).alias("k"))
    df = hot.union(spark.range(1, 2001).select(F.col("id").cast("double")))
    cuts = [float("-inf"), *split_points(df, F.col("k"), rows_per_range=200), float("inf")]
    held = [sum(a <= k < b for k in range(2001)) for a, b in zip(cuts, cuts[1:])]
    assert sum(held) == 2001 and max(held) <= 400


@pytest.mark.parametrize("splits", [(), None])
def test_quantiles_interpolate(spark, splits):
    rng = np.random.default_rng(3)
    x = np.concatenate([rng.integers(0, 20, 101).astype(float), [7.0] * 50])
    df = spark.createDataFrame([(float(v),) for v in x], "x double").unionAll(
        spark.createDataFrame([(None,)], "x double"))
    row = quantiles(df, "x", [0.0, 0.1, 0.25, 0.5, 0.9, 1.0], splits=splits).first()
    assert row.q == pytest.approx(list(np.quantile(x, [0, 0.1, 0.25, 0.5, 0.9, 1])))
    assert (row.low, row.high, row.n) == (x.min(), x.max(), len(x))


def test_histogram_edges(spark):
    df = spark.createDataFrame([(float(v), "No") for v in range(13)] + [(12.0, "Yes"), (None, "Yes")],
                               "monthly_charges double, churn string")
    rows = charge_histogram(df).collect()
    # The minimum shares the first bin with the first edge; bins close on the right.
    assert [r.n_no for r in rows] == [2] + [1] * 11
    assert rows[-1].n_yes == 1 and rows[0].lower_edge == pytest.approx(-0.012)
    one = charge_histogram(spark.createDataFrame([(5.0, "No")] * 3, "monthly_charges double, churn string"))
    assert [(r.bin, r.n_no) for r in one.collect()] == [(1, 3)]


def test_profile_of_an_empty_table(spark):
    rows = profile(spark.createDataFrame([], "a int, b string")).collect()
    assert [(r.column_name, r.present, r.distinct_values) for r in rows] == [("a", 0, 0), ("b", 0, 0)]
    assert most_missing(spark.createDataFrame([(None, "x")], "a int, b string"), 1).first().column_name == "a"


def test_approximate_profile_is_close(spark, sf):
    from holdfast.plans.catalog import customers

    table = customers(spark, sf)
    exact = {r.column_name: r for r in profile(table).collect()}
    for r in profile(table, approximate=True).collect():
        assert (r.present, r.missing) == (exact[r.column_name].present, exact[r.column_name].missing)
        if r.median is not None:
            assert r.median == pytest.approx(exact[r.column_name].median, rel=0.05)


@pytest.mark.parametrize("descending", [False, True])
def test_null_groups_and_keys_are_kept(spark, descending):
    rows = [(None, 1, 1), (None, 2, 2), ("a", None, 4), ("a", 5, 8)]
    df = spark.createDataFrame(rows, "g string, k int, v int")
    plain, ranged = (
        sorted(map(repr, running_totals(df, "k", {"v": F.sum("v")}, ["g"], descending, splits).collect()))
        for splits in ((), (1.5,)))
    assert plain == ranged and len(plain) == 4
    q = quantiles(df, "k", [0.5], ["g"])
    assert {r.g: r.q[0] for r in q.collect()} == {None: 1.5, "a": 5.0}
