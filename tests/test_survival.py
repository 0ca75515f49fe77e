import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from holdfast.operators import survival
from holdfast.operators.survival import HazardFit, dummies, hazard_ratios, kaplan_meier, median_survival

SCHEMA = "tenure int, event int, contract string"


def test_curve_by_hand(spark):
    rows = [(1, 1), (2, 0), (2, 1), (3, 1)]
    df = spark.createDataFrame([(t, e, "a") for t, e in rows], SCHEMA)
    got = [(r.time, r.at_risk, r.events, round(r.survival, 6)) for r in kaplan_meier(df).orderBy("time").collect()]
    # The last subject leaves by the event: the curve ends at zero.
    assert got == [(1, 4, 1, 0.75), (2, 3, 1, 0.5), (3, 1, 1, 0.0)]


def test_band_limits(spark):
    df = spark.createDataFrame([(1, 0, "a"), (2, 1, "a"), (3, 0, "a"), (4, 1, "a")], SCHEMA)
    rows = kaplan_meier(df, band=True).orderBy("time").collect()
    assert (rows[0].lower, rows[0].upper) == (1.0, 1.0)
    s, v = 2 / 3, 1 / 6
    reach = 1.959963984540054 * math.sqrt(v) / math.log(s)
    assert rows[1].lower == pytest.approx(min(s ** math.exp(reach), s ** math.exp(-reach)))
    assert rows[1].upper == pytest.approx(max(s ** math.exp(reach), s ** math.exp(-reach)))
    assert (rows[3].survival, rows[3].lower) == (0.0, None)


@pytest.mark.parametrize("splits", [(), (2.0, 4.0), None])
def test_ranges_and_strata(spark, splits):
    rng = random.Random(2)
    rows = [(rng.randint(0, 6), rng.randint(0, 1), rng.choice(["a", "b"])) for _ in range(120)]
    got = kaplan_meier(spark.createDataFrame(rows, SCHEMA), within=["contract"], band=True, splits=splits)
    for r in got.collect():
        mine = [x for x in rows if x[2] == r.contract]
        s = 1.0
        for t in range(r.time + 1):
            n = sum(x[0] >= t for x in mine)
            d = sum(x[0] == t and x[1] == 1 for x in mine)
            s *= 1 - d / n if n else 1
        assert r.survival == pytest.approx(s, abs=1e-12)


def test_median_keeps_strata_that_never_reach_it(spark):
    rows = [(1, 1, "a"), (2, 1, "a"), (5, 0, "b"), (6, 0, "b")]
    curve = kaplan_meier(spark.createDataFrame(rows, SCHEMA), within=["contract"])
    assert {r.contract: r.median_survival for r in median_survival(curve, ["contract"]).collect()} == {
        "a": 1.0, "b": math.inf}


def test_dummies_drop_the_first_level(spark):
    df = spark.createDataFrame([(1, 0, "b"), (2, 0, "a"), (3, 0, "c"), (4, 0, None)], SCHEMA)
    wide, names = dummies(df, ["contract"])
    assert names == ["contract_b", "contract_c"]
    assert [tuple(r) for r in wide.select(*names).collect()] == [(1, 0), (0, 0), (0, 1), (0, 0)]


def efron(beta, rows):
    """Log-likelihood, one event at a time."""
    out = 0.0
    for t in sorted({r[0] for r in rows if r[1]}):
        tie = [r for r in rows if r[0] == t and r[1]]
        risk = sum(math.exp(beta @ r[2]) for r in rows if r[0] >= t)
        own = sum(math.exp(beta @ r[2]) for r in tie)
        for l, r in enumerate(tie):
            out += beta @ r[2] - math.log(risk - l / len(tie) * own)
    return out


@pytest.fixture(scope="module")
def subjects():
    rng = np.random.default_rng(4)
    rows = []
    for _ in range(80):
        x = np.array([float(rng.integers(0, 2)), round(float(rng.normal()), 1)])
        t = min(int(rng.exponential(6 * math.exp(-0.8 * x[0]))), 9)
        rows.append((t, int(rng.random() < 0.7), x))
    return rows


@pytest.mark.parametrize("splits, chunk", [((), 1 << 16), ((2.0, 5.0), 3)])
def test_hazard_fit_against_brute_force(spark, subjects, monkeypatch, splits, chunk):
    monkeypatch.setattr(survival, "TIE_CHUNK", chunk)
    df = spark.createDataFrame([(t, e, *map(float, x)) for t, e, x in subjects],
                               "tenure int, event int, a double, `b c` double")
    fit = HazardFit(df, "tenure", "event", ["a", "b c"], splits=splits)
    beta = np.array([0.3, -0.2])
    value, gradient, info = fit.step(beta)
    # Brute force is not centred, and the likelihood does not care.
    assert value == pytest.approx(efron(beta, subjects), rel=1e-12)
    h = 1e-5
    for i in range(2):
        up, down = beta.copy(), beta.copy()
        up[i] += h
        down[i] -= h
        assert gradient[i] == pytest.approx((efron(up, subjects) - efron(down, subjects)) / (2 * h), abs=1e-4)
    best = fit.fit()
    assert np.abs(fit.step(best)[1]).max() < 1e-6
    assert np.all(np.linalg.eigvalsh(info) > 0)
    for i in range(2):
        for sign in (-1, 1):
            moved = best.copy()
            moved[i] += sign * 0.01
            assert efron(moved, subjects) < efron(best, subjects)


@pytest.mark.parametrize("splits, chunk", [((), 1 << 16), ((2.0, 5.0), 3)])
def test_residuals_are_what_leaving_a_row_out_changes(spark, subjects, monkeypatch, splits, chunk):
    """They add up to the gradient, and a row's residual is the slope of the gradient in the row's weight."""
    monkeypatch.setattr(survival, "TIE_CHUNK", chunk)
    # Ten of one row, and eleven: events weigh as whole rows, so use a row that is no event.
    spare = next(r for r in subjects if not r[1])
    beta = np.array([0.3, -0.2])

    def fitted(rows):
        return HazardFit(spark.createDataFrame([(t, e, *map(float, x)) for t, e, x in rows],
                         "tenure int, event int, a double, b double"), "tenure", "event", ["a", "b"], splits=splits)

    fit = fitted(subjects)
    rows = fit.residuals(beta).collect()
    for i in range(2):
        assert sum(r["w"] * r[f"r{i}"] for r in rows) == pytest.approx(fit.step(beta)[1][i], abs=1e-9)
    assert {(r["time"], r["hit"], round(r["x0"], 9), round(r["x1"], 9)): r["w"] for r in rows} == {
        (t, e == 1, *x): sum((t, e, *x) == (s, f, *y) for s, f, y in subjects) for t, e, x in subjects}
    # Many copies of everything make one row more a small change.
    many = 200
    base, more = fitted(subjects * many), fitted(subjects * many + [spare])
    change = more.step(beta)[1] - base.step(beta)[1]
    own = next(r for r in base.residuals(beta).collect() if (r["time"], r["hit"]) == (spare[0], False)
               and (round(r["x0"], 9), round(r["x1"], 9)) == tuple(spare[2]))
    assert [own["r0"], own["r1"]] == pytest.approx(list(change), abs=2e-3)


def test_robust_errors_by_hand(spark, subjects):
    """The sandwich, from residuals made one event at a time."""
    df = spark.createDataFrame([(t, e, *map(float, x)) for t, e, x in subjects], "tenure int, event int, a double, b double")
    table = survival.hazard_table(df, "tenure", "event", ["a", "b"]).collect()
    beta = np.array([r["coefficient"] for r in table])
    risk = np.array([math.exp(beta @ x) for _, _, x in subjects])
    x = np.array([x for _, _, x in subjects])
    time, hit = np.array([s[0] for s in subjects]), np.array([s[1] for s in subjects]) == 1
    residual, info = np.where(hit[:, None], x, 0.0), np.zeros((2, 2))
    for t in sorted(set(time[hit])):
        tie, at_risk = hit & (time == t), time >= t
        d = tie.sum()
        for l in range(d):
            e = risk * (at_risk - (l / d) * tie)
            mean = e @ x / e.sum()
            info += (x * e[:, None]).T @ x / e.sum() - np.outer(mean, mean)
            residual[tie] -= mean / d
            residual -= (x - mean) * (e / e.sum())[:, None]
    inverse = np.linalg.inv(info)
    assert [r["model_error"] for r in table] == pytest.approx(list(np.sqrt(np.diag(inverse))), rel=1e-6)
    want = np.sqrt(np.diag(inverse @ residual.T @ residual @ inverse))
    assert [r["robust_error"] for r in table] == pytest.approx(list(want), rel=1e-6)
    assert all(0 <= r["p_value"] <= 1 and r["hazard_ratio"] == pytest.approx(math.exp(r["coefficient"])) for r in table)


def test_hazard_ratio_table(spark, sf):
    from holdfast.plans.catalog import q_cox

    rows = {r.covariate: r.hazard_ratio for r in q_cox(spark, sf).collect()}
    assert list(rows) == ["monthly_charges", "contract_One year", "contract_Two year",
                          "internet_service_Fiber optic", "internet_service_No"]
    assert all(v > 0 for v in rows.values())


def test_no_events(spark):
    df = spark.createDataFrame([(1, 0, 1.0), (2, 0, 0.0)], "tenure int, event int, a double")
    with pytest.raises(ValueError):
        hazard_ratios(df, "tenure", "event", ["a"])


def test_survival_job_tables(spark, sf):
    from holdfast.plans.catalog import customers
    from holdfast.plans.lifetimes import survival_analysis

    tables = survival_analysis(customers(spark, sf))
    assert set(tables) == {"curve_overall", "curve_by_contract", "median_survival", "hazard_ratios", "hazard_errors"}
    assert tables["median_survival"].count() == 3 and tables["hazard_ratios"].count() == 5
    assert "lower" in tables["curve_overall"].columns


def test_an_id_is_no_category(spark):
    df = spark.range(30_000).select(F.col("id").cast("string").alias("code"))
    with pytest.raises(ValueError, match="code"):
        dummies(df, ["code"])
