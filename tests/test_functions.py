import datetime

import pytest
from pyspark.sql import functions as F

from holdfast.functions.cleaning import clean, label_flag, parsed_money, title_text, to_table
from holdfast.functions.features import add_behaviour
from holdfast.functions.numeric import half_even, mean, rate_pct
from holdfast.functions.risk import annuity, contact_tier, policy_flag, risk_level
from holdfast.plans.scoring import score_columns
from holdfast.schema import CUSTOMERS, RAW_ROLES, TABLE_ROLES


def column(spark, values, kind="double"):
    return spark.createDataFrame([(v,) for v in values], f"v {kind}")


def values(df):
    return [r[0] for r in df.collect()]


def test_features_by_hand(people):
    rows = add_behaviour(people, RAW_ROLES).orderBy("customerID").collect()
    expected = [
        (18 / 72, 45 / 19, 4, 810 / 801, 1), (36 / 72, 99.5 / 37, 5, 3582 / 3501, 1),
        (5 / 72, 19 / 6, 1, 95 / 91, 0), (60 / 72, 80.25 / 61, 2, 4815 / 4801, 1),
    ]
    names = ("tenure_months_ratio", "charge_per_tenure", "total_services", "overpay_ratio",
             "has_internet_bundle")
    for row, want in zip(rows, expected):
        assert [row[n] for n in names] == pytest.approx(want, abs=1e-12)


def test_features_skip_missing_inputs(people):
    only = add_behaviour(people.select("customerID", "PhoneService", "MonthlyCharges"), RAW_ROLES)
    assert only.columns == ["customerID", "PhoneService", "MonthlyCharges", "total_services"]
    assert {r.customerID: r.total_services for r in only.collect()} == {"P-10": 0, "P-11": 1, "P-12": 1, "P-13": 1}


def test_features_of_a_new_customer(spark, people):
    new = people.limit(1).withColumns(
        {"tenure": F.lit(0), "MonthlyCharges": F.lit(50.0), "TotalCharges": F.lit(" ")}
    )
    row = add_behaviour(clean(new), RAW_ROLES).first()
    assert float(row.TotalCharges) == 0
    assert (row.tenure_months_ratio, row.charge_per_tenure, row.overpay_ratio) == (0, 50, 0)


def test_blank_totals(spark):
    texts = column(spark, [" ", "", "31.40 ", "x", None], "string")
    assert [None if v is None else float(v) for v in values(texts.select(parsed_money("v")))] == [
        None, None, 31.40, None, None]


def test_table_form_keeps_the_senior_flag(spark, people):
    table = to_table(clean(people))
    assert table.schema == CUSTOMERS or [f.dataType for f in table.schema] == [
        f.dataType for f in CUSTOMERS]
    assert {r.customer_id: r.senior_citizen for r in table.collect()} == {
        "P-10": 0, "P-11": 1, "P-12": 0, "P-13": 0}
    numeric = people.withColumn("SeniorCitizen", F.when(F.col("SeniorCitizen") == "Yes", 1).otherwise(7))
    assert {r.customerID: r.SeniorCitizen for r in clean(numeric).collect()}["P-10"] == "No"


def test_text_normalisation(spark):
    texts = column(spark, [" yES", "no ", None], "string")
    assert values(texts.select(label_flag("v"))) == [1, 0, 0]
    assert values(texts.select(title_text("v"))) == ["Yes", "No", None]


def test_levels_are_right_closed(spark):
    p = column(spark, [0.0, 0.30, 0.3000001, 0.60, 0.6000001, 1.0, 1.1, None])
    assert values(p.select(risk_level("v"))) == [
        "Low", "Low", "Medium", "Medium", "High", "High", None, None]
    assert values(p.select(policy_flag("v", 0.30)))[:3] == [0, 1, 1]


def test_contact_tiers(spark):
    p = column(spark, [0.07, 0.0699, 0.6, 0.59])
    assert values(p.select(contact_tier("v", 0.07))) == ["elevated", "safe", "critical", "elevated"]
    # A threshold above 0.60 moves the critical line with it.
    assert values(p.select(contact_tier("v", 0.8))) == ["safe"] * 4


def test_annuity():
    assert annuity() == pytest.approx(26.58774208248756, rel=1e-15)
    assert annuity(30, 0.0) == 30


def test_rounding(spark):
    assert values(column(spark, [0.125, 0.135, 2.5, -0.125]).select(half_even("v", 2))) == [
        0.12, 0.14, 2.5, -0.12]


def test_rate_rounds_once(spark):
    eleven = spark.range(11).withColumn("c", F.col("id") < 5)
    assert eleven.agg(rate_pct(F.col("c"))).first()[0] == 45.45
    assert spark.range(0).agg(rate_pct(F.col("id") > 0)).first()[0] is None


def test_mean_takes_a_tie_up(spark):
    tied = spark.range(80).select(F.when(F.col("id") == 0, F.lit("34.6142")).otherwise("0").cast("decimal(6,4)").alias("v"))
    assert tied.agg(mean("v", 6)).first()[0] == 0.432678


def test_score_columns_use_the_unrounded_probability(spark):
    df = spark.createDataFrame(
        [("a", 3, "One year", 18.25, 0.300001), ("b", 3, "One year", 18.25, 0.5)],
        "customer_id string, tenure int, contract string, monthly_charges double, p double")
    a, b = score_columns(df, 0.5, "2024-05-06 07:08:09", TABLE_ROLES).orderBy("customer_id").collect()
    assert (float(a.churn_probability), a.risk_level) == (0.3, "Medium")
    assert float(b.revenue_at_risk) == 9.12  # 9.125, to even
    assert b.is_high_risk == 1 and b.scored_at == datetime.datetime(2024, 5, 6, 7, 8, 9)
