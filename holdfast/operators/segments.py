"""Segment attrition and revenue reports over the customer and score tables.

Every report is one partial and one final hash aggregate; none of them joins
or scans its input twice.
"""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import Column, DataFrame, functions as F

from holdfast import constants as K
from holdfast.functions.features import service_count
from holdfast.functions.numeric import banded, mean, money_sum, rate_pct


def _churned() -> Column:
    return F.col("churn") == "Yes"


def _count(name: str) -> Column:
    return F.count(F.lit(1)).alias(name)


def _rate(name: str = "churn_rate_pct") -> Column:
    return rate_pct(_churned()).alias(name)


def _exactly(value: float) -> Column:
    """A bound as a decimal: compared with a double, a money column would be
    cast row by row and the filter would not reach the scan."""
    return F.lit(Decimal(str(value)))


def overall(customers: DataFrame) -> DataFrame:
    lost = F.when(_churned(), F.col("monthly_charges")).otherwise(F.lit(0))
    return customers.agg(
        _count("total_customers"),
        F.count_if(_churned()).alias("churned_customers"),
        _rate(),
        F.sum(lost).cast("double").alias("monthly_revenue_lost"),
    )


def by_contract(customers: DataFrame) -> DataFrame:
    return (
        customers.groupBy("contract")
        .agg(
            _count("total_customers"),
            F.count_if(_churned()).alias("churned_count"),
            _rate(),
            mean("monthly_charges").alias("avg_monthly_bill"),
        )
        .orderBy(F.desc_nulls_first("churn_rate_pct"), "contract")
    )


def revenue_by_risk(scores: DataFrame) -> DataFrame:
    return (
        scores.groupBy("risk_level")
        .agg(
            _count("customer_count"),
            money_sum("monthly_charges").alias("total_monthly_revenue"),
            money_sum("revenue_at_risk").alias("monthly_revenue_at_risk"),
            money_sum("clv_at_risk").alias("total_clv_at_risk"),
        )
        .orderBy(F.desc_nulls_first("monthly_revenue_at_risk"), "risk_level")
    )


def by_internet_and_support(customers: DataFrame) -> DataFrame:
    keys = ("internet_service", "tech_support")
    return (
        customers.groupBy(*keys)
        .agg(
            _count("customer_count"),
            F.count_if(_churned()).alias("churned_count"),
            _rate(),
        )
        .orderBy(F.desc_nulls_first("churn_rate_pct"), *keys)
    )


def churned_vs_retained(customers: DataFrame) -> DataFrame:
    return customers.groupBy("churn").agg(
        _count("customer_count"),
        mean("tenure", 1).alias("avg_tenure_months"),
        mean("monthly_charges").alias("avg_monthly_charges"),
        mean("total_charges").alias("avg_total_charges"),
    )


def missing_services(customers: DataFrame) -> DataFrame:
    """Four counts in one scan, turned into four rows; zero counts stay."""
    counted = customers.where(_churned()).agg(
        *[F.count_if(F.col(c) == "No").alias(c) for c, _ in K.MISSING_SERVICE_LABELS]
    )
    rows = F.array(
        *[
            F.struct(F.lit(name).alias("missing_service"), F.col(c).alias("churned_count"))
            for c, name in K.MISSING_SERVICE_LABELS
        ]
    )
    return counted.select(F.inline(rows)).orderBy(F.desc("churned_count"), "missing_service")


def by_tenure_cohort(customers: DataFrame) -> DataFrame:
    return (
        customers.groupBy(banded("tenure", K.TENURE_COHORTS).alias("tenure_cohort"))
        .agg(
            _count("total_customers"),
            F.count_if(_churned()).alias("churned_count"),
            _rate(),
        )
        .orderBy(F.desc_nulls_first("churn_rate_pct"), "tenure_cohort")
    )


def by_payment_and_paperless(customers: DataFrame) -> DataFrame:
    keys = ("payment_method", "paperless_billing")
    return (
        customers.groupBy(*keys)
        .agg(_count("customer_count"), _rate())
        .orderBy(F.desc_nulls_first("churn_rate_pct"), *keys)
    )


def intervention_queue(scores: DataFrame, rows: int = 10) -> DataFrame:
    """The flagged customers of highest risk; the id breaks ties."""
    return (
        scores.where("is_high_risk = 1")
        .orderBy(
            F.desc_nulls_first("churn_probability"),
            F.desc_nulls_first("monthly_charges"),
            "customer_id",
        )
        .limit(rows)
        .select(
            "customer_id", "contract", "tenure",
            *[
                F.col(c).cast("double").alias(c)
                for c in ("monthly_charges", "churn_probability", "revenue_at_risk", "clv_estimate")
            ],
        )
    )


def by_senior(customers: DataFrame) -> DataFrame:
    return customers.groupBy("senior_citizen").agg(
        _count("total_customers"), _rate(), mean("monthly_charges").alias("avg_monthly_bill")
    )


def by_bundle_depth(customers: DataFrame) -> DataFrame:
    """The internet column never says 'Yes', so eight columns count."""
    services = [c for c in K.SERVICE_COLUMNS if c != "internet_service"]
    return (
        customers.groupBy(service_count(services).alias("total_services_count"))
        .agg(_count("total_customers"), _rate())
        .orderBy("total_services_count")
    )


def high_bill_by_contract(customers: DataFrame, above: float = 80) -> DataFrame:
    return (
        customers.where(F.col("monthly_charges") > _exactly(above))
        .groupBy("contract")
        .agg(_count("high_bill_customers"), _rate())
        .orderBy(F.desc_nulls_first("churn_rate_pct"), "contract")
    )


def fiber_by_protection(customers: DataFrame) -> DataFrame:
    keys = ("online_security", "tech_support")
    return (
        customers.where(F.col("internet_service") == "Fiber optic")
        .groupBy(*keys)
        .agg(_count("total_fiber_customers"), _rate())
        .orderBy(F.desc_nulls_first("churn_rate_pct"), *keys)
    )


def value_lost_by_payment(customers: DataFrame) -> DataFrame:
    billed = F.col("monthly_charges") * F.col("tenure")
    return (
        customers.where(_churned())
        .groupBy("payment_method")
        .agg(
            _count("total_churned"),
            money_sum(billed).alias("cumulative_historical_loss"),
            mean(billed).alias("avg_clv_per_churned_customer"),
        )
        .orderBy(F.desc_nulls_first("cumulative_historical_loss"), "payment_method")
    )


def high_value_at_risk(scores: DataFrame, charges_above: float = 90.0,
                       probability_from: float = 0.50) -> DataFrame:
    """Unlimited sorted report: write it, do not collect it."""
    return (
        scores.where(
            (F.col("monthly_charges") > _exactly(charges_above))
            & (F.col("churn_probability") >= _exactly(probability_from))
        )
        .orderBy(F.desc("monthly_charges"), F.desc("churn_probability"), "customer_id")
        .select(
            "customer_id", "contract", "tenure",
            *[
                F.col(c).cast("double").alias(c)
                for c in ("monthly_charges", "churn_probability", "clv_estimate")
            ],
        )
    )
