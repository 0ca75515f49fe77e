"""The one-row-per-customer view, its roll-ups and the report measures."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from holdfast import constants as K
from holdfast.functions.numeric import (
    band_order, banded, exact_sum, mean, money_sum, rate_pct, ratio_or_zero, share,
)
from holdfast.operators.quantiles import quantiles

SCORE_COLUMNS = (
    "churn_probability", "risk_level", "is_high_risk", "revenue_at_risk",
    "clv_estimate", "clv_at_risk", "scored_at",
)


def customer_view(customers: DataFrame, scores: DataFrame, key: str = "customer_id") -> DataFrame:
    """Customers with their scores, unscored customers included.

    A 1:1 key join: bucket both tables on the key and it needs no shuffle. The
    optimizer broadcasts the score side only if it measures small.
    """
    scored = scores.select(key, *SCORE_COLUMNS, F.lit(1).alias("_scored"))
    return customers.join(scored, key, "left").select(
        "customer_id", "gender", "senior_citizen", "partner", "dependents", "tenure",
        banded("tenure", K.TENURE_BANDS).alias("tenure_band"),
        "phone_service", "multiple_lines", "internet_service", "online_security",
        "online_backup", "device_protection", "tech_support", "streaming_tv",
        "streaming_movies", "contract", "paperless_billing", "payment_method",
        "monthly_charges", "total_charges", "churn",
        F.when(F.col("churn") == "Yes", 1).otherwise(0).alias("churn_flag"),
        *SCORE_COLUMNS,
        F.coalesce("_scored", F.lit(0)).alias("has_model_score"),
    )


def _head() -> list[Column]:
    churned = F.col("churn") == "Yes"
    return [
        F.count(F.lit(1)).alias("total_customers"),
        F.count_if(churned).alias("churned_customers"),
        rate_pct(churned).alias("observed_churn_rate_pct"),
    ]


def _exposure() -> list[Column]:
    return [
        money_sum("revenue_at_risk").alias("expected_monthly_revenue_at_risk"),
        money_sum("clv_at_risk").alias("estimated_clv_at_risk"),
    ]


def kpis(view: DataFrame) -> DataFrame:
    return view.agg(
        *_head(),
        money_sum("monthly_charges", F.col("churn") == "Yes").alias(
            "historical_churned_monthly_charges"
        ),
        F.count_if(F.col("has_model_score") == 1).alias("scored_active_customers"),
        F.count_if(F.col("is_high_risk") == 1).alias("high_risk_scored_customers"),
        *_exposure(),
        F.max("scored_at").alias("latest_score_timestamp"),
    )


def contract_summary(view: DataFrame) -> DataFrame:
    return view.groupBy("contract").agg(
        *_head(),
        mean("monthly_charges").alias("avg_monthly_charges"),
        F.count_if(F.col("has_model_score") == 1).alias("scored_active_customers"),
        *_exposure(),
    )


def measures(view: DataFrame, key: str = "customer_id") -> DataFrame:
    """Named report measures; the view may carry repeated customers.

    One row per customer first, so the two distinct counts need one shuffle of
    the key and no row expansion.
    """
    per_customer = view.groupBy(key).agg(
        F.sum("churn_flag").alias("churned"),
        F.sum("revenue_at_risk").alias("revenue"),
        F.sum("clv_at_risk").alias("clv"),
        F.coalesce(F.max((F.col("is_high_risk") == 1).cast("int")), F.lit(0)).alias("flagged"),
    )
    total = F.count(key)
    return per_customer.agg(
        total.alias("total_customers"),
        F.round(100.0 * ratio_or_zero(F.sum("churned"), total), 4).alias("churn_rate_pct"),
        money_sum("revenue").alias("monthly_revenue_at_risk"),
        money_sum("clv").alias("clv_at_risk"),
        F.coalesce(F.sum("flagged"), F.lit(0)).alias("high_risk_customers"),
    )


def risk_breakdown(view: DataFrame) -> DataFrame:
    """Customers and exposure per level; unscored customers form the NULL group."""
    return view.groupBy("risk_level").agg(
        F.count(F.lit(1)).alias("customers"), *_exposure()
    )


def by_tenure_band(view: DataFrame) -> DataFrame:
    order = band_order("tenure", K.TENURE_BANDS).alias("band_order")
    return (
        view.groupBy("tenure_band", order)
        .agg(
            F.count(F.lit(1)).alias("customers"),
            F.round(share(F.col("churn_flag") == 1), 6).alias("churn_rate"),
        )
        .orderBy("band_order")
    )


def support_heatmap(view: DataFrame) -> DataFrame:
    """Churn rate and customers: one row per support state, a column pair per
    internet service and one for any other value. The pivot values are the fixed
    domain, so no extra job looks them up."""
    known = F.col("internet_service").isin(*K.INTERNET_DOMAIN)
    named = view.withColumn("_service", F.when(known, F.col("internet_service")).otherwise("other"))
    cells = named.groupBy("tech_support").pivot("_service", [*K.INTERNET_DOMAIN, "other"]).agg(
        F.round(share(F.col("churn_flag") == 1), 6).alias("rate"),
        F.count(F.lit(1)).alias("customers"),
    )
    names = {"DSL": "dsl", "Fiber optic": "fiber", "No": "none", "other": "other"}
    return cells.select(
        "tech_support",
        *[
            c
            for service, name in names.items()
            for c in (
                F.col(f"{service}_rate").alias(f"{name}_rate"),
                F.coalesce(F.col(f"{service}_customers"), F.lit(0)).alias(f"{name}_customers"),
            )
        ],
    )


def flagged_queue(view: DataFrame) -> DataFrame:
    """All customers above the policy threshold, riskiest first. Unlimited."""
    return (
        view.where("is_high_risk = 1")
        .orderBy(F.desc("churn_probability"), "customer_id")
        .select(
            "customer_id", "contract", "tenure",
            *[
                F.col(c).cast("double").alias(c)
                for c in ("monthly_charges", "churn_probability", "clv_at_risk")
            ],
        )
    )


def charge_quartiles(customers: DataFrame, approximate: bool = False) -> DataFrame:
    """Box-plot statistics of monthly charges by label.

    The exact form ranks distinct values with a distributed running count. The
    approximate form is one aggregate with a bounded sketch.
    """
    if approximate:
        box = customers.groupBy("churn").agg(
            F.min("monthly_charges").cast("double").alias("low"),
            F.max("monthly_charges").cast("double").alias("high"),
            F.percentile_approx(
                F.col("monthly_charges").cast("double"), [0.25, 0.5, 0.75], 100000
            ).alias("q"),
        )
    else:
        box = quantiles(customers, "monthly_charges", [0.25, 0.5, 0.75], within=["churn"])
    spread = F.col("q")[2] - F.col("q")[0]
    return box.select(
        "churn",
        "low",
        *[F.round(F.col("q")[i], 6).alias(n) for i, n in enumerate(("q1", "median", "q3"))],
        "high",
        F.round(F.col("q")[0] - 1.5 * spread, 6).alias("lower_fence"),
        F.round(F.col("q")[2] + 1.5 * spread, 6).alias("upper_fence"),
    )


def slicer_rollup(view: DataFrame) -> DataFrame:
    """Every combination of the three report slicers, each sliced or left open.

    Rows are collapsed to the finest combination before the cube, which would
    otherwise copy every customer eight times. A grouping bit of 1 means the
    slicer is open ("all").
    """
    slicers = ["senior_citizen", "payment_method", "tenure_band"]
    finest = view.groupBy(*slicers).agg(
        F.count(F.lit(1)).alias("customers"),
        F.count_if(F.col("churn") == "Yes").alias("churned_customers"),
        F.count_if(F.col("is_high_risk") == 1).alias("high_risk_customers"),
        exact_sum("revenue_at_risk").alias("revenue_at_risk"),
        exact_sum("clv_at_risk").alias("clv_at_risk"),
    )
    counts = ("customers", "churned_customers", "high_risk_customers")
    rate = 100.0 * F.col("churned_customers") / F.col("customers")
    return (
        finest.cube(*slicers)
        .agg(
            F.grouping_id().cast("int").alias("open_slicers"),
            *[F.sum(c).alias(c) for c in counts],
            *_exposure(),
        )
        .withColumn("observed_churn_rate_pct", F.round(rate, 2))
    )


def sliced(view: DataFrame, senior_citizen: int | None = None,
           payment_method: str | None = None, tenure_band: str | None = None) -> DataFrame:
    """The view under the report's filters; apply before any roll-up."""
    for column, value in (("senior_citizen", senior_citizen),
                          ("payment_method", payment_method), ("tenure_band", tenure_band)):
        if value is not None:
            view = view.where(F.col(column) == value)
    return view
