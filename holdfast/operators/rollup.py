"""Report numbers kept as partial sums, so that a change costs the part it touches.

``partials`` leaves one row for each part and contract: counts, sums of money in
decimals, and the newest instant. Partials add up in any order without loss, so
``kpis`` and ``contract_summary`` of any set of parts equal those of the rows
(``semantic.kpis``, ``semantic.contract_summary``), rounded once, at the end.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F, types as T

_MONEY = T.DecimalType(38, 2)
#: (name, kind) of the numbers of a part; whole numbers and money are added.
COUNTS = ("customers", "churned", "billed", "scored", "flagged")
SUMS = ("monthly", "monthly_churned", "revenue_at_risk", "clv_at_risk")


def partials(view: DataFrame, part: str) -> DataFrame:
    """``view``: rows of the customer view with the number of their part."""
    churned = F.col("churn") == "Yes"

    def money(c: str | Column) -> Column:
        return F.sum(c).cast(_MONEY)

    return view.groupBy(part, "contract").agg(
        F.count(F.lit(1)).alias("customers"), F.count_if(churned).alias("churned"),
        F.count("monthly_charges").alias("billed"),
        F.count_if(F.col("has_model_score") == 1).alias("scored"),
        F.count_if(F.col("is_high_risk") == 1).alias("flagged"),
        money("monthly_charges").alias("monthly"),
        money(F.when(churned, F.col("monthly_charges"))).alias("monthly_churned"),
        money("revenue_at_risk").alias("revenue_at_risk"), money("clv_at_risk").alias("clv_at_risk"),
        F.max("scored_at").alias("newest"),
    )


def with_empty(found: DataFrame, part: str, named: Sequence[int]) -> DataFrame:
    """Partials and, for each part named, a row of zeros: a part whose last customer
    left is then written as well, in place of what it was."""
    spark = found.sparkSession
    zeros = spark.range(len(named)).select(
        F.element_at(F.array(*[F.lit(n) for n in named]), (F.col("id") + 1).cast("int")).cast("int").alias(part),
        *[(F.lit(0) if f.name in COUNTS else F.lit(None)).cast(f.dataType).alias(f.name)
          for f in found.schema.fields if f.name != part],
    )
    return found.unionByName(zeros)


def _added(parts: DataFrame, *by: str) -> DataFrame:
    return parts.where("customers > 0").groupBy(*by).agg(
        *[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in COUNTS], *[F.sum(c).cast(_MONEY).alias(c) for c in SUMS],
        F.max("newest").alias("newest"),
    )


def _money(c: str) -> Column:
    return F.round(F.col(c).cast("double"), 2)


def _rate() -> Column:
    return F.round(100.0 * F.col("churned") / F.nullif("customers", F.lit(0)), 2)


def kpis(parts: DataFrame) -> DataFrame:
    return _added(parts).select(
        F.col("customers").alias("total_customers"), F.col("churned").alias("churned_customers"),
        _rate().alias("observed_churn_rate_pct"),
        _money("monthly_churned").alias("historical_churned_monthly_charges"),
        F.col("scored").alias("scored_active_customers"), F.col("flagged").alias("high_risk_scored_customers"),
        _money("revenue_at_risk").alias("expected_monthly_revenue_at_risk"),
        _money("clv_at_risk").alias("estimated_clv_at_risk"), F.col("newest").alias("latest_score_timestamp"),
    )


def contract_summary(parts: DataFrame) -> DataFrame:
    average = F.col("monthly").cast("decimal(28,4)") / F.nullif("billed", F.lit(0))
    return _added(parts, "contract").select(
        "contract", F.col("customers").alias("total_customers"), F.col("churned").alias("churned_customers"),
        _rate().alias("observed_churn_rate_pct"), F.round(average, 2).cast("double").alias("avg_monthly_charges"),
        F.col("scored").alias("scored_active_customers"),
        _money("revenue_at_risk").alias("expected_monthly_revenue_at_risk"),
        _money("clv_at_risk").alias("estimated_clv_at_risk"),
    )
