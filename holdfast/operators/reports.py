"""Workbook and dashboard tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from holdfast import constants as K
from holdfast.functions.cleaning import label_flag, title_text
from holdfast.functions.numeric import exact_sum, mean, share


def _domain(spark: SparkSession, column: str, values: tuple[str, ...]) -> DataFrame:
    """The fixed values in report order; a handful of literal rows."""
    return spark.range(1).select(
        F.posexplode(F.array(*[F.lit(v) for v in values])).alias("position", column)
    )


def _zero(c: str, kind: str = "bigint"):
    return F.coalesce(F.col(c), F.lit(0).cast(kind)).alias(c)


def contract_workbook(customers: DataFrame, scores: DataFrame) -> DataFrame:
    """Source and score sides per contract. Both sides are aggregated before
    they meet, and every contract of the fixed domain has a row."""
    churner = title_text("churn") == "Yes"
    source = customers.groupBy(F.trim("contract").alias("contract")).agg(
        F.count(F.lit(1)).alias("source_customers"),
        F.count_if(churner).alias("observed_churners"),
        F.bround(100.0 * share(churner), 1).alias("observed_churn_rate_pct"),
    )
    scored = scores.groupBy(F.trim("contract").alias("contract")).agg(
        F.count(F.lit(1)).alias("scored_customers"),
        F.sum("is_high_risk").alias("high_risk_customers"),
        exact_sum("revenue_at_risk").cast("double").alias("revenue_at_risk"),
        exact_sum("clv_at_risk").cast("double").alias("clv_at_risk"),
    )
    return (
        _domain(customers.sparkSession, "contract", K.CONTRACTS)
        .join(source, "contract", "left")
        .join(scored, "contract", "left")
        .select(
            "position", "contract", _zero("source_customers"), _zero("observed_churners"),
            "observed_churn_rate_pct", _zero("scored_customers"), _zero("high_risk_customers"),
            _zero("revenue_at_risk", "double"), _zero("clv_at_risk", "double"),
        )
        .orderBy("position")
    )


def risk_workbook(scores: DataFrame) -> DataFrame:
    per_level = scores.groupBy(title_text("risk_level").alias("risk_level")).agg(
        F.count(F.lit(1)).alias("customers"),
        mean("churn_probability", 6).alias("avg_churn_probability"),
        exact_sum("revenue_at_risk").cast("double").alias("revenue_at_risk"),
    )
    scored = scores.agg(F.greatest(F.count(F.lit(1)), F.lit(1))).scalar()
    return (
        _domain(scores.sparkSession, "risk_level", K.RISK_LEVELS)
        .join(per_level, "risk_level", "left")
        .select(
            "position", "risk_level", _zero("customers"),
            F.round(F.coalesce("customers", F.lit(0)).cast("double") / scored, 6).alias(
                "share_of_scored"
            ),
            _zero("avg_churn_probability", "double"), _zero("revenue_at_risk", "double"),
        )
        .orderBy("position")
    )


def kpi_cards(customers: DataFrame, scores: DataFrame) -> DataFrame:
    """One row: the source-side and score-side headline numbers."""
    flag = label_flag("churn") == 1
    source = customers.agg(
        F.struct(
            F.count(F.lit(1)).alias("customers"),
            F.round(share(flag), 6).alias("churn_rate"),
        )
    ).scalar()
    return scores.agg(
        F.count(F.lit(1)).alias("scored_customers"),
        F.coalesce(exact_sum("revenue_at_risk").cast("double"), F.lit(0.0)).alias(
            "revenue_exposure"
        ),
        F.coalesce(F.sum("is_high_risk"), F.lit(0)).alias("contact_candidates"),
        mean("churn_probability", 6).alias("mean_probability"),
    ).select(
        source["customers"].alias("source_customers"),
        source["churn_rate"].alias("observed_churn_rate"),
        "scored_customers", "revenue_exposure", "contact_candidates", "mean_probability",
    )


def score_summary(scores: DataFrame) -> DataFrame:
    """The record of one scoring run."""
    n = F.count(F.lit(1))
    flagged = F.coalesce(F.sum("is_high_risk"), F.lit(0))
    return scores.agg(
        n.alias("scored_customers"),
        flagged.alias("high_risk_customers"),
        F.round(F.coalesce(F.try_divide(flagged.cast("double"), n), F.lit(0.0)), 6).alias(
            "high_risk_share"
        ),
        F.coalesce(exact_sum("revenue_at_risk").cast("double"), F.lit(0.0)).alias(
            "revenue_exposure"
        ),
    )


def workbook_tables(customers: DataFrame, scores: DataFrame) -> dict[str, DataFrame]:
    """The data behind the workbook's sheets, by sheet."""
    return {
        "contract_summary": contract_workbook(customers, scores),
        "risk_summary": risk_workbook(scores),
        "customer_scores": scores.withColumn("contract", F.trim("contract")),
        "source_data": customers.withColumns(
            {"churn": title_text("churn"), "contract": F.trim("contract")}
        ),
    }
