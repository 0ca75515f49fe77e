"""Batch scoring of active customers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from holdfast import constants as K
from holdfast.functions.cleaning import is_active
from holdfast.functions.numeric import half_even
from holdfast.functions.risk import lifetime_value, policy_flag, risk_level
from holdfast.operators.models import Classifier
from holdfast.operators.policy import Offer
from holdfast.operators.reports import score_summary
from holdfast.schema import SCORES, TABLE_ROLES, Roles
from holdfast.sources.files import export_scores
from holdfast.sources.keyed_table import KeyedTable


def score_columns(df: DataFrame, threshold: float, scored_at: str | Column, roles: Roles = TABLE_ROLES,
                  p: str = "p", offer: Offer = Offer(),
                  extra: dict[str, Column] | None = None) -> DataFrame:
    """The score table's columns from a frame with a probability.

    Levels and flag come from the unrounded probability. The instant is an
    argument or a column, so a repeated run writes the same rows.
    """
    prob, monthly = F.col(p), F.col(roles.monthly).cast("double")
    value = lifetime_value(roles.monthly, offer.months, offer.annual_rate)
    columns = {
        "customer_id": F.col(roles.key),
        "tenure": F.col(roles.tenure),
        "contract": F.col(roles.contract),
        "monthly_charges": F.col(roles.monthly),
        "churn_probability": half_even(prob, 4),
        "risk_level": risk_level(prob),
        "is_high_risk": policy_flag(prob, threshold),
        "revenue_at_risk": half_even(prob * monthly, 2),
        "clv_estimate": half_even(value, 2),
        "clv_at_risk": half_even(prob * value, 2),
        "scored_at": F.lit(scored_at).cast("timestamp_ntz"),
    }
    return df.select(
        *[columns[f.name].cast(f.dataType).alias(f.name) for f in SCORES.fields],
        *[c.alias(name) for name, c in (extra or {}).items()],
    )


def active(df: DataFrame, roles: Roles) -> DataFrame:
    return df.where(is_active(roles.label))


def score_active(df: DataFrame, model: Classifier, scored_at: str,
                 threshold: float = K.DEFAULT_THRESHOLD, offer: Offer = Offer()) -> DataFrame:
    """Scores of the active customers of a cleaned frame; one pass, no shuffle."""
    scored = model.probability(active(df, model.roles))
    return score_columns(scored, threshold, scored_at, model.roles, offer=offer)


def publish_scores(scores: DataFrame, export_path: str, table: KeyedTable | None = None,
                   fmt: str = "csv") -> DataFrame:
    """Write the export, then upsert the table from it; returns the run summary.

    The table is fed from the written export, so the model runs once. A failing
    upsert raises and the export stands. Scores of customers no longer active
    stay in the table.
    """
    export_scores(scores, export_path, fmt)
    spark = scores.sparkSession
    reader = spark.read.schema(SCORES)
    if fmt == "csv":
        reader = reader.option("header", True)
    written = reader.format(fmt).load(export_path)
    if table is not None:
        table.upsert(written, on_duplicate="latest")
    return score_summary(written)
