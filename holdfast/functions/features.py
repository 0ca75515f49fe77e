"""Derived behavioural features, as native column expressions."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from holdfast import constants as K
from holdfast.functions.numeric import total_of
from holdfast.schema import Roles


def service_count(columns: list[str]):
    """How many of the columns say 'Yes'."""
    return total_of([F.when(F.col(c) == "Yes", 1).otherwise(0) for c in columns])


def add_behaviour(df: DataFrame, roles: Roles) -> DataFrame:
    """Append the derived features whose inputs the frame has.

    The service count is always added, over the service columns present.
    """
    have = set(df.columns)
    new = {}
    tenure, monthly, total = (
        F.col(c).cast("double") for c in (roles.tenure, roles.monthly, roles.total)
    )
    services = service_count([c for c in roles.services if c in have])

    if roles.tenure in have:
        progress = tenure / K.TENURE_SPAN_MONTHS
        new["tenure_months_ratio"] = F.when(
            tenure.isNotNull(), F.least(F.greatest(progress, F.lit(0.0)), F.lit(1.0))
        )
    if {roles.tenure, roles.monthly} <= have:
        new["charge_per_tenure"] = monthly / F.nullif(tenure + 1.0, F.lit(0.0))
    new["total_services"] = services
    if {roles.tenure, roles.monthly, roles.total} <= have:
        new["overpay_ratio"] = monthly * tenure / F.nullif(total + 1.0, F.lit(0.0))
    if roles.internet in have:
        online = F.col(roles.internet).isin(*K.ONLINE_SERVICES)
        new["has_internet_bundle"] = F.when(online & (services >= 2), 1).otherwise(0)
    return df.withColumns(new)
