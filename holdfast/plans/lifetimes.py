"""Survival analysis of the customer table."""

from __future__ import annotations

from pyspark.sql import DataFrame

from holdfast.functions.cleaning import label_flag
from holdfast.operators.survival import dummies, hazard_table, kaplan_meier, median_survival
from holdfast.schema import TABLE_ROLES, Roles


def survival_analysis(customers: DataFrame, roles: Roles = TABLE_ROLES) -> dict[str, DataFrame]:
    """Curves (overall with a band, and per contract), medians, hazard ratios
    and their robust errors."""
    subjects = customers.select(
        roles.tenure, roles.monthly, roles.contract, roles.internet,
        label_flag(roles.label, roles.positive).alias("event"),
    )
    by_contract = kaplan_meier(subjects, roles.tenure, "event", [roles.contract])
    wide, indicators = dummies(subjects, [roles.contract, roles.internet])
    hazards = hazard_table(wide, roles.tenure, "event", [roles.monthly, *indicators])
    return {
        "curve_overall": kaplan_meier(subjects, roles.tenure, "event", band=True),
        "curve_by_contract": by_contract,
        "median_survival": median_survival(by_contract, [roles.contract]),
        "hazard_ratios": hazards.select("covariate", "hazard_ratio"),
        "hazard_errors": hazards.drop("hazard_ratio"),
    }
