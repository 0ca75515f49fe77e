"""Risk levels, contact tiers and customer value as column expressions."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from holdfast import constants as K
from holdfast.functions.numeric import col


def risk_level(p: Column | str) -> Column:
    """Right-closed levels on the unrounded probability; NULL outside (-0.01, 1]."""
    p = col(p)
    return (
        F.when((p > -0.01) & (p <= K.LOW_RISK_MAX), "Low")
        .when((p > K.LOW_RISK_MAX) & (p <= K.MEDIUM_RISK_MAX), "Medium")
        .when((p > K.MEDIUM_RISK_MAX) & (p <= 1.0), "High")
    )


def policy_flag(p: Column | str, threshold: float = K.DEFAULT_THRESHOLD) -> Column:
    """Contacted under the saved policy. Not the same thing as level 'High'."""
    return F.when(col(p) >= threshold, 1).otherwise(0)


def contact_tier(p: Column | str, threshold: float = K.DEFAULT_THRESHOLD) -> Column:
    p = col(p)
    return (
        F.when(p >= max(K.MEDIUM_RISK_MAX, threshold), "critical")
        .when(p >= threshold, "elevated")
        .otherwise("safe")
    )


def annuity(months: float = K.LIFETIME_MONTHS, annual_rate: float = K.ANNUAL_DISCOUNT) -> float:
    """Present value of one unit per month over the remaining months."""
    monthly_rate = (1.0 + annual_rate) ** (1.0 / 12.0) - 1.0
    if monthly_rate == 0.0:
        return float(months)
    return (1.0 - (1.0 + monthly_rate) ** (-months)) / monthly_rate


def lifetime_value(monthly: Column | str, months: float = K.LIFETIME_MONTHS,
                   annual_rate: float = K.ANNUAL_DISCOUNT) -> Column:
    return col(monthly).cast("double") * annuity(months, annual_rate)
