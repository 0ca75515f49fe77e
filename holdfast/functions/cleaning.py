"""Type repair and normalisation of the subscriber columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F, types as T

from holdfast import constants as K
from holdfast.functions.numeric import col
from holdfast.schema import CUSTOMERS, MONEY, RAW_ROLES, Roles


def parsed_money(c: Column | str) -> Column:
    """Trimmed text as money; text that is not a number becomes NULL."""
    return F.trim(col(c).cast("string")).try_cast(MONEY)


def label_flag(c: Column | str, positive: str = "yes") -> Column:
    """1 for the positive label in any case or padding, else 0 (NULL gives 0)."""
    return F.when(F.lower(F.trim(col(c))) == positive, 1).otherwise(0)


def is_active(c: Column | str) -> Column:
    return F.lower(F.trim(col(c))) == "no"


def title_text(c: Column | str) -> Column:
    return F.initcap(F.trim(col(c)))


def flag_to_text(c: Column | str) -> Column:
    """Yes for 1 or Yes, in any case or padding, as a number or as text."""
    return F.when(F.lower(F.trim(col(c).cast("string"))).isin("1", "yes"), "Yes").otherwise("No")


def text_to_flag(c: Column | str) -> Column:
    return F.when(col(c) == "Yes", 1).otherwise(0)


def clean(raw: DataFrame, roles: Roles = RAW_ROLES, senior: str = "SeniorCitizen") -> DataFrame:
    """Repair total charges and give the senior flag its text form.

    Steps whose columns are missing are left out.
    """
    out = raw
    if roles.total in out.columns:
        known = parsed_money(roles.total)
        if roles.monthly in out.columns and roles.tenure in out.columns:
            known = F.coalesce(known, (F.col(roles.monthly) * F.col(roles.tenure)).cast(MONEY))
        out = out.withColumn(roles.total, known)
    if senior in out.columns:
        out = out.withColumn(senior, flag_to_text(senior))
    return out


def to_table(cleaned: DataFrame) -> DataFrame:
    """Rename to table columns, restore the 0/1 senior flag, fix the types."""
    renamed = cleaned.withColumnsRenamed(K.RAW_TO_TABLE)
    if isinstance(renamed.schema["senior_citizen"].dataType, T.StringType):
        renamed = renamed.withColumn("senior_citizen", text_to_flag("senior_citizen"))
    return renamed.select(
        *[F.col(f.name).cast(f.dataType).alias(f.name) for f in CUSTOMERS.fields]
    )


def features_and_label(df: DataFrame, roles: Roles, label: str = "y") -> DataFrame:
    """Predictors plus the 0/1 label; the id and the label text are dropped."""
    return df.withColumn(label, label_flag(roles.label, roles.positive)).drop(
        roles.key, roles.label
    )
