"""Table schemas and the column roles operators are written against."""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import types as T

from holdfast import constants as K

MONEY = T.DecimalType(10, 2)
PROBABILITY = T.DecimalType(6, 4)

_TEXT = T.StringType()
_INT = T.IntegerType()

CUSTOMERS = T.StructType(
    [T.StructField("customer_id", _TEXT, False)]
    + [
        T.StructField(name, kind)
        for name, kind in (
            ("gender", _TEXT), ("senior_citizen", _INT), ("partner", _TEXT),
            ("dependents", _TEXT), ("tenure", _INT), ("phone_service", _TEXT),
            ("multiple_lines", _TEXT), ("internet_service", _TEXT),
            ("online_security", _TEXT), ("online_backup", _TEXT),
            ("device_protection", _TEXT), ("tech_support", _TEXT),
            ("streaming_tv", _TEXT), ("streaming_movies", _TEXT),
            ("contract", _TEXT), ("paperless_billing", _TEXT),
            ("payment_method", _TEXT), ("monthly_charges", MONEY),
            ("total_charges", MONEY), ("churn", _TEXT),
        )
    ]
)

SCORES = T.StructType(
    [
        T.StructField("customer_id", _TEXT, False),
        T.StructField("tenure", _INT),
        T.StructField("contract", _TEXT),
        T.StructField("monthly_charges", MONEY),
        T.StructField("churn_probability", PROBABILITY),
        T.StructField("risk_level", _TEXT),
        T.StructField("is_high_risk", _INT),
        T.StructField("revenue_at_risk", MONEY),
        T.StructField("clv_estimate", MONEY),
        T.StructField("clv_at_risk", MONEY),
        T.StructField("scored_at", T.TimestampNTZType()),
    ]
)

# The raw file: total charges may be blank text and the senior flag 0/1 or
# Yes/No, so both are read as text.
RAW = T.StructType(
    [
        T.StructField(
            raw,
            {"tenure": _INT, "monthly_charges": MONEY}.get(
                table, _TEXT
            ),
        )
        for raw, table in K.RAW_TO_TABLE.items()
    ]
)

# When a raw record was taken, where a feed says so.
RECORDED = T.StructField("recorded_at", T.TimestampNTZType())


@dataclass(frozen=True)
class Roles:
    """Which column plays which part. Operators take this, never a dataset."""

    key: str = "customer_id"
    label: str = "churn"
    positive: str = "yes"
    tenure: str = "tenure"
    monthly: str = "monthly_charges"
    total: str = "total_charges"
    contract: str = "contract"
    internet: str = "internet_service"
    binary: tuple[str, ...] = K.BINARY_COLUMNS
    multi: tuple[str, ...] = K.MULTI_COLUMNS
    services: tuple[str, ...] = K.SERVICE_COLUMNS
    engineered: tuple[str, ...] = K.ENGINEERED_COLUMNS

    @property
    def categorical(self) -> tuple[str, ...]:
        return self.binary + self.multi

    @property
    def numeric(self) -> tuple[str, ...]:
        return (self.tenure, self.monthly, self.total) + self.engineered


TABLE_ROLES = Roles()

_TO_RAW = {table: raw for raw, table in K.RAW_TO_TABLE.items()}

# The same roles for a frame that still carries the raw file's names.
RAW_ROLES = replace(
    TABLE_ROLES,
    **{
        part: _TO_RAW[getattr(TABLE_ROLES, part)]
        for part in ("key", "label", "tenure", "monthly", "total", "contract", "internet")
    },
    **{
        part: tuple(_TO_RAW[c] for c in getattr(TABLE_ROLES, part))
        for part in ("binary", "multi", "services")
    },
)
