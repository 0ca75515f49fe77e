"""Key-based merge, cascade and constraint checks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from holdfast import constants as K


class KeyConflict(ValueError):
    """A batch holds the same key twice."""


def merge_rows(current: DataFrame, staged: DataFrame, key: str) -> DataFrame:
    """Staged rows win; current rows whose key is not staged are kept.

    The anti-join is broadcast by the optimizer when the batch is small, so a
    small batch does not shuffle the table.
    """
    kept = current.join(staged.select(key), key, "left_anti").select(*current.columns)
    return staged.select(*current.columns).unionByName(kept)


def latest_per_key(rows: DataFrame, key: str, order: str) -> DataFrame:
    """One row per key: the greatest by ``order``, then by the other columns."""
    rest = [c for c in rows.columns if c not in (key, order)]
    newest = rows.groupBy(key).agg(F.max(F.struct(order, *rest)).alias("_row"))
    return newest.select(
        *[F.col(key) if c == key else F.col(f"_row.{c}").alias(c) for c in rows.columns]
    )


def cascade(child: DataFrame, parent: DataFrame, key: str) -> DataFrame:
    """Child rows whose parent still exists."""
    return child.join(parent.select(key), key, "left_semi")


def _violations(df: DataFrame, table: str, tests: list[tuple[str, str, Column]]) -> DataFrame:
    """One aggregate over the table for all row-level tests, one row per test."""
    counted = df.agg(*[F.count_if(bad).alias(f"t{i}") for i, (_, _, bad) in enumerate(tests)])
    rows = F.array(
        *[
            F.struct(
                F.lit(table).alias("table_name"), F.lit(check).alias("check_name"),
                F.lit(column).alias("column_name"), F.col(f"t{i}").alias("violations"),
            )
            for i, (check, column, _) in enumerate(tests)
        ]
    )
    return counted.select(F.inline(rows))


def _repeats(df: DataFrame, table: str, key: str) -> DataFrame:
    """Rows beyond the first for each key; NULL keys are counted elsewhere."""
    per_key = df.where(F.col(key).isNotNull()).groupBy(key).agg(F.count(F.lit(1)).alias("n"))
    return per_key.agg(
        F.lit(table).alias("table_name"), F.lit("unique").alias("check_name"),
        F.lit(key).alias("column_name"),
        F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).cast("bigint").alias("violations"),
    )


def constraint_report(customers: DataFrame, scores: DataFrame, key: str = "customer_id",
                      money_limit: float = 1e8) -> DataFrame:
    """Violations per declared constraint of the two tables."""

    def tests(widths: dict[str, int], money: tuple[str, ...]):
        out = [("not_null", key, F.col(key).isNull())]
        out += [("width", c, F.length(c) > n) for c, n in widths.items()]
        out += [("precision", c, F.abs(F.col(c).cast("double")) >= money_limit) for c in money]
        return out

    orphans = scores.join(customers.select(key), key, "left_anti").agg(
        F.lit("churn_scores").alias("table_name"), F.lit("references").alias("check_name"),
        F.lit(key).alias("column_name"), F.count(F.lit(1)).alias("violations"),
    )
    parts = [
        _violations(customers, "customers",
                    tests(K.CUSTOMER_TEXT_WIDTHS, ("monthly_charges", "total_charges"))),
        _repeats(customers, "customers", key),
        _violations(scores, "churn_scores",
                    tests(K.SCORE_TEXT_WIDTHS, ("monthly_charges", "revenue_at_risk",
                                                "clv_estimate", "clv_at_risk"))),
        _repeats(scores, "churn_scores", key),
        orphans,
    ]
    report = parts[0]
    for part in parts[1:]:
        report = report.unionByName(part)
    return report
