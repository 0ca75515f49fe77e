"""Column profile of a table and simple distribution reports."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F, types as T

from holdfast.functions.cleaning import label_flag
from holdfast.operators.quantiles import quantiles


QUARTILES = ("q1", "median", "q3")


def profile(df: DataFrame, approximate: bool = False) -> DataFrame:
    """One row per column: count, missing, distinct, most frequent, moments,
    quartiles and range.

    Counts and moments are one aggregate without a shuffle. Distinct values, the
    most frequent one and quartiles come from the exact number of rows per
    (column, value); columns with few values shrink before that shuffle. The
    approximate form takes them from bounded sketches in the same aggregate,
    and leaves the most frequent value out.
    """
    numeric = [f.name for f in df.schema.fields if isinstance(f.dataType, T.NumericType)]
    text = [c for c in df.columns if c not in numeric]
    moments = _moments(df, numeric, approximate)
    if approximate:
        return moments
    parts = [_text_values(df, text)] if text else []
    if numeric:
        parts.append(_numeric_values(df, numeric))
    values = parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])
    # One row per column on both sides.
    return moments.join(values, "column_name", "left").select(
        "position", "column_name", "present", "missing",
        F.coalesce("distinct_values", F.lit(0)).alias("distinct_values"),
        "top_value", "top_count", "avg_value", "std_value", "min_value", "q1", "median", "q3",
        "max_value",
    ).orderBy("position")


def _moments(df: DataFrame, numeric: Sequence[str], approximate: bool) -> DataFrame:
    rows = []
    for i, c in enumerate(df.columns):
        x = F.col(c).cast("double") if c in numeric else F.lit(None).cast("double")
        sketches = []
        if approximate:
            q = F.percentile_approx(x, [0.25, 0.5, 0.75], 10000)
            sketches = [F.approx_count_distinct(c).alias("distinct_values"),
                        *[q[j].alias(n) for j, n in enumerate(QUARTILES)]]
        rows.append(
            F.struct(
                F.lit(i).alias("position"), F.lit(c).alias("column_name"),
                F.count(c).alias("present"), F.count_if(F.col(c).isNull()).alias("missing"),
                F.round(F.avg(x), 6).alias("avg_value"),
                F.round(F.stddev_samp(x), 6).alias("std_value"),
                F.min(x).alias("min_value"), F.max(x).alias("max_value"), *sketches,
            )
        )
    return df.agg(F.array(*rows).alias("r")).select(F.inline("r"))


def _value_counts(df: DataFrame, columns: Sequence[str], kind: str) -> DataFrame:
    """(column_name, v, n) for the known values of all columns, in one scan."""
    cells = F.array(
        *[F.struct(F.lit(c).alias("column_name"), F.col(c).cast(kind).alias("v")) for c in columns]
    )
    return (
        df.select(F.inline(cells))
        .where("v is not null")
        .groupBy("column_name", "v")
        .agg(F.count(F.lit(1)).alias("n"))
    )


def _text_values(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    # Most frequent value; the smallest text wins a tie.
    top = F.min(F.struct((-F.col("n")).alias("less"), F.col("v").alias("v"))).alias("top")
    return (
        _value_counts(df, columns, "string")
        .groupBy("column_name")
        .agg(F.count(F.lit(1)).alias("distinct_values"), top)
        .select(
            "column_name", "distinct_values", F.col("top.v").alias("top_value"),
            (-F.col("top.less")).alias("top_count"),
            *[F.lit(None).cast("double").alias(q) for q in QUARTILES],
        )
    )


def _numeric_values(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    counts = _value_counts(df, columns, "double")
    box = quantiles(counts, "v", [0.25, 0.5, 0.75], ["column_name"], splits=None, weight="n")
    return box.select(
        "column_name", "distinct_values",
        F.lit(None).cast("string").alias("top_value"), F.lit(None).cast("bigint").alias("top_count"),
        *[F.round(F.col("q")[i], 6).alias(q) for i, q in enumerate(QUARTILES)],
    )


def most_missing(df: DataFrame, rows: int = 5) -> DataFrame:
    """The columns with most NULLs, in one scan."""
    counted = df.agg(*[F.count_if(F.col(c).isNull()).alias(c) for c in df.columns])
    cells = F.array(
        *[F.struct(F.lit(c).alias("column_name"), F.col(c).alias("missing")) for c in df.columns]
    )
    return counted.select(F.inline(cells)).orderBy(F.desc("missing"), "column_name").limit(rows)


def rate_by(customers: DataFrame, key: str, label: str = "churn") -> DataFrame:
    """Churn rate per key, the label compared in any case or padding."""
    flag = label_flag(label)
    return customers.groupBy(key).agg(
        F.count(F.lit(1)).alias("customers"),
        F.round(F.sum(flag).cast("double") / F.count(F.lit(1)), 6).alias("churn_rate"),
    )


def charge_histogram(customers: DataFrame, value: str = "monthly_charges", bins: int = 12,
                     label: str = "churn", labels: Sequence[str] = ("No", "Yes")) -> DataFrame:
    """Equal-width right-closed bins by label, one column per label and one for
    whatever else stands there. Labels are compared in any case or padding.

    The bin is one plus the inner edges below the value, which needs no
    division and puts the minimum in the first bin and equal values in one bin.
    """
    x = F.col(value).cast("double")
    extent = customers.agg(F.struct(F.min(x).alias("lo"), F.max(x).alias("hi"))).scalar()
    lo, hi = F.col("_extent.lo"), F.col("_extent.hi")
    step = (hi - lo) / bins

    def edge(i):
        return hi if i == bins else lo + i * step

    index = F.lit(1)
    for i in range(1, bins):
        index = index + F.when(x > edge(i), 1).otherwise(0)
    binned = customers.where(F.col(value).isNotNull()).withColumn("_extent", extent)
    known = F.lit("other")
    for v in labels:
        known = F.when(F.lower(F.trim(label)) == v.lower(), v).otherwise(known)
    # The edges are the same for every row; they ride along as grouping keys.
    table = binned.withColumn("_label", known).groupBy(
        index.alias("bin"), lo.alias("_lo"), hi.alias("_hi")
    ).pivot("_label", [*labels, "other"]).agg(F.count(F.lit(1)))
    width = (F.col("_hi") - F.col("_lo")) / bins
    lower = F.col("_lo") + (F.col("bin") - 1) * width
    first_lower = F.col("_lo") - 0.001 * (F.col("_hi") - F.col("_lo"))
    upper = F.when(F.col("bin") == bins, F.col("_hi")).otherwise(F.col("_lo") + F.col("bin") * width)
    return table.select(
        "bin",
        F.round(F.when(F.col("bin") == 1, first_lower).otherwise(lower), 6).alias("lower_edge"),
        F.round(upper, 6).alias("upper_edge"),
        *[F.coalesce(F.col(v), F.lit(0)).alias(f"n_{v.lower()}") for v in (*labels, "other")],
    ).orderBy("bin")
