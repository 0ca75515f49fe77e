"""Exact interpolated quantiles from running counts of distinct values."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F

from holdfast.operators.ordered import join_groups, running_totals


def quantiles(df: DataFrame, value: str, probs: Sequence[float], within: Sequence[str] = (),
              splits: Sequence[float] | None = None, weight: str | None = None) -> DataFrame:
    """Per group: ``low``, ``high``, ``n``, ``distinct_values`` and the quantiles ``q``.

    A quantile is read at rank prob * (n - 1), linearly between the two
    neighbouring values. NULLs are left out. ``splits`` as in running_totals:
    ``()`` is for values of a small domain.
    """
    within = list(within)
    rows = F.sum(weight) if weight else F.count(F.lit(1))
    counted = running_totals(
        df.where(F.col(value).isNotNull()).withColumn("_v", F.col(value).cast("double")),
        "_v", {"_n": rows}, within, splits=splits,
    )
    total = counted.groupBy(*within).agg(F.sum("_n").alias("n"))
    # Few rows: one per group. Without groups it is a single scalar.
    if within:
        ranked = join_groups(counted, total, within)
    else:
        ranked = counted.withColumn("n", total.select("n").scalar())

    def value_at(rank):
        return F.min(F.when(F.col("run__n") > rank, F.col("_v")))

    picks = []
    for i, prob in enumerate(probs):
        rank = F.lit(float(prob)) * (F.col("n") - 1)
        picks += [
            value_at(F.floor(rank)).alias(f"_lo{i}"),
            value_at(F.ceil(rank)).alias(f"_hi{i}"),
        ]
    picked = ranked.groupBy(*within).agg(
        F.min("_v").alias("low"), F.max("_v").alias("high"), F.max("n").alias("n"),
        F.count(F.lit(1)).alias("distinct_values"), *picks
    )
    points = []
    for i, prob in enumerate(probs):
        rank = F.lit(float(prob)) * (F.col("n") - 1)
        part = rank - F.floor(rank)
        # This form returns the value itself when both neighbours are equal.
        points.append(F.col(f"_lo{i}") + (F.col(f"_hi{i}") - F.col(f"_lo{i}")) * part)
    return picked.select(*within, "low", "high", "n", "distinct_values", F.array(*points).alias("q"))
