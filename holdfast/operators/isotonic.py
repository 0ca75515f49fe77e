"""Isotonic regression of a label on a score, spread over ranges of the score.

Rows of equal scores are pooled first. The fit is the slope of the greatest convex
minorant of the cumulative (weight, sum) curve: its edges are blocks of neighbouring
scores that share one rate, and rates rise from block to block. Split points cut the
scores into ranges; each range reduces its own points to blocks. Neighbouring ranges
then meet, a few at a time, and only where their curves meet are blocks joined: the
common tangent of two convex curves. Counts are whole numbers, and rates are compared
by cross products, so blocks do not depend on ranges or rounding.

Blocks of n rows with labels 0 and 1 have rising rates of different fractions whose
denominators add up to n at most; there are at most some n^(2/3) of them, usually
about n^(1/3). That bounds what the last task and a model built on them hold.
"""

from __future__ import annotations

from collections.abc import Iterable, Sequence

import pyarrow as pa
from pyspark.ml.feature import Bucketizer
from pyspark.sql import DataFrame, functions as F

from holdfast.operators.ordered import ROWS_PER_RANGE, split_points

FAN_IN = 16
_BLOCKS = "part bigint, low double, high double, n bigint, positives bigint"
Block = tuple[float, float, int, int]


def pool(blocks: Iterable[Block]) -> list[Block]:
    """Blocks in the order of their scores, joined until each rate is above the one before."""
    out: list[Block] = []
    for low, high, n, positives in blocks:
        while out and out[-1][3] * n >= positives * out[-1][2]:
            low, _, more, hits = out.pop()
            n, positives = n + more, positives + hits
        out.append((low, high, n, positives))
    return out


def _pooled(key: tuple, group: pa.Table) -> pa.Table:
    rows = group.sort_by("low")
    names = ["low", "high", "n", "positives"]
    blocks = pool(zip(*(rows.column(c).to_pylist() for c in names)))
    columns = [list(c) for c in zip(*blocks)]
    kinds = (pa.float64(), pa.float64(), pa.int64(), pa.int64())
    return pa.table({
        "part": pa.array([key[0].as_py()] * len(blocks), pa.int64()),
        **{name: pa.array(c, kind) for name, c, kind in zip(names, columns, kinds)},
    })


def isotonic_steps(df: DataFrame, y: str = "y", p: str = "p", splits: Sequence[float] | None = None,
                   rows_per_range: int = ROWS_PER_RANGE) -> DataFrame:
    """One row per block: lowest and highest score, rows, positives, and their rate.

    ``y`` is 0 or 1. Rows without a score or label take no part. ``splits`` as in
    ``running_totals``: ``()`` says that the scores are few by their domain.
    """
    known = df.where(F.col(p).isNotNull() & ~F.isnan(p) & F.col(y).isNotNull())
    if splits is None:
        splits = split_points(known, F.col(p), rows_per_range)
    points = known.groupBy(F.col(p).cast("double").alias("low")).agg(
        F.count(F.lit(1)).alias("n"), F.sum(F.col(y).cast("bigint")).alias("positives")
    )
    if splits:
        ranged = Bucketizer(
            splits=[-float("inf"), *splits, float("inf")], inputCol="low", outputCol="range"
        ).transform(points)
    else:
        ranged = points.withColumn("range", F.lit(0.0))
    blocks = ranged.select(F.col("range").cast("bigint").alias("part"), "low", F.col("low").alias("high"), "n", "positives")
    blocks = blocks.groupBy("part").applyInArrow(_pooled, _BLOCKS)
    parts = len(splits) + 1
    while parts > 1:
        parts = -(-parts // FAN_IN)
        blocks = blocks.withColumn("part", F.floor(F.col("part") / FAN_IN)).groupBy("part").applyInArrow(_pooled, _BLOCKS)
    return blocks.select("low", "high", "n", "positives", (F.col("positives") / F.col("n")).alias("rate"))
