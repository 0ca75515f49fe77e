"""Running totals over a global order, without a single-partition window.

Rows are first collapsed to one per distinct order key, so a key that holds a
third of all rows is one row afterwards (the collapse is combined map-side).
If the keys may be many, split points cut the order into ranges of about equal
weight; a window runs inside each range and the totals of the earlier ranges
are added. Equal keys always share a range, because the range is a function of
the key and of split points fixed before the plan is built.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame, Window, functions as F

ROWS_PER_RANGE = 500_000
SKETCH = 10_000
_INF = float("inf")


def split_points(df: DataFrame, order: Column, rows_per_range: int = ROWS_PER_RANGE,
                 within: Sequence[str] = ()) -> list[float]:
    """Cut points for an order key: none if its distinct values fit one range.

    The look at their number is one scan without a shuffle. Cuts are percentiles
    over distinct (within, key) rows, which is what a range's window works on, so
    a key that holds most of the rows weighs no more than any other.
    """
    keys = df.select(*within, order.cast("double").alias("_key"))
    counted = F.struct(*within, "_key") if within else F.col("_key")
    distinct = keys.agg(F.approx_count_distinct(counted)).first()[0]
    ranges = -(-distinct // rows_per_range)
    if ranges <= 1:
        return []
    steps = [i / ranges for i in range(1, ranges)]
    cuts = keys.distinct().agg(F.percentile_approx("_key", steps, max(SKETCH, 10 * ranges))).first()[0]
    return sorted(set(cuts or []))


def running_totals(
    df: DataFrame,
    order: str,
    sums: dict[str, Column],
    within: Sequence[str] = (),
    descending: bool = False,
    splits: Sequence[float] | None = None,
    rows_per_range: int = ROWS_PER_RANGE,
) -> DataFrame:
    """Per distinct (within, order): each sum, and ``run_<name>`` up to and
    including that key in the chosen direction.

    ``splits=()`` says the keys are few by their type or domain (months, money
    bins, four-place scores) and skips the look at the data. ``None`` takes
    split points from the data.
    """
    if splits is None:
        splits = split_points(df, F.col(order), rows_per_range, within)
    within = list(within)
    keyed = df.groupBy(*within, order).agg(*[c.alias(n) for n, c in sums.items()])
    return accumulate(keyed, order, list(sums), within, descending, splits)


def join_groups(rows: DataFrame, per_group: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Attach one row per group to the group's rows; a NULL key is a group too."""
    renamed = per_group.withColumnsRenamed({k: f"_k_{k}" for k in keys})
    same = [rows[k].eqNullSafe(renamed[f"_k_{k}"]) for k in keys]
    return rows.join(renamed, same).drop(*[f"_k_{k}" for k in keys])


def accumulate(keyed: DataFrame, order: str, names: Sequence[str], within: Sequence[str] = (),
               descending: bool = False, splits: Sequence[float] = (),
               how: str = "sum") -> DataFrame:
    """The running part of ``running_totals``, for rows already one per key.

    ``how='product'`` multiplies instead of adding.
    """
    fold, neutral = {"sum": (F.sum, 0), "product": (F.product, 1.0)}[how]
    within = list(within)

    def along(column: str, *group: str):
        direction = F.col(column).desc() if descending else F.col(column).asc()
        # Without groups every row carries the same constant key: callers get
        # here only with rows bounded by a domain or one for each range.
        return Window.partitionBy(*(group or [F.lit(0)])).orderBy(direction)

    def up_to_here(window):
        return window.rowsBetween(Window.unboundedPreceding, Window.currentRow)

    if not splits:
        frame = up_to_here(along(order, *within))
        return keyed.select("*", *[fold(n).over(frame).alias(f"run_{n}") for n in names])

    ranged = Bucketizer(
        splits=[-_INF, *splits, _INF], inputCol="_pos", outputCol="_range", handleInvalid="keep"
    ).transform(keyed.withColumn("_pos", F.col(order).cast("double"))).drop("_pos")
    # A NULL key sorts below all others, a NaN above; so must their ranges.
    ranged = ranged.withColumn("_range", F.when(F.col(order).isNull(), -1.0).otherwise(F.col("_range")))
    inside = up_to_here(along(order, *within, "_range"))
    earlier = along("_range", *within).rowsBetween(Window.unboundedPreceding, -1)
    # One row per (within, range).
    offsets = (
        ranged.groupBy(*within, "_range")
        .agg(*[fold(n).alias(f"_t_{n}") for n in names])
        .select(*within, "_range", *[fold(f"_t_{n}").over(earlier).alias(f"_o_{n}") for n in names])
    )

    def combined(n: str) -> Column:
        here, offset = fold(n).over(inside), F.coalesce(F.col(f"_o_{n}"), F.lit(neutral))
        return here + offset if how == "sum" else here * offset

    return join_groups(ranged, offsets, [*within, "_range"]).select(
        *keyed.columns, *[combined(n).alias(f"run_{n}") for n in names]
    )
