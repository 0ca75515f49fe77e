"""A column profile kept as mergeable sketches, for any selection without a new scan.

``sketched`` reads the rows once and leaves one row for each cell (a combination of
the columns a report may select by) and profiled column: exact counts, range and sums,
a distinct-value sketch, a quantile sketch of numbers, and a sketch of the most frequent
values. Their size has a bound that does not depend on the rows of the cell, so the
table is written once (for instance a folder a day) and ``merged`` answers for any union
of cells: one partial aggregate over sketches, never over rows.

Bounds, for cells merged in any order:

* distinct values: relative standard error ``1.04 / sqrt(2 ** DISTINCT_BITS)``, 1.3 %;
* quantiles: the rank of the value given is within ``RANK_ERROR`` of the one asked for,
  at about 99 %; all values are held, and the answer exact, up to some ``QUANTILE_K`` rows;
* most frequent values: exact with up to ``0.75 * TOP_ITEMS`` distinct values; beyond, a
  count may be too great by what one slot has dropped, about rows / TOP_ITEMS.

NULLs count as missing and enter no sketch. A cell's NULL key is a key of its own. A
column with NULLs only has no range, quantile or value. An empty table gives no rows.
The exact form is ``profile.profile``.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F, types as T

DISTINCT_BITS = 13
QUANTILE_K = 1024
RANK_ERROR = 0.005
TOP_ITEMS = 1024


def distinct_error() -> float:
    return 1.04 / (1 << DISTINCT_BITS) ** 0.5


def sketched(df: DataFrame, columns: Sequence[str], by: Sequence[str] = ()) -> DataFrame:
    """(``by``..., column_name, numeric, sketches) of each cell, in one pass.

    All columns are sketched by one aggregate, side by side, so that a row is not
    copied for each column; the result is turned to a row a column afterwards.
    """
    numbers = {f.name for f in df.schema.fields if isinstance(f.dataType, T.NumericType)}
    entries = [_entry(c, c in numbers) for c in columns]
    cells = df.groupBy(*by).agg(*[e.alias(f"s{i}") for i, e in enumerate(entries)], F.count(F.lit(1)).alias("cell_rows"))
    # Without keys an aggregate has a row even over no rows.
    return cells.where("cell_rows > 0").select(*by, F.inline(F.array(*[f"s{i}" for i in range(len(columns))])))


def _entry(name: str, numeric: bool) -> Column:
    x = F.col(name).cast("double") if numeric else F.lit(None).cast("double")
    ranks = F.kll_sketch_agg_double(x, QUANTILE_K) if numeric else F.lit(None).cast("binary")
    return F.struct(
        F.lit(name).alias("column_name"), F.lit(numeric).alias("numeric"),
        F.count(name).alias("present"), F.count_if(F.col(name).isNull()).alias("missing"),
        F.min(x).alias("min_value"), F.max(x).alias("max_value"),
        F.hll_sketch_agg(F.col(name).cast("string"), DISTINCT_BITS).alias("distinct_sketch"),
        ranks.alias("rank_sketch"),
        F.call_function("approx_top_k_accumulate", F.col(name).cast("string"), F.lit(TOP_ITEMS)).alias("top_sketch"),
    )


def merged(sketches: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """The sketches of each union of cells that agree in ``by``, in the same form."""
    return sketches.groupBy(*by, "column_name", "numeric").agg(
        F.sum("present").alias("present"), F.sum("missing").alias("missing"),
        F.min("min_value").alias("min_value"), F.max("max_value").alias("max_value"),
        F.hll_union_agg("distinct_sketch").alias("distinct_sketch"),
        F.kll_merge_agg_double("rank_sketch", QUANTILE_K).alias("rank_sketch"),
        F.call_function("approx_top_k_combine", F.col("top_sketch"), F.lit(TOP_ITEMS)).alias("top_sketch"),
    )


def estimates(sketches: DataFrame, by: Sequence[str] = (), quantiles: Sequence[float] = (0.25, 0.5, 0.75),
              top: int = 1) -> DataFrame:
    """What a report shows of each row of sketches: counts, range, ``distinct_values``,
    ``quantiles`` (an array, NULL for text) and ``top``, (value, n) by count, then value."""
    held = F.col("numeric") & (F.col("present") > 0)
    values = F.kll_sketch_get_quantile_double("rank_sketch", F.array(*[F.lit(q) for q in quantiles]))
    # All that the sketch holds, so that of equally frequent values the smallest come first.
    found = F.call_function("approx_top_k_estimate", F.col("top_sketch"), F.lit(TOP_ITEMS))
    ranked = F.sort_array(F.transform(
        F.filter(found, lambda e: e["item"].isNotNull()),
        lambda e: F.struct((-e["count"]).alias("less"), e["item"].alias("value"))))
    return sketches.select(
        *by, "column_name", "present", "missing", F.hll_sketch_estimate("distinct_sketch").alias("distinct_values"),
        "min_value", "max_value", F.when(held, values).alias("quantiles"),
        F.transform(F.slice(ranked, 1, top), lambda e: F.struct(e["value"].alias("value"), (-e["less"]).alias("n"))).alias("top"),
    )


def judged(df: DataFrame, estimated: DataFrame, columns: Sequence[str], by: Sequence[str],
           quantiles: Sequence[float] = (0.25, 0.5, 0.75)) -> DataFrame:
    """(``by``..., column_name, distinct_within, ranks_within): whether estimates keep
    the bounds stated above, by a pass over the rows. For tests and audits of a table."""
    keys = [F.col(c).alias(f"k{i}") for i, c in enumerate(by)]
    cells = F.array(*[F.struct(F.lit(c).alias("c"), F.col(c).cast("string").alias("v")) for c in columns])
    rows = df.select(*keys, F.inline(cells)).where("v is not null").groupBy(
        *[f"k{i}" for i in range(len(by))], "c", "v").agg(F.count(F.lit(1)).alias("n"))
    same = [F.col(f"k{i}").eqNullSafe(F.col(c)) for i, c in enumerate(by)]
    both = rows.join(estimated.select(*by, "column_name", "distinct_values", "quantiles"),
                     [F.col("c") == F.col("column_name"), *same])
    x, all_rows = F.col("v").try_cast("double"), F.sum("n")
    within = F.lit(True)
    for i, q in enumerate(quantiles):
        value = F.col("quantiles")[i]
        below = F.sum(F.when(x < value, F.col("n")).otherwise(0)) / all_rows
        up_to = F.sum(F.when(x <= value, F.col("n")).otherwise(0)) / all_rows
        within = within & (below <= q + RANK_ERROR) & (up_to >= q - RANK_ERROR)
    exact = F.count(F.lit(1))
    return both.groupBy(*by, "column_name").agg(
        (F.abs(F.max("distinct_values") - exact) <= 4 * distinct_error() * exact).alias("distinct_within"),
        F.when(F.max(F.size("quantiles")) > 0, within).alias("ranks_within"),
    )
