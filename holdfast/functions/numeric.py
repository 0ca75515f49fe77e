"""Rounding, rates and guarded arithmetic as column expressions."""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def half_even(c: Column | str, places: int) -> Column:
    """Scale, round to the nearest even integer, scale back (double arithmetic)."""
    scale = float(10**places)
    return F.rint(col(c).cast("double") * scale) / scale


def rate_pct(flag: Column, places: int = 2) -> Column:
    """Share of rows where ``flag`` holds, in percent; NULL over no rows.

    The quotient is taken on doubles and rounded once. Averaging a decimal
    literal would round twice.
    """
    return F.round(100.0 * F.count_if(flag) / F.nullif(F.count(F.lit(1)), F.lit(0)), places)


def share(flag: Column) -> Column:
    """Share of rows where ``flag`` holds, unrounded; NULL over no rows."""
    return F.count_if(flag).cast("double") / F.nullif(F.count(F.lit(1)), F.lit(0))


def exact_sum(c: Column | str, where: Column | None = None) -> Column:
    """Sum of a money column kept in decimals; NULL over no rows."""
    c = col(c)
    return F.sum(c if where is None else F.when(where, c))


def money_sum(c: Column | str, where: Column | None = None) -> Column:
    return F.round(exact_sum(c, where).cast("double"), 2)


def mean(c: Column | str, places: int | None = 2) -> Column:
    """Average of a whole-number or money column, divided in decimals.

    A double quotient of an inexact double sum can fall on the wrong side of a
    rounding tie. Fourteen decimal places are kept before the one rounding.
    """
    c = col(c)
    value = F.sum(c).cast("decimal(28,4)") / F.nullif(F.count(c), F.lit(0))
    return (value if places is None else F.round(value, places)).cast("double")


def ratio_or_zero(a: Column, b: Column) -> Column:
    return F.coalesce(F.try_divide(a.cast("double"), b.cast("double")), F.lit(0.0))


def total_of(columns: list[Column]) -> Column:
    out = F.lit(0)
    for c in columns:
        out = out + c
    return out


def banded(c: Column | str, bands: tuple[tuple[int | None, str], ...]) -> Column:
    """First band whose upper bound is not below the value; last band is open."""
    c = col(c)
    chain = F
    for upper, name in bands[:-1]:
        chain = chain.when(c <= upper, name)
    return chain.otherwise(bands[-1][1])


def band_order(c: Column | str, bands: tuple[tuple[int | None, str], ...]) -> Column:
    c = col(c)
    chain = F
    for rank, (upper, _) in enumerate(bands[:-1], start=1):
        chain = chain.when(c <= upper, rank)
    return chain.otherwise(len(bands))
