"""Value of a contact policy and the choice of its threshold.

Thresholds are hundredths, so every one of them is a cell edge of a grid over
[0, 1]. One aggregate fills at most 102 cells; all thresholds, and the two
reference policies at 0 and 1, are suffix sums over those cells.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window, functions as F

from holdfast import constants as K
from holdfast.functions.risk import annuity

GRID = 100


@dataclass(frozen=True)
class Offer:
    cost: float = K.OFFER_COST
    success: float = K.OFFER_SUCCESS
    months: float = K.LIFETIME_MONTHS
    annual_rate: float = K.ANNUAL_DISCOUNT


def _outcome(offer: Offer) -> list[Column]:
    """Money columns from counts and the customer value of caught and missed churners."""
    factor = annuity(offer.months, offer.annual_rate)
    caught = F.coalesce(F.col("caught").cast("double"), F.lit(0.0)) * factor
    missed = F.coalesce(F.col("missed").cast("double"), F.lit(0.0)) * factor
    outreach = (F.col("tp_count") + F.col("fp_count")) * offer.cost
    saved = caught * offer.success
    return [
        outreach.alias("outreach_cost"),
        saved.alias("saved_revenue"),
        (missed + caught * (1.0 - offer.success)).alias("lost_revenue"),
        (saved - outreach).alias("net_value"),
    ]


def financial_outcome(df: DataFrame, threshold: float, offer: Offer = Offer(), y: str = "y",
                      p: str = "p", monthly: str = "monthly_charges") -> DataFrame:
    """Counts and money at one threshold (contacted when p >= threshold)."""
    hit = F.coalesce(F.col(p) >= float(threshold), F.lit(False))
    real = F.col(y) == 1
    counted = df.agg(
        F.count_if(hit & real).alias("tp_count"),
        F.count_if(hit & ~real).alias("fp_count"),
        F.count_if(~hit & real).alias("fn_count"),
        F.count_if(~hit & ~real).alias("tn_count"),
        F.sum(F.when(hit & real, F.col(monthly))).alias("caught"),
        F.sum(F.when(~hit & real, F.col(monthly))).alias("missed"),
    )
    return counted.select(
        F.lit(float(threshold)).alias("threshold"),
        "tp_count", "fp_count", "fn_count", "tn_count", *_outcome(offer),
    )


def grid_curve(df: DataFrame, offer: Offer = Offer(), y: str = "y", p: str = "p",
               monthly: str = "monthly_charges") -> DataFrame:
    """The outcome at every hundredth from 0 to 1, in one pass over the data."""
    score = F.col(p).cast("double")
    # Number of the last grid point not above the score; -1 if there is none.
    # The division i / 100 gives the very double the threshold is compared as,
    # so the guess from the product is corrected by comparing with neighbours.
    guess = F.floor(score * GRID)
    cell = (
        guess
        + F.when(score >= (guess + 1) / float(GRID), 1).otherwise(0)
        - F.when(score < guess / float(GRID), 1).otherwise(0)
    )
    # NULL first: greatest and least would skip it.
    cell = F.greatest(F.lit(-1), F.least(F.lit(GRID), F.coalesce(cell, F.lit(-1))))
    real = F.col(y) == 1
    cells = df.groupBy(cell.cast("int").alias("cell")).agg(
        F.count_if(real).alias("pos"),
        F.count_if(~real).alias("neg"),
        F.sum(F.when(real, F.col(monthly))).alias("worth"),
    )
    grid = df.sparkSession.range(-1, GRID + 1).select(F.col("id").cast("int").alias("cell"))
    # At most 102 rows from here on.
    whole = Window.partitionBy(F.lit(0))
    above = whole.orderBy(F.desc("cell")).rowsBetween(Window.unboundedPreceding, 0)
    filled = grid.join(cells, "cell", "left").select(
        "cell", *[F.coalesce(c, F.lit(0)).alias(c) for c in ("pos", "neg", "worth")]
    )
    summed = filled.select(
        (F.col("cell") / float(GRID)).alias("threshold"), "cell",
        F.sum("pos").over(above).alias("tp_count"),
        F.sum("neg").over(above).alias("fp_count"),
        (F.sum("pos").over(whole) - F.sum("pos").over(above)).alias("fn_count"),
        (F.sum("neg").over(whole) - F.sum("neg").over(above)).alias("tn_count"),
        F.sum("worth").over(above).alias("caught"),
        (F.sum("worth").over(whole) - F.sum("worth").over(above)).alias("missed"),
    )
    return summed.where("cell >= 0").select(
        "cell", "threshold", "tp_count", "fp_count", "fn_count", "tn_count", *_outcome(offer)
    )


def _cells(first: float, last: float, step: float) -> list[int]:
    """Thresholds as hundredths; a step that is no whole number of them is refused."""
    hundredths = step * GRID
    if round(hundredths) < 1 or abs(hundredths - round(hundredths)) > 1e-9:
        raise ValueError(f"thresholds are hundredths; a step of {step} is none")
    n = int(round((last - first) / step))
    return sorted({round(round(first + i * step, 2) * GRID) for i in range(n + 1)})


def threshold_curve(df: DataFrame, offer: Offer = Offer(), first: float = K.THRESHOLD_FIRST,
                    last: float = K.THRESHOLD_LAST, step: float = K.THRESHOLD_STEP,
                    **columns: str) -> DataFrame:
    curve = grid_curve(df, offer, **columns)
    return curve.where(F.col("cell").isin(_cells(first, last, step))).drop("cell").orderBy("threshold")


def best_threshold(df: DataFrame, offer: Offer = Offer(), first: float = K.THRESHOLD_FIRST,
                   last: float = K.THRESHOLD_LAST, step: float = K.THRESHOLD_STEP,
                   **columns: str) -> DataFrame:
    """The threshold of greatest net value (the lowest one if several tie) and
    its gain over contacting nobody (t = 1) and everybody (t = 0).

    A score of exactly 1 is contacted even at t = 1.
    """
    curve = grid_curve(df, offer, **columns)
    swept = F.col("cell").isin(_cells(first, last, step))
    fields = [c for c in curve.columns if c != "cell"]
    # Ties are decided on cents: sums of doubles may differ in the last bits.
    best = F.max(
        F.when(
            swept,
            F.struct(F.round("net_value", 6).alias("v"), (-F.col("threshold")).alias("t"),
                     F.struct(*fields).alias("row")),
        )
    )
    picked = curve.agg(
        best.alias("best"),
        F.max(F.when(F.col("cell") == GRID, F.col("net_value"))).alias("nobody"),
        F.max(F.when(F.col("cell") == 0, F.col("net_value"))).alias("everybody"),
    )
    net = F.col("best.row.net_value")
    return picked.select(
        "best.row.*",
        (net - F.col("nobody")).alias("savings_vs_do_nothing"),
        (net - F.col("everybody")).alias("savings_vs_contact_all"),
    )


def policy_value(df: DataFrame, threshold: float, offer: Offer = Offer(), **columns: str) -> DataFrame:
    """Held-out value of the chosen policy and its gain over contacting all.

    Here the gain over doing nothing is the net value itself.
    """
    chosen = financial_outcome(df, threshold, offer, **columns)
    everyone = financial_outcome(df, 0.0, offer, **columns).select("net_value").scalar()
    net = F.col("net_value")
    return chosen.select(
        net.alias("retention_policy_net_value"),
        net.alias("savings_vs_do_nothing"),
        (net - everyone).alias("savings_vs_contact_everyone"),
    )
