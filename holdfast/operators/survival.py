"""Kaplan-Meier curves and a proportional-hazards fit."""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame, functions as F

from holdfast.operators.design import refuse_wide
from holdfast.operators.kernels import hazard_increments, hazard_terms
from holdfast.operators.ordered import accumulate, running_totals, split_points

Z_95 = 1.959963984540054


def _risk_table(df: DataFrame, duration: str, event: str, within: Sequence[str],
                weight: str | None, splits) -> DataFrame:
    """Per (stratum, time): subjects at risk, events and all leaving."""
    n = F.sum(weight) if weight else F.count(F.lit(1))
    hit = F.col(event) == 1
    d = F.sum(F.when(hit, F.col(weight)).otherwise(0)) if weight else F.count_if(hit)
    table = running_totals(
        df, duration, {"events": d, "leaving": n}, within, descending=True, splits=splits
    )
    return table.select(
        *within, F.col(duration).alias("time"), "events", "leaving",
        F.col("run_leaving").alias("at_risk"),
    )


def kaplan_meier(df: DataFrame, duration: str = "tenure", event: str = "event",
                 within: Sequence[str] = (), weight: str | None = None,
                 band: bool = False, splits: Sequence[float] | None = None) -> DataFrame:
    """Survival after each distinct time, per stratum.

    Rows collapse to distinct times before anything is ordered, so a stratum
    with most of the rows is no larger than one with few. Durations known to be
    few (capped months, days of a calendar) may pass ``splits=()``, which saves
    the look at how many there are.
    """
    within = list(within)
    if splits is None:
        splits = split_points(df, F.col(duration), within=within)
    table = _risk_table(df, duration, event, within, weight, splits)
    d, n = F.col("events").cast("double"), F.col("at_risk").cast("double")
    table = table.withColumns(
        {"_stay": 1.0 - d / n, "_var": F.when(n > d, d / (n * (n - d))).otherwise(0.0)}
    )
    curve = accumulate(table, "time", ["_stay"], within, splits=splits, how="product")
    curve = curve.withColumnRenamed("run__stay", "survival")
    if not band:
        return curve.select(*within, "time", "at_risk", "events", "survival")

    curve = accumulate(curve, "time", ["_var"], within, splits=splits)
    s = F.col("survival")
    inside = (s > 0) & (s < 1)
    reach = Z_95 * F.sqrt("run__var") / F.when(inside, F.log(s))
    low, high = F.pow(s, F.exp(-reach)), F.pow(s, F.exp(reach))
    # No event yet: no spread. Nobody left: the limits are not defined.
    return curve.select(
        *within, "time", "at_risk", "events", "survival",
        F.when(s == 1, F.lit(1.0)).when(inside, F.least(low, high)).alias("lower"),
        F.when(s == 1, F.lit(1.0)).when(inside, F.greatest(low, high)).alias("upper"),
    )


def median_survival(curve: DataFrame, within: Sequence[str] = ()) -> DataFrame:
    """First time at which at most half survive; infinite if never reached."""
    reached = F.min(F.when(F.col("survival") <= 0.5, F.col("time").cast("double")))
    return curve.groupBy(*within).agg(
        F.coalesce(reached, F.lit(math.inf)).alias("median_survival")
    )


def dummies(df: DataFrame, columns: Sequence[str], drop_first: bool = True) -> tuple[DataFrame, list[str]]:
    """Indicator columns, the alphabetically first level left out.

    The levels of all columns come from one aggregate.
    """
    refuse_wide(df, columns)
    found = df.agg(*[F.sort_array(F.collect_set(c)).alias(c) for c in columns]).first()
    names: list[str] = []
    new: dict[str, Column] = {}
    for c in columns:
        for level in found[c][1 if drop_first else 0:]:
            name = f"{c}_{level}"
            new[name] = F.when(F.col(c) == level, 1).otherwise(0)
            names.append(name)
    return df.withColumns(new).drop(*columns), names


# --- proportional hazards ---------------------------------------------------

TIE_CHUNK = 1 << 16


class HazardFit:
    """Newton steps on the partial likelihood with Efron's tie correction.

    Each step is one aggregate of the data to distinct times: the weighted sums
    of 1, x and x x' over everyone leaving at that time and over those who
    leave by the event. Reverse running totals turn them into risk sets. The
    terms within a tie are split into chunks, so a time that holds a third of
    all events is spread over many tasks. The driver receives one gradient and
    one matrix as wide as the covariates.
    """

    def __init__(self, df: DataFrame, duration: str, event: str, covariates: Sequence[str],
                 max_iter: int = 50, tolerance: float = 1e-9,
                 splits: Sequence[float] | None = None):
        self.names = list(covariates)
        self.k = len(self.names)
        self.max_iter, self.tolerance = max_iter, tolerance
        xs = [F.col(f"`{c}`").cast("double").alias(f"x{i}") for i, c in enumerate(self.names)]
        # Equal rows are one row with a weight; whole months and list prices
        # repeat, so this usually shrinks the data a lot before the iterations.
        self.rows = (
            df.select(F.col(duration).alias("time"), (F.col(event) == 1).alias("hit"), *xs)
            .groupBy("time", "hit", *[f"x{i}" for i in range(self.k)])
            .agg(F.count(F.lit(1)).alias("w"))
            .persist(StorageLevel.MEMORY_AND_DISK)
        )
        means = self.rows.agg(
            *[F.sum(F.col(f"x{i}") * F.col("w")) / F.sum("w") for i in range(self.k)]
        ).first()
        self.centre = np.array([float(v or 0.0) for v in means])
        self.splits = split_points(self.rows, F.col("time")) if splits is None else splits

    def _weighed(self, beta: np.ndarray) -> DataFrame:
        """The rows, covariates centred, with their margin ``m`` and weighted risk ``e``."""
        margin = F.lit(0.0)
        for i in range(self.k):
            margin = margin + F.col(f"x{i}") * float(beta[i])
        return self.rows.withColumns(
            {f"x{i}": F.col(f"x{i}") - float(self.centre[i]) for i in range(self.k)}
        ).withColumn("m", margin).withColumn("e", F.col("w") * F.exp("m"))

    def _sums(self, beta: np.ndarray) -> DataFrame:
        """Per event time: sums over the risk set (``run_*``) and over the tie (``t*``)."""
        k, c, weighed = self.k, F.col, self._weighed(beta)
        terms = {"s": c("e")}
        terms |= {f"s{i}": c("e") * c(f"x{i}") for i in range(k)}
        terms |= {f"s{i}_{j}": c("e") * c(f"x{i}") * c(f"x{j}") for i in range(k) for j in range(i, k)}
        plain = {"d": c("w"), "m": c("w") * c("m")} | {f"g{i}": c("w") * c(f"x{i}") for i in range(k)}
        sums = {n: F.sum(v) for n, v in (terms | plain).items()}
        halves = weighed.groupBy("time", "hit").agg(*[v.alias(n) for n, v in sums.items()])
        # Two rows per time from here on.
        by_time = halves.groupBy("time").agg(
            *[F.sum(n).alias(n) for n in terms],
            *[F.coalesce(F.sum(F.when(c("hit"), c(n))), F.lit(0.0)).alias(f"t{n}") for n in terms],
            F.coalesce(F.sum(F.when(c("hit"), c("d"))), F.lit(0)).alias("d"),
            *[F.coalesce(F.sum(F.when(c("hit"), c(n))), F.lit(0.0)).alias(n) for n in plain if n != "d"],
        )
        return accumulate(by_time, "time", list(terms), descending=True, splits=self.splits).where(
            "d > 0"
        )

    def _chunks(self, beta: np.ndarray) -> DataFrame:
        """The event times' sums, a row for each chunk [lo, hi) of a time's tied events."""
        one = F.lit(1).cast("bigint")
        starts = F.sequence(0 * one, F.col("d") - 1, TIE_CHUNK * one)
        chunks = self._sums(beta).select("*", F.explode(starts).alias("lo")).withColumn(
            "hi", F.least(F.col("lo") + TIE_CHUNK, F.col("d"))
        )
        return chunks.repartition("time", "lo")

    def step(self, beta: np.ndarray) -> tuple[float, np.ndarray, np.ndarray]:
        """Log-likelihood, gradient and information at ``beta``."""
        k = self.k
        names = ["ll", *[f"u{i}" for i in range(k)],
                 *[f"h{i}_{j}" for i in range(k) for j in range(i, k)]]
        row = (
            self._chunks(beta)
            .mapInPandas(lambda batches: hazard_terms(batches, k),
                         ", ".join(f"{n} double" for n in names))
            .agg(*[F.sum(n).alias(n) for n in names])
            .first()
        )
        if row["ll"] is None:
            raise ValueError("no events to fit a hazard on")
        info = np.zeros((k, k))
        for i in range(k):
            for j in range(i, k):
                info[i, j] = info[j, i] = row[f"h{i}_{j}"]
        return row["ll"], np.array([row[f"u{i}"] for i in range(k)]), info

    def fit(self) -> np.ndarray:
        beta = np.zeros(self.k)
        value, gradient, info = self.step(beta)
        for _ in range(self.max_iter):
            move = np.linalg.solve(info, gradient)
            if gradient @ move < self.tolerance:
                return beta + move
            scale = 1.0
            while True:
                trial = self.step(beta + scale * move)
                if trial[0] >= value or scale < 1e-4:
                    break
                scale /= 2
            beta = beta + scale * move
            value, gradient, info = trial
        raise RuntimeError("the hazard fit did not converge")


    def residuals(self, beta: np.ndarray) -> DataFrame:
        """(time, hit, x*, w, r*): each distinct row's share in the gradient.

        What the events up to a row's time add to the hazard is a running sum over
        times, joined back to the rows; a row that is itself an event of its time
        bears Efron's lesser share of that time's ties.
        """
        k = self.k
        whole = ["h", *[f"hx{i}" for i in range(k)]]
        names = [*whole, "th", *[f"thx{i}" for i in range(k)], *[f"m{i}" for i in range(k)]]
        kind = self.rows.schema["time"].dataType.simpleString()
        added = (
            self._chunks(beta)
            .mapInPandas(lambda batches: hazard_increments(batches, k),
                         ", ".join([f"time {kind}", *(f"{n} double" for n in names)]))
            .groupBy("time").agg(*[F.sum(n).alias(n) for n in names])
        )
        times = self.rows.select("time").distinct().join(added, "time", "left").na.fill(0.0, names)
        run = accumulate(times, "time", whole, splits=self.splits)
        c = F.col
        rows = self._weighed(beta).join(run, "time")

        def residual(i: int) -> Column:
            risk = F.exp("m")
            event = c(f"x{i}") - c(f"m{i}") - risk * (
                c(f"x{i}") * (c("run_h") - c("h") + c("th")) - (c(f"run_hx{i}") - c(f"hx{i}") + c(f"thx{i}"))
            )
            return F.when(c("hit"), event).otherwise(-risk * (c(f"x{i}") * c("run_h") - c(f"run_hx{i}")))

        return rows.select(
            "time", "hit", *[(c(f"x{i}") + float(self.centre[i])).alias(f"x{i}") for i in range(k)], "w",
            *[residual(i).alias(f"r{i}") for i in range(k)],
        )

    def spread(self, beta: np.ndarray) -> np.ndarray:
        """The sum of the residuals' outer products over all rows; one small matrix to the driver."""
        k = self.k
        pairs = [(i, j) for i in range(k) for j in range(i, k)]
        row = self.residuals(beta).agg(
            *[F.sum(F.col("w") * F.col(f"r{i}") * F.col(f"r{j}")).alias(f"v{i}_{j}") for i, j in pairs]
        ).first()
        out = np.zeros((k, k))
        for i, j in pairs:
            out[i, j] = out[j, i] = row[f"v{i}_{j}"]
        return out


def hazard_table(df: DataFrame, duration: str, event: str, covariates: Sequence[str], **options) -> DataFrame:
    """One row per covariate: coefficient, hazard ratio, its model-based error, the robust
    error from the sandwich of the residuals' spread between two inverse informations,
    and z and two-sided p of the latter."""
    fit = HazardFit(df, duration, event, covariates, **options)
    try:
        beta = fit.fit()
        inverse = np.linalg.inv(fit.step(beta)[2])
        robust = np.sqrt(np.diag(inverse @ fit.spread(beta) @ inverse))
    finally:
        fit.rows.unpersist()
    rows = [
        (name, float(b), math.exp(b), float(e), float(r), float(b / r) if r else None,
         math.erfc(abs(b / r) / math.sqrt(2)) if r else None)
        for name, b, e, r in zip(fit.names, beta, np.sqrt(np.diag(inverse)), robust)
    ]
    return df.sparkSession.createDataFrame(
        rows, "covariate string, coefficient double, hazard_ratio double, model_error double, "
        "robust_error double, z double, p_value double"
    )


def hazard_ratios(df: DataFrame, duration: str, event: str, covariates: Sequence[str],
                  **options) -> DataFrame:
    """One row per covariate: the factor on the hazard for one unit more."""
    fit = HazardFit(df, duration, event, covariates, **options)
    try:
        beta = fit.fit()
    finally:
        fit.rows.unpersist()
    return df.sparkSession.createDataFrame(
        [(n, float(math.exp(b))) for n, b in zip(fit.names, beta)],
        "covariate string, hazard_ratio double",
    )
