"""Exact evaluation of scores against labels.

All metrics read a frame with a 0/1 label and a score. Ranking metrics collapse
to distinct scores first and then use distributed running totals; nothing is
binned.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from holdfast.functions.numeric import ratio_or_zero
from holdfast.operators.ordered import running_totals
from holdfast.operators.quantiles import quantiles


Thresholds = Sequence[float] | dict[str, float]


def _by_score(df: DataFrame, y: str, p: str, splits) -> DataFrame:
    """One row per distinct score, with totals over that score and all above."""
    positive = F.col(y) == 1
    return running_totals(
        df, p, {"pos": F.count_if(positive), "neg": F.count_if(~positive)},
        descending=True, splits=splits,
    )


# Aggregates over the frame above. Pair counts stay whole numbers in decimals.

def _auc() -> Column:
    """Chance that a positive outranks a negative, ties counting half."""
    pos, pairs = F.col("pos").cast("decimal(38,0)"), F.sum("pos").cast("double") * F.sum("neg")
    lost = F.sum(pos * (2 * F.col("run_neg") - F.col("neg"))).cast("double") / 2
    return (pairs - lost) / F.nullif(pairs, F.lit(0.0))


def _average_precision() -> Column:
    """Sum over distinct scores, best first, of recall gained times precision."""
    seen = (F.col("run_pos") + F.col("run_neg")).cast("double")
    gained = F.sum(F.col("pos") * (F.col("run_pos") / seen))
    return gained / F.nullif(F.sum("pos").cast("double"), F.lit(0.0))


def _brier(p: str) -> Column:
    miss = F.col("pos") * F.pow(1 - F.col(p), F.lit(2)) + F.col("neg") * F.pow(F.col(p), F.lit(2))
    return F.sum(miss) / F.nullif(F.sum(F.col("pos") + F.col("neg")).cast("double"), F.lit(0.0))


def _matrix_columns() -> list[Column]:
    """The 2x2 matrix and its metrics from n, positives, hit and tp."""
    tp, fp = F.col("tp"), F.col("hit") - F.col("tp")
    fn = F.col("positives") - tp
    tn = F.col("n") - F.col("positives") - fp
    return [
        tn.alias("tn"), fp.alias("fp"), fn.alias("fn"), tp.alias("tp"),
        F.try_divide((tp + tn).cast("double"), F.col("n")).alias("accuracy"),
        ratio_or_zero(tp, F.col("hit")).alias("precision"),
        ratio_or_zero(tp, F.col("positives")).alias("recall"),
    ]


def _per_threshold(counted: DataFrame, thresholds: Thresholds, extra: Sequence[str] = ()) -> DataFrame:
    """Turn the one row of ``counted`` (hit0, tp0, hit1, ...) into one per threshold."""
    named = isinstance(thresholds, dict)
    names, values = (thresholds.keys(), thresholds.values()) if named else ((), thresholds)
    names = list(names)
    rows = F.array(
        *[
            F.struct(
                *([F.lit(names[i]).alias("policy")] if named else []),
                F.lit(float(t)).alias("threshold"),
                *[F.coalesce(c, F.lit(0)).alias(n) for n, c in (
                    ("n", F.col("n")), ("positives", F.col("positives")),
                    ("hit", F.col(f"hit{i}")), ("tp", F.col(f"tp{i}")))],
                *[F.col(c) for c in extra],
            )
            for i, t in enumerate(values)
        ]
    )
    return counted.select(F.inline(rows)).select(
        *(["policy"] if named else []), "threshold", *_matrix_columns(), *extra
    )


def _values(thresholds: Thresholds) -> list[float]:
    return [float(t) for t in (thresholds.values() if isinstance(thresholds, dict) else thresholds)]


def confusion(df: DataFrame, thresholds: Thresholds, y: str = "y", p: str = "p") -> DataFrame:
    """Counts and threshold metrics, one row per threshold, in one aggregate.

    Named thresholds ({policy: value}) also carry their name.
    """
    real = F.col(y) == 1
    hits = [F.col(p) >= t for t in _values(thresholds)]
    return _per_threshold(
        df.agg(
            F.count(F.lit(1)).alias("n"), F.count_if(real).alias("positives"),
            *[F.count_if(h).alias(f"hit{i}") for i, h in enumerate(hits)],
            *[F.count_if(h & real).alias(f"tp{i}") for i, h in enumerate(hits)],
        ),
        thresholds,
    )


def roc_auc(df: DataFrame, y: str = "y", p: str = "p", splits=None) -> DataFrame:
    """NULL when a class is absent."""
    return _by_score(df, y, p, splits).agg(_auc().alias("roc_auc"))


def average_precision(df: DataFrame, y: str = "y", p: str = "p", splits=None) -> DataFrame:
    return _by_score(df, y, p, splits).agg(_average_precision().alias("avg_precision"))


def brier(df: DataFrame, y: str = "y", p: str = "p") -> DataFrame:
    return df.agg(F.avg(F.pow(F.col(p) - F.col(y), F.lit(2))).alias("brier_score"))


def evaluate(df: DataFrame, thresholds: Thresholds, y: str = "y", p: str = "p",
             splits=None) -> DataFrame:
    """All metrics, one row per threshold, from one collapse to distinct scores.

    Ranking metrics do not depend on the threshold and repeat per row.
    """
    hits = [F.col(p) >= t for t in _values(thresholds)]
    both = F.col("pos") + F.col("neg")
    counted = _by_score(df, y, p, splits).agg(
        F.sum(both).alias("n"), F.sum("pos").alias("positives"),
        *[F.sum(F.when(h, both)).alias(f"hit{i}") for i, h in enumerate(hits)],
        *[F.sum(F.when(h, F.col("pos"))).alias(f"tp{i}") for i, h in enumerate(hits)],
        _auc().alias("roc_auc"), _average_precision().alias("avg_precision"),
        _brier(p).alias("brier_score"),
    )
    return _per_threshold(counted, thresholds, ("roc_auc", "avg_precision", "brier_score"))


def evaluation_table(models: dict[str, tuple[DataFrame, float]], splits=None) -> DataFrame:
    """Each model at 0.50 and at its own cost threshold."""
    out = None
    for name, (df, cost_threshold) in models.items():
        policies = {"default": 0.5, "cost": cost_threshold}
        rows = evaluate(df, policies, splits=splits).select(F.lit(name).alias("model"), "*")
        out = rows if out is None else out.unionByName(rows)
    return out


def miss_change(baseline_fn, candidate_fn):
    """Relative fall in missed positives, in percent; 0 without any misses."""
    return F.coalesce(
        F.try_divide((baseline_fn - candidate_fn).cast("double"), baseline_fn) * 100.0, F.lit(0.0)
    )


def calibration_curve(df: DataFrame, bins: int = 10, y: str = "y", p: str = "p",
                      splits=None) -> DataFrame:
    """Observed and mean predicted rate per quantile bin; empty bins vanish.

    A score falls in the bin after the inner edges that lie below it.
    """
    inner = [i / bins for i in range(1, bins)]
    edges = quantiles(df, p, inner, splits=splits).select("q").scalar()
    index = F.lit(0)
    for i in range(bins - 1):
        index = index + F.when(F.col(p) > F.col("_q")[i], 1).otherwise(0)
    return (
        df.withColumn("_q", edges)
        .groupBy(index.alias("bin"))
        .agg(
            F.count(F.lit(1)).alias("n"),
            F.round(F.avg(F.col(y).cast("double")), 6).alias("observed_rate"),
            F.round(F.avg(p), 6).alias("mean_predicted"),
        )
        .orderBy("bin")
    )


def best_candidate(results: DataFrame) -> DataFrame:
    """Highest accuracy, then ranking quality; the first candidate wins a tie."""
    pick = F.max(F.struct("accuracy", "roc_auc", (-F.col("candidate")).alias("neg"))).alias("b")
    return results.agg(pick).select(
        (-F.col("b.neg")).alias("candidate"), "b.accuracy", "b.roc_auc"
    )
