"""Attribution of scores to features.

Trees: exact Shapley values of the path-dependent tree game. A leaf is reached
when every feature on its path falls in an interval; a feature left out of the
coalition passes with the share of training rows that did. The game of one leaf
is a product over its few features, so the sum over coalitions is the integral of
a polynomial, which a few points give exactly. What a leaf needs grows with the
length of its path, and rows are explained on Arrow batches where they are.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from holdfast.operators.given import GivenTrees
from holdfast.operators.kernels import explain_rows, explain_totals
from holdfast.operators.models import Classifier
from holdfast.operators.trees import Path, grown, paths
from holdfast.session import scratch_path

MOST_BYTES = 1 << 28    # of leaves that are sent to every task


@dataclass
class LeafGames:
    """Per path length k: features, open-closed intervals and shares (leaves by k), and values."""

    groups: list[tuple[np.ndarray, ...]]
    expected: float


def _leaves(spark: SparkSession, model: Classifier | GivenTrees) -> Iterator[tuple[float, Path]]:
    if isinstance(model, GivenTrees):
        for tree in model.trees:
            yield from paths(tree)
        return
    saved = scratch_path(spark, "trees")
    model.model.write().overwrite().save(saved)
    nodes: dict[int, dict[int, object]] = {}
    for row in spark.read.parquet(f"{saved}/data").collect():
        nodes.setdefault(row["treeID"], {})[row["nodeData"]["id"]] = row["nodeData"]
    # Log-odds are twice the boosted sum.
    for tree, weight in enumerate(model.model.treeWeights):
        yield from paths(grown(nodes[tree]), 2.0 * weight)


def leaf_games(spark: SparkSession, model: Classifier | GivenTrees) -> LeafGames:
    """The leaves of all trees. Bounded by the model, whatever the data size; a
    model with more than ``MOST_BYTES`` of leaves is refused."""
    by_length: dict[int, list] = {}
    expected = 0.0
    for value, path in _leaves(spark, model):
        expected += value * float(np.prod([s for _, _, s in path.values()]))
        if path:
            by_length.setdefault(len(path), []).append((value, path))
    groups = []
    for _, leaves in sorted(by_length.items()):
        bounds = np.array([list(p.values()) for _, p in leaves])
        groups.append((
            np.array([list(p) for _, p in leaves]), bounds[:, :, 0], bounds[:, :, 1], bounds[:, :, 2],
            np.array([v for v, _ in leaves]),
        ))
    size = sum(a.nbytes for g in groups for a in g)
    if size > MOST_BYTES:
        raise ValueError(f"the model's leaves take {size} bytes, more than {MOST_BYTES} to send to every task")
    return LeafGames(groups, expected)


def tree_attribution(df: DataFrame, model: Classifier | GivenTrees) -> DataFrame:
    """(key, feature, value, phi) for every row and feature.

    Per row the phi sum to its log-odds less the expected log-odds. They
    explain the trees, not the calibrated probability.
    """
    names, key = model.names, model.roles.key
    games = leaf_games(df.sparkSession, model)
    shipped = df.sparkSession.sparkContext.broadcast(games.groups)

    def explain(batches):
        return explain_rows(batches, shipped.value, names, key)

    return model.encoded(df).mapInPandas(explain, f"`{key}` string, feature string, value double, phi double")


def global_attribution(df: DataFrame, model: Classifier | GivenTrees) -> DataFrame:
    """Mean absolute attribution per feature over all rows, largest first.

    Each batch sends one partial sum per feature, never its rows.
    """
    names = model.names
    games = leaf_games(df.sparkSession, model)
    shipped = df.sparkSession.sparkContext.broadcast(games.groups)

    def partial(batches):
        return explain_totals(batches, shipped.value, names)

    sums = model.encoded(df).select("x").mapInPandas(partial, "feature string, total double, n bigint")
    return rank_features(
        sums.groupBy("feature").agg((F.sum("total") / F.sum("n")).alias("mean_absolute_attribution"))
    )


def rank_features(table: DataFrame, by: str = "mean_absolute_attribution") -> DataFrame:
    """Few rows: one per feature."""
    return table.orderBy(F.desc(by), "feature")


def top_features(table: DataFrame, rows: int = 10) -> DataFrame:
    return rank_features(table).limit(rows)


def linear_attribution(df: DataFrame, weights: dict[str, tuple[Column, float]]) -> DataFrame:
    """Mean absolute attribution of a linear score, largest first.

    A row's share for a feature is weight times (value - mean value). The means
    are one scalar row, the result one more aggregate.
    """
    named = df.select(*[x.cast("double").alias(n) for n, (x, _) in weights.items()])
    means = named.agg(F.struct(*[F.avg(f"`{n}`").alias(n) for n in weights])).scalar()
    centred = named.withColumn("_m", means)
    sums = centred.agg(
        *[
            F.avg(F.abs((F.col(f"`{n}`") - F.col("_m")[n]) * w)).alias(n)
            for n, (_, w) in weights.items()
        ]
    )
    rows = F.array(
        *[
            F.struct(F.lit(n).alias("feature"),
                     F.round(F.col(f"`{n}`"), 6).alias("mean_absolute_attribution"))
            for n in weights
        ]
    )
    return rank_features(sums.select(F.inline(rows)))
