"""A model whose numbers are given rather than fitted."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, functions as F

from holdfast.operators.trees import Split
from holdfast.schema import TABLE_ROLES, Roles


@dataclass(frozen=True)
class GivenLogistic:
    """A logistic score from written-down coefficients.

    ``slopes`` multiply numeric columns; ``levels`` add a weight for each value
    of a column, 0 for a value not named. A NULL input gives a NULL score. It
    offers what scoring and streaming ask of a fitted classifier, and stays in
    generated code.
    """

    intercept: float
    slopes: dict[str, float] = field(default_factory=dict)
    levels: dict[str, dict[str, float]] = field(default_factory=dict)
    roles: Roles = TABLE_ROLES

    def margin(self) -> Column:
        total = F.lit(float(self.intercept))
        for column, slope in self.slopes.items():
            total = total + F.lit(float(slope)) * F.col(column).cast("double")
        for column, weights in self.levels.items():
            step = F.lit(0.0)
            for value, weight in weights.items():
                step = F.when(F.col(column) == value, float(weight)).otherwise(step)
            total = total + F.when(F.col(column).isNotNull(), step)
        return total

    def probability(self, df: DataFrame) -> DataFrame:
        """The frame with the probability ``p``."""
        return df.select(*df.columns, (1 / (1 + F.exp(-self.margin()))).alias("p"))


@dataclass(frozen=True)
class GivenTrees:
    """A written-down ensemble: the margin is the sum of the leaves a row reaches.

    ``inputs`` names the features and gives each as an SQL expression; splits
    refer to them by position. A NULL input is an error, as in a fitted design.
    It offers what attribution asks of a fitted classifier.
    """

    inputs: dict[str, str]
    trees: tuple[Split | float, ...]
    roles: Roles = TABLE_ROLES

    @property
    def names(self) -> list[str]:
        return list(self.inputs)

    def encoded(self, df: DataFrame) -> DataFrame:
        """The key and the encoded row ``x``."""
        def number(name: str, x: str) -> Column:
            missing = F.raise_error(F.lit(f"{name} is missing; clean the rows first")).cast("double")
            return F.coalesce(F.expr(x).cast("double"), missing)

        return df.select(self.roles.key, F.array(*[number(n, x) for n, x in self.inputs.items()]).alias("x"))
