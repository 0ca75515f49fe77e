"""The design matrix: one-hot categories, then numerics, with column names.

A fitted design is a list of levels, and a mean and deviation per numeric
column if it scales. It encodes with plain column expressions, which stay in
generated code; one conversion at the end makes the vector Spark ML wants.
"""

from __future__ import annotations

import json
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from holdfast.functions.features import add_behaviour
from holdfast.schema import Roles


MOST_LEVELS = 10_000


def refuse_wide(df: DataFrame, columns: Sequence[str]) -> None:
    """Raise, with the column's name, if a category has more than about
    ``MOST_LEVELS`` levels: an id or free text, whose levels must not be gathered."""
    found = df.agg(*[F.approx_count_distinct(c).alias(c) for c in columns]).first()
    wide = [c for c in columns if found[c] > MOST_LEVELS]
    if wide:
        raise ValueError(f"more than {MOST_LEVELS} levels: {', '.join(wide)}")


def with_inputs(df: DataFrame, roles: Roles) -> DataFrame:
    """Derived features added and numerics as doubles. Input: a cleaned frame."""
    wide = add_behaviour(df, roles)
    return wide.withColumns({c: F.col(c).cast("double") for c in roles.numeric})


@dataclass(frozen=True)
class Design:
    roles: Roles
    levels: dict[str, list[str]]
    scale: dict[str, tuple[float, float]] | None = None

    @property
    def names(self) -> list[str]:
        """<column>_<level> for the categories, then the numerics."""
        hot = [f"{c}_{lv}" for c in self.roles.categorical for lv in self.levels[c]]
        return hot + list(self.roles.numeric)

    def numeric(self, c: str) -> Column:
        """A numeric input, scaled if the design scales; a missing one raises."""
        x = F.coalesce(F.col(c), F.raise_error(F.lit(f"{c} is missing: clean the rows first")))
        if self.scale is None:
            return x
        mean, deviation = self.scale[c]
        return (x - mean) / deviation

    def row(self) -> Column:
        """The encoded row as an array. Unseen and missing levels are all zeros."""
        hot = [
            F.when(F.col(c) == lv, 1.0).otherwise(0.0)
            for c in self.roles.categorical for lv in self.levels[c]
        ]
        return F.array(*hot, *[self.numeric(c) for c in self.roles.numeric])

    def transform(self, df: DataFrame) -> DataFrame:
        """The frame and its ``features``; ``df`` has the inputs."""
        return df.withColumn("features", array_to_vector(self.row()))

    def save(self, spark: SparkSession, path: str) -> None:
        text = json.dumps({"levels": self.levels, "scale": self.scale})
        spark.createDataFrame([(text,)], "value string").coalesce(1).write.mode("overwrite").text(path)

    @classmethod
    def load(cls, spark: SparkSession, path: str, roles: Roles) -> Design:
        return cls(roles, **json.loads(spark.read.text(path).first()[0]))


def fit_design(df: DataFrame, roles: Roles, scale: bool = False) -> Design:
    """Levels in alphabetical order, and population mean and deviation of the
    numerics if asked for, from one aggregate. A constant column scales by 1."""
    cats, nums = roles.categorical, roles.numeric
    refuse_wide(df, cats)
    moments = [f(c).alias(f"{f.__name__}_{c}") for c in nums for f in (F.avg, F.stddev_pop)]
    found = df.agg(
        *[F.sort_array(F.collect_set(F.col(c).cast("string"))).alias(c) for c in cats],
        *(moments if scale else []),
    ).first()
    levels = {c: list(found[c]) for c in cats}
    if not scale:
        return Design(roles, levels)
    return Design(
        roles, levels,
        {c: (found[f"avg_{c}"] or 0.0, found[f"stddev_pop_{c}"] or 1.0) for c in nums},
    )


def long_form(rows: DataFrame, design: Design) -> DataFrame:
    """(key, feature, value) for every row and column of the design."""
    names = F.array(*[F.lit(n) for n in design.names])
    return rows.select(
        design.roles.key, F.explode(F.arrays_zip(names.alias("feature"), design.row().alias("value"))).alias("cell")
    ).select(design.roles.key, "cell.feature", "cell.value")


def design_matrix(df: DataFrame, roles: Roles) -> DataFrame:
    rows = with_inputs(df, roles)
    return long_form(rows, fit_design(rows, roles))


def scaled_numerics(df: DataFrame, roles: Roles) -> DataFrame:
    """Key and scaled numerics as the linear model sees them."""
    rows = with_inputs(df, roles)
    design = fit_design(rows, roles, scale=True)
    return rows.select(roles.key, *[design.numeric(c).alias(c) for c in roles.numeric])
