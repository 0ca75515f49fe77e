"""KPIs and contract summary kept up to date with the keyed tables.

Customers and scores lie in buckets by the same hash of the same key, so a bucket of
the customer view needs that bucket of both and no other. After a batch, ``refresh``
reads the buckets its keys name, and writes their partial sums in place of the old
ones by the same dynamic partition overwrite that wrote the batch. Reports add up a
row for each bucket and contract and read no customer.

A refresh works from the tables as they are, not from a difference to what they were.
So it may come late, be repeated after a lost job, or follow several batches at once,
and the newest instant, which no difference can take back, is right after deletions.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from holdfast.operators import rollup
from holdfast.operators.semantic import customer_view
from holdfast.plans.loading import customer_table, score_table
from holdfast.sources.keyed_table import BUCKETS

PART = "bucket"


def refresh(spark: SparkSession, root: str, keys: DataFrame | None = None, buckets: int = BUCKETS) -> list[int]:
    """Bring the partial sums of the keys' buckets (None: of all) up to date; returns the buckets."""
    people, scores = customer_table(spark, root, buckets), score_table(spark, root, buckets)
    named = list(range(buckets)) if keys is None else people.buckets_of(keys)
    if named:
        view = customer_view(people.read(named), scores.read(named)).withColumn(PART, people.bucket())
        parts = rollup.with_empty(rollup.partials(view, PART), PART, named)
        # A row for each bucket and contract.
        parts.repartition(1).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(
            PART).parquet(_path(root))
    return named


def _path(root: str) -> str:
    return f"{root}/rollup"


def kept(spark: SparkSession, root: str) -> dict[str, DataFrame]:
    """The KPIs and the contract summary, from the partial sums alone."""
    parts = spark.read.parquet(_path(root))
    return {"v_churn_bi_kpis": rollup.kpis(parts), "v_churn_contract_summary": rollup.contract_summary(parts)}
