from math import ceil

import pytest
from pyspark.sql import functions as F

from holdfast.operators import split
from holdfast.operators.split import assign_parts, fold_quotas, holdout_quotas
from holdfast.plans.training import split_frame
from holdfast.schema import TABLE_ROLES


def labelled(spark, n, positives):
    return spark.range(n).select(
        F.concat(F.lit("C"), F.col("id")).alias("customer_id"),
        F.when(F.col("id") < positives, 1).otherwise(0).alias("y"),
        F.when(F.col("id") < positives, "Yes").otherwise("No").alias("churn"),
    )


def sizes(df, part):
    return {(r[part], r["y"]): r["n"] for r in df.groupBy(part, "y").agg(F.count("*").alias("n")).collect()}


@pytest.mark.parametrize("bits", [2, 16])
def test_holdout_sizes(spark, monkeypatch, bits):
    monkeypatch.setattr(split, "BUCKET_BITS", bits)
    df = assign_parts(labelled(spark, 7043, 1869), "y", "customer_id", holdout_quotas(0.2))
    assert sizes(df, "part") == {(1, 1): 374, (1, 0): 1035, (0, 1): 1495, (0, 0): 4139}


def test_small_and_one_sided(spark):
    df = assign_parts(labelled(spark, 5, 5), "y", "customer_id", holdout_quotas(0.2))
    assert sizes(df, "part") == {(0, 1): 4, (1, 1): 1}
    nothing = assign_parts(labelled(spark, 5, 2).limit(0), "y", "customer_id", holdout_quotas(0.2))
    assert nothing.count() == 0


@pytest.mark.parametrize("n, positives", [(20, 5), (103, 31), (7, 3)])
def test_folds_deal_out_the_sorted_classes(spark, n, positives):
    df = assign_parts(labelled(spark, n, positives), "y", "customer_id", fold_quotas(5), name="fold")
    want = {}
    for seat, y in enumerate([0] * (n - positives) + [1] * positives):
        want[(seat % 5, y)] = want.get((seat % 5, y), 0) + 1
    assert sizes(df, "fold") == want


def test_membership_ignores_partitions_and_order(spark):
    df = labelled(spark, 500, 150)
    def members(frame):
        cut = assign_parts(frame, "y", "customer_id", holdout_quotas(0.2))
        return {r.customer_id for r in cut.where("part = 1").collect()}

    first = members(df)
    assert first == members(df.repartition(11).orderBy(F.desc("customer_id")))
    other = assign_parts(df, "y", "customer_id", holdout_quotas(0.2), seed=43)
    assert first != {r.customer_id for r in other.where("part = 1").collect()}


def test_three_parts(spark):
    parts = split_frame(labelled(spark, 1000, 265), TABLE_ROLES)
    n = {r["part"]: r["n"] for r in parts.groupBy("part").agg(F.count("*").alias("n")).collect()}
    assert n == {2: 200, 1: ceil(800 * 0.2), 0: 640}
