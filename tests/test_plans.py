"""What the optimizer makes of the queries."""

import re

from compare import plan
from holdfast.plans import catalog


def test_missing_services_scans_its_input_once(spark, sf):
    table = catalog.presented(catalog.customers(spark, sf))
    path = f"{catalog.scratch_path(spark, 'plan')}"
    table.write.parquet(path)
    from holdfast.operators.segments import missing_services

    text = plan(missing_services(spark.read.parquet(path)))
    assert text.count("FileScan") == 1
    assert "EqualTo(churn,Yes)" in text
    columns = re.search(r"ReadSchema: struct<([^>]*)>", text)[1]
    assert {c.split(":")[0] for c in columns.split(",")} == {
        "churn", "tech_support", "online_security", "online_backup", "device_protection"}


def test_filters_reach_the_scan(spark, sf):
    path = f"{catalog.scratch_path(spark, 'plan')}"
    catalog.scores(spark, sf).write.parquet(path)
    scores = spark.read.parquet(path)
    from holdfast.operators.segments import high_value_at_risk, intervention_queue

    text = plan(high_value_at_risk(scores))
    assert "GreaterThan(monthly_charges,90" in text and "GreaterThanOrEqual(churn_probability" in text
    assert "TakeOrderedAndProject" in plan(intervention_queue(scores))


def test_queue_of_ten_reads_no_more_columns_than_it_shows(spark, sf):
    path = f"{catalog.scratch_path(spark, 'plan')}"
    catalog.scores(spark, sf).write.parquet(path)
    from holdfast.operators.reports import score_summary

    text = plan(score_summary(spark.read.parquet(path)))
    assert "ReadSchema: struct<is_high_risk:int,revenue_at_risk:decimal(10,2)>" in text


def test_parts_are_assigned_without_a_shuffle(spark, sf):
    from holdfast.operators.split import find_cuts, holdout_quotas

    path = f"{catalog.scratch_path(spark, 'plan')}"
    catalog.evaluation(spark, sf).write.parquet(path)
    rows = spark.read.parquet(path)
    cuts = find_cuts(rows, "y", "customer_id", holdout_quotas(0.2))
    assert "Exchange" not in plan(rows.withColumn("part", cuts.part()))


def test_ranged_running_totals_window_by_range(spark, sf):
    from pyspark.sql import functions as F
    from holdfast.operators.ordered import running_totals

    df = running_totals(catalog.evaluation(spark, sf), "p", {"n": F.count("*")}, splits=(0.2, 0.5))
    windows = re.findall(r"Window \[.*?\], \[(.*?)\], \[", plan(df))
    # The only window without the range as its key runs over one row per range.
    assert any("_range" in w for w in windows)
