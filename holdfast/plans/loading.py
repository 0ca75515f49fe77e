"""From the raw file to the keyed tables, the tables for reports and the semantic views."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from holdfast.functions.cleaning import clean, to_table
from holdfast.operators.reports import workbook_tables
from holdfast.operators.semantic import contract_summary, customer_view, kpis
from holdfast.schema import CUSTOMERS, RAW_ROLES, SCORES
from holdfast.sources.files import publish_views, read_checked, save_bucketed
from holdfast.sources.keyed_table import BUCKETS, KeyedTable


def customer_table(spark: SparkSession, root: str, buckets: int = BUCKETS) -> KeyedTable:
    return KeyedTable(spark, f"{root}/customers", CUSTOMERS, "customer_id", buckets=buckets)


def score_table(spark: SparkSession, root: str, buckets: int = BUCKETS) -> KeyedTable:
    return KeyedTable(spark, f"{root}/churn_scores", SCORES, "customer_id", "scored_at", buckets)


def load_customers(spark: SparkSession, raw_path: str, root: str, buckets: int = BUCKETS,
                   run_id: str = "latest") -> int:
    """Clean the raw file and upsert its sound records by customer; returns their count.

    What can't be read, or names no customer, is kept under the run's id in the
    quarantine table, in place of what an earlier run of that id left there.
    """
    sound, others = read_checked(spark, raw_path)
    # By its own folder, so that a run without bad records replaces one with some.
    others.write.mode("overwrite").parquet(f"{root}/quarantine/run_id={run_id}")
    return customer_table(spark, root, buckets).upsert(to_table(clean(sound, RAW_ROLES)))


def quarantined(spark: SparkSession, root: str, run_id: str = "latest") -> DataFrame:
    """The records a load set aside."""
    return spark.read.parquet(f"{root}/quarantine/run_id={run_id}")


def delete_customers(spark: SparkSession, root: str, keys: DataFrame, at: str, buckets: int = BUCKETS) -> None:
    """Remove customers and, with them, their scores up to the instant ``at``.

    Scores go first: a run that stops between the two leaves no score without a
    customer, and may be repeated.
    """
    score_table(spark, root, buckets).delete(keys, at)
    customer_table(spark, root, buckets).delete(keys)


def create_tables(spark: SparkSession, database: str, buckets: int = 200, location: str | None = None) -> None:
    """The database, and empty tables for customers and scores, bucketed alike on
    their key; what exists is left alone. ``location``: the folder of a new database."""
    where = f" LOCATION '{location}'" if location else ""
    spark.sql(f"CREATE DATABASE IF NOT EXISTS {database}{where}")
    for name, schema in (("customers", CUSTOMERS), ("churn_scores", SCORES)):
        if not spark.catalog.tableExists(f"{database}.{name}"):
            save_bucketed(spark.createDataFrame([], schema), f"{database}.{name}", "customer_id", buckets)


def publish_tables(spark: SparkSession, customers: DataFrame, scores: DataFrame, database: str,
                   buckets: int = 200, location: str | None = None) -> dict[str, DataFrame]:
    """Customers, scores and the three views as catalog tables for report tools.

    Customers and scores are bucketed alike on their key, so the customer view, and
    every view on it, joins them without a shuffle. The customer view is kept
    bucketed as well.
    """
    create_tables(spark, database, buckets, location)
    save_bucketed(customers, f"{database}.customers", "customer_id", buckets)
    save_bucketed(scores, f"{database}.churn_scores", "customer_id", buckets)
    views = semantic_views(spark.table(f"{database}.customers"), spark.table(f"{database}.churn_scores"))
    for name, view in views.items():
        if "customer_id" in view.columns:
            save_bucketed(view, f"{database}.{name}", "customer_id", buckets)
        else:
            view.write.mode("overwrite").saveAsTable(f"{database}.{name}")
    return views


def write_workbook(customers: DataFrame, scores: DataFrame, path: str) -> None:
    for sheet, table in workbook_tables(customers, scores).items():
        table.write.mode("overwrite").parquet(f"{path}/{sheet}")


def semantic_views(customers: DataFrame, scores: DataFrame) -> dict[str, DataFrame]:
    """The three views by name. Customers lead the join, so a score whose
    customer is gone does not appear."""
    view = customer_view(customers, scores)
    return {
        "v_customer_churn_analytics": view,
        "v_churn_bi_kpis": kpis(view),
        "v_churn_contract_summary": contract_summary(view),
    }


def open_views(spark: SparkSession, root: str) -> dict[str, DataFrame]:
    views = semantic_views(customer_table(spark, root).read(), score_table(spark, root).read())
    publish_views(views)
    return views
