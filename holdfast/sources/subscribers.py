"""Subscriber, score and evaluation frames derived from the sales tables.

The sales schema has no subscriptions. A customer with no order in the last
six months of the table counts as churned; tenure is the span of its orders in
months; the contract follows its number of orders. The remaining attributes
are arithmetic on keys and only give the operators something to group by.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from holdfast import constants as K
from holdfast.schema import MONEY, PROBABILITY

SCORED_AT = "2024-01-01 00:00:00"
SEGMENTS = ("AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD")
PAYMENT_METHODS = ("Electronic check", "Mailed check", "Bank transfer (automatic)")


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def derive_subscribers(customer: DataFrame, orders: DataFrame) -> DataFrame:
    history = orders.groupBy(F.col("o_custkey").alias("c_custkey")).agg(
        F.min("o_orderdate").alias("first_order"),
        F.max("o_orderdate").alias("last_order"),
        F.count(F.lit(1)).alias("n"),
    )
    table_end = orders.agg(F.max("o_orderdate")).scalar()

    k, nation, n = F.col("c_custkey"), F.col("c_nationkey"), F.col("n")
    first, last = F.col("first_order"), F.col("last_order")

    def yes_if(test):
        return F.when(test, "Yes").otherwise("No")

    def add_on(test):
        return F.when(F.col("internet_service") == "No", "No internet service").otherwise(
            yes_if(test)
        )

    months = (F.year(last) - F.year(first)) * 12 + F.month(last) - F.month(first)
    cents = (1825 + F.floor(F.abs("c_acctbal") * 100) % 10050).cast("bigint")
    segment = F.col("c_mktsegment")
    internet = (
        F.when(segment.isin(*SEGMENTS[:2]), "DSL")
        .when(segment == SEGMENTS[2], "No")
        .otherwise("Fiber optic")
    )
    # A customer without orders is a subscriber of tenure 0 who has not left.
    base = customer.join(history, "c_custkey", "left").withColumn("n", F.coalesce("n", F.lit(0))).withColumns(
        {
            "tenure": F.when(last.isNull(), 0).otherwise(F.least(F.lit(72), months)).cast("int"),
            "cents": cents,
            "internet_service": internet,
        }
    )
    tenure, cents = F.col("tenure"), F.col("cents")
    payment = F.element_at(F.array(*[F.lit(p) for p in PAYMENT_METHODS]), (k % 4 + 1).cast("int"))
    return base.select(
        F.concat(F.lit("C"), k.cast("string")).alias("customer_id"),
        F.when(k % 2 == 0, "Female").otherwise("Male").alias("gender"),
        F.when(k % 6 == 0, 1).otherwise(0).alias("senior_citizen"),
        yes_if(nation % 2 == 0).alias("partner"),
        yes_if(nation % 3 == 0).alias("dependents"),
        tenure,
        yes_if(k % 10 != 0).alias("phone_service"),
        F.when(k % 10 == 0, "No phone service").otherwise(yes_if(k % 10 < 5)).alias("multiple_lines"),
        "internet_service",
        add_on(k % 3 == 0).alias("online_security"),
        add_on(k % 4 < 2).alias("online_backup"),
        add_on(k % 5 < 2).alias("device_protection"),
        add_on(k % 7 < 2).alias("tech_support"),
        add_on(n % 2 == 0).alias("streaming_tv"),
        add_on(n % 3 == 0).alias("streaming_movies"),
        F.when(n <= 8, K.CONTRACTS[0]).when(n <= 11, K.CONTRACTS[1]).otherwise(K.CONTRACTS[2]).alias("contract"),
        yes_if(k % 5 < 3).alias("paperless_billing"),
        F.when(k % 4 < 3, payment).otherwise("Credit card (automatic)").alias("payment_method"),
        (cents / 100).cast(MONEY).alias("monthly_charges"),
        F.when(tenure != 0, (F.floor(cents * tenure * (90 + k % 21) / 100) / 100).cast(MONEY)).alias("total_charges"),
        yes_if(last < table_end - F.expr("INTERVAL '6' MONTH")).alias("churn"),
    )


def reference_score():
    """A logistic score with fixed coefficients; test data, not a model."""
    lift = (
        F.when(F.col("contract") == K.CONTRACTS[0], 1.0)
        .when(F.col("contract") == K.CONTRACTS[1], 0.0)
        .otherwise(-1.0)
    )
    margin = (
        1.2 - 0.04 * F.col("tenure").cast("double")
        + 0.02 * F.col("monthly_charges").cast("double") + lift
    )
    return 1 / (1 + F.exp(-margin))


def derive_scores(customers: DataFrame) -> DataFrame:
    """Fixed-coefficient scores of the active customers, in the score table's types."""
    factor = 26.58774208248756
    p, monthly = F.col("p"), F.col("monthly_charges").cast("double")
    scored = customers.where(F.col("churn") == "No").withColumn("p", reference_score())
    return scored.select(
        "customer_id", "tenure", "contract", "monthly_charges",
        F.round(p, 4).cast(PROBABILITY).alias("churn_probability"),
        F.when(p <= 0.30, "Low").when(p <= 0.60, "Medium").otherwise("High").alias("risk_level"),
        F.when(p >= 0.5, 1).otherwise(0).alias("is_high_risk"),
        F.round(p * monthly, 2).cast(MONEY).alias("revenue_at_risk"),
        F.round(factor * monthly, 2).cast(MONEY).alias("clv_estimate"),
        F.round(p * factor * monthly, 2).cast(MONEY).alias("clv_at_risk"),
        F.lit(SCORED_AT).cast("timestamp_ntz").alias("scored_at"),
    )


def derive_evaluation(customers: DataFrame) -> DataFrame:
    """Label and score of every customer. The score is stored at four places,
    so equal scores tie in every engine."""
    return customers.select(
        "customer_id", "tenure", "contract", "monthly_charges",
        F.when(F.col("churn") == "Yes", 1).otherwise(0).alias("y"),
        F.round(reference_score(), 4).alias("p"),
    )


def subscribers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return derive_subscribers(
        read_table(spark, sf_dir, "customer"), read_table(spark, sf_dir, "orders")
    )


def reorder_gaps(orders: DataFrame) -> DataFrame:
    """Days from each order to the customer's next one; the last is censored at
    the end of the table. A second survival input, unrelated to subscriptions.

    Gaps are taken between distinct order days of a customer, so one customer's
    window never holds more rows than the calendar has days.
    """
    from pyspark.sql import Window

    day = F.to_date("o_orderdate")
    days = orders.groupBy("o_custkey", day.alias("day")).agg(F.count(F.lit(1)).alias("n"))
    table_end = orders.agg(F.max(day)).scalar()
    next_day = F.lead("day").over(Window.partitionBy("o_custkey").orderBy("day"))
    gaps = days.withColumn("next_day", next_day)
    last = F.datediff(F.coalesce("next_day", table_end), F.col("day"))
    # Orders repeated on one day: all but the last wait zero days, observed.
    repeated = gaps.where("n > 1").select(
        F.lit(0).alias("duration"), F.lit(1).alias("event"), (F.col("n") - 1).alias("n")
    )
    final = gaps.select(
        last.alias("duration"), F.col("next_day").isNotNull().cast("int").alias("event"),
        F.lit(1).cast("bigint").alias("n"),
    )
    return final.unionByName(repeated)
