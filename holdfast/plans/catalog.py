"""Every registered query: a callable from (session, table folder) to a frame.

All of them run over the whole given tables. Subscribers, scores and the
evaluation frame are derived from ``customer`` and ``orders``.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from holdfast import constants as K
from holdfast.functions.cleaning import clean, features_and_label, label_flag, to_table
from holdfast.functions.features import add_behaviour
from holdfast.functions.numeric import half_even
from holdfast.functions.risk import contact_tier, lifetime_value
from holdfast.operators import (
    attribution, design, evaluate, isotonic, keyed, models, policy, profile, reports, segments, semantic,
    sketches, split, survival,
)
from holdfast.operators.given import GivenLogistic, GivenTrees
from holdfast.operators.ordered import running_totals
from holdfast.operators.trees import Split
from holdfast.plans import rollups, scoring, training
from holdfast.plans.loading import (
    customer_table, delete_customers, publish_tables, score_table, semantic_views,
)
from holdfast.schema import MONEY, TABLE_ROLES
from holdfast.session import scratch_path
from holdfast.sources import files, subscribers as src
from holdfast.streaming import live

Query = Callable[[SparkSession, str], DataFrame]
SCORED_AT = src.SCORED_AT
RESCORED_AT = "2024-02-01 00:00:00"
QUERY_BUCKETS = 8

def presented(df: DataFrame) -> DataFrame:
    """Decimals as doubles, the last step before a result leaves."""
    return df.select(
        *[
            (F.col(f.name).cast("double") if isinstance(f.dataType, T.DecimalType)
             else F.col(f.name)).alias(f.name)
            for f in df.schema.fields
        ]
    )


def rounded(df: DataFrame, places: int = 6, keep: tuple[str, ...] = ()) -> DataFrame:
    return df.select(
        *[
            (F.round(f.name, places) if isinstance(f.dataType, T.DoubleType) and f.name not in keep
             else F.col(f.name)).alias(f.name)
            for f in df.schema.fields
        ]
    )


# --- inputs ----------------------------------------------------------------

def customers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return src.subscribers(spark, sf_dir)


def scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return src.derive_scores(customers(spark, sf_dir))


def evaluation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return src.derive_evaluation(customers(spark, sf_dir))


def view(spark: SparkSession, sf_dir: str) -> DataFrame:
    return semantic.customer_view(customers(spark, sf_dir), scores(spark, sf_dir))


def cleaned(spark: SparkSession, sf_dir: str) -> DataFrame:
    return clean(customers(spark, sf_dir), TABLE_ROLES, "senior_citizen")


def raw_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The customers as the raw file has them: raw names, blank total charges."""
    c = customers(spark, sf_dir)
    total = F.coalesce(F.concat(F.lit(" "), F.col("total_charges").cast("string")), F.lit(" "))
    return c.withColumn("total_charges", total).withColumnsRenamed(
        {table: raw for raw, table in K.RAW_TO_TABLE.items()}
    )


# --- queries with more than one step ---------------------------------------

def q_load_clean(spark, sf_dir):
    """The records as a folder of CSV files, read back by the checking reader."""
    path = scratch_path(spark, "raw")
    raw_records(spark, sf_dir).write.option("header", True).csv(path)
    return presented(to_table(files.read_clean(spark, path)))


def q_label_features(spark, sf_dir):
    return presented(features_and_label(cleaned(spark, sf_dir), TABLE_ROLES))


def q_features(spark, sf_dir):
    return rounded(
        add_behaviour(cleaned(spark, sf_dir), TABLE_ROLES).select("customer_id", *K.ENGINEERED_COLUMNS), 9
    )


def q_clv(spark, sf_dir):
    value = lifetime_value("monthly_charges")
    return customers(spark, sf_dir).select(
        "customer_id", F.round(value, 2).alias("clv_estimate"),
        F.col("monthly_charges").cast("double").alias("monthly_charges"),
    )


def q_contact_tier(spark, sf_dir):
    e = evaluation(spark, sf_dir).withColumn("tier", contact_tier("p", 0.5))
    return e.groupBy("tier").agg(
        F.count(F.lit(1)).alias("customers"), F.min("p").alias("lowest"), F.max("p").alias("highest")
    )


def q_upsert_customers(spark, sf_dir):
    """Active customers arrive with a raised charge; the table holds everyone
    on a two-year contract and everyone who left."""
    c = customers(spark, sf_dir)
    table = customer_table(spark, scratch_path(spark, "tables"), QUERY_BUCKETS)
    table.upsert(c.where("contract = 'Two year' or churn = 'Yes'"))
    raised = (F.col("monthly_charges") * F.lit(1.1).cast("decimal(3,1)")).cast(MONEY)
    table.upsert(c.where("churn = 'No'").withColumn("monthly_charges", raised))
    return presented(table.read())


def q_upsert_scores(spark, sf_dir):
    """A later run rescored monthly contracts, twice; the newest row stays, also
    when the older of the two comes again."""
    s = scores(spark, sf_dir)
    table = score_table(spark, scratch_path(spark, "tables"), QUERY_BUCKETS)
    table.upsert(s)
    again = s.where("contract = 'Month-to-month'")
    first = again.withColumn("risk_level", F.lit("Low"))
    second = again.withColumns(
        {"risk_level": F.lit("High"), "scored_at": F.lit(RESCORED_AT).cast("timestamp_ntz")}
    )
    table.upsert(first.unionByName(second), on_duplicate="latest")
    table.upsert(first, on_duplicate="latest")
    return presented(table.read())


def q_delete_customers(spark, sf_dir):
    """Two-year customers are deleted with their scores; those who left come back and
    are scored anew, and the first scores of all arrive once more."""
    root = scratch_path(spark, "tables")
    c, s = customers(spark, sf_dir), scores(spark, sf_dir)
    people, table = customer_table(spark, root, QUERY_BUCKETS), score_table(spark, root, QUERY_BUCKETS)
    people.upsert(c)
    table.upsert(s)
    gone = c.where("contract = 'Two year'")
    delete_customers(spark, root, gone, RESCORED_AT, QUERY_BUCKETS)
    back = gone.where("senior_citizen = 1")
    people.upsert(back)
    later = s.join(back, "customer_id", "left_semi").withColumns(
        {"risk_level": F.lit("High"), "scored_at": F.lit("2024-03-01 00:00:00").cast("timestamp_ntz")}
    )
    table.upsert(later, on_duplicate="latest")
    table.upsert(s, on_duplicate="latest")
    held = table.read().select("customer_id", "risk_level", "scored_at")
    return people.read().select("customer_id", "contract").join(held, "customer_id", "full")


def _rolled_up(spark, sf_dir):
    """Three upserts and a deletion, each followed by a refresh of its buckets: all
    customers, all scores, raised charges of monthly customers who stay, and a later run
    that flags the one-year customers; then two-year customers go."""
    root = scratch_path(spark, "tables")
    c, s = customers(spark, sf_dir), scores(spark, sf_dir)
    people, table = customer_table(spark, root, QUERY_BUCKETS), score_table(spark, root, QUERY_BUCKETS)
    people.upsert(c)
    table.upsert(s)
    rollups.refresh(spark, root, buckets=QUERY_BUCKETS)
    raised = (F.col("monthly_charges") * F.lit(1.1).cast("decimal(3,1)")).cast(MONEY)
    monthly = c.where("contract = 'Month-to-month' and churn = 'No'").withColumn("monthly_charges", raised)
    people.upsert(monthly)
    rollups.refresh(spark, root, monthly, QUERY_BUCKETS)
    later = s.where("contract = 'One year'").withColumns(
        {"is_high_risk": F.lit(1), "scored_at": F.lit(RESCORED_AT).cast("timestamp_ntz")}
    )
    table.upsert(later, on_duplicate="latest")
    rollups.refresh(spark, root, later, QUERY_BUCKETS)
    gone = c.where("contract = 'Two year'")
    delete_customers(spark, root, gone, RESCORED_AT, QUERY_BUCKETS)
    rollups.refresh(spark, root, gone, QUERY_BUCKETS)
    return rollups.kept(spark, root)


def q_sketch_profile(spark, sf_dir):
    """Sketches of cells by contract and label, merged for each contract. Values of the
    quantile and distinct sketches are held against their stated bounds."""
    c = customers(spark, sf_dir)
    path = scratch_path(spark, "sketches")
    columns = ["payment_method", "internet_service", "tenure", "monthly_charges", "total_charges"]
    sketches.sketched(c, columns, ["contract", "churn"]).write.parquet(path)
    found = sketches.estimates(sketches.merged(spark.read.parquet(path), ["contract"]), ["contract"])
    # Charges have more values than a sketch of frequent ones holds exactly.
    top = F.when(~F.col("column_name").like("%charges"), F.col("top")[0])
    within = sketches.judged(c, found, columns, ["contract"])
    return found.join(within, ["contract", "column_name"]).select(
        "contract", "column_name", "present", "missing", "min_value", "max_value",
        top["value"].alias("top_value"), top["n"].alias("top_count"),
        *[F.col(c).cast("int").alias(c) for c in ("distinct_within", "ranks_within")],
    )


def q_v1_bucketed(spark, sf_dir):
    """The customer view over catalog tables that are bucketed alike."""
    location = scratch_path(spark, "published")
    database = location.rsplit("/", 1)[1].replace("-", "_")
    views = publish_tables(
        spark, customers(spark, sf_dir), scores(spark, sf_dir), database, QUERY_BUCKETS, location
    )
    return presented(views["v_customer_churn_analytics"])


def q_constraint_report(spark, sf_dir):
    """Checked against the customers still under contract terms of a year or
    more, so monthly customers' scores are orphans and show up as such."""
    c = customers(spark, sf_dir)
    return keyed.constraint_report(c.where("contract <> 'Month-to-month'"), scores(spark, sf_dir))


def q_cascade(spark, sf_dir):
    kept = customers(spark, sf_dir).where("contract <> 'Two year'")
    return presented(keyed.cascade(scores(spark, sf_dir), kept, "customer_id"))


def q_prefix_sum(spark, sf_dir):
    return presented(
        running_totals(
            customers(spark, sf_dir), "monthly_charges",
            {"customers": F.count(F.lit(1)), "billed": F.sum("monthly_charges")},
            rows_per_range=200,
        )
    )


def q_stratified_split(spark, sf_dir):
    """Sizes of fit, validation and test parts per label."""
    parts = training.split_frame(customers(spark, sf_dir), TABLE_ROLES)
    return parts.groupBy("part", "y").agg(F.count(F.lit(1)).alias("customers"))


def q_folds(spark, sf_dir):
    labelled = models.with_label(customers(spark, sf_dir), TABLE_ROLES)
    parts = split.assign_parts(labelled, "y", "customer_id", split.fold_quotas(5), name="fold")
    return parts.groupBy("fold", "y").agg(F.count(F.lit(1)).alias("customers"))


def q_one_hot(spark, sf_dir):
    long = design.design_matrix(cleaned(spark, sf_dir), TABLE_ROLES)
    return (
        long.where(~F.col("feature").isin(*TABLE_ROLES.numeric))
        .groupBy("feature")
        .agg(F.sum("value").cast("bigint").alias("customers"))
    )


def q_design_matrix(spark, sf_dir):
    return rounded(design.design_matrix(cleaned(spark, sf_dir), TABLE_ROLES), 9)


def q_dummies(spark, sf_dir):
    wide, names = survival.dummies(customers(spark, sf_dir), ["contract", "internet_service"])
    return wide.select(
        "customer_id", *[F.col(f"`{n}`").alias(n.lower().replace(" ", "_")) for n in names]
    )


def q_calibration_curve(spark, sf_dir):
    # Scores of four places: at most 10,001 values.
    return evaluate.calibration_curve(evaluation(spark, sf_dir), splits=())


def q_isotonic_steps(spark, sf_dir):
    """The calibrator's steps for the fixed scores, with ranges met in a tree."""
    return isotonic.isotonic_steps(evaluation(spark, sf_dir), rows_per_range=50)


def q_fn_change(spark, sf_dir):
    """Missed churners at 0.50 against those at 0.25, both from one aggregate."""
    counts = evaluate.confusion(evaluation(spark, sf_dir), {"base": 0.5, "tuned": 0.25})
    def fn(policy_name):
        return F.max(F.when(F.col("policy") == policy_name, F.col("fn")))

    return counts.agg(F.round(evaluate.miss_change(fn("base"), fn("tuned")), 6).alias("fn_reduction_pct"))


def q_evaluation_table(spark, sf_dir):
    """The fixed score, and the same score without its contract term's tail
    (the square root), as two models."""
    e = evaluation(spark, sf_dir)
    other = e.withColumn("p", F.round(F.sqrt("p"), 4))
    table = evaluate.evaluation_table({"plain": (e, 0.25), "root": (other, 0.6)}, splits=())
    return rounded(table, 6)


def q_score_columns(spark, sf_dir):
    return presented(scoring.score_columns(evaluation(spark, sf_dir), 0.5, SCORED_AT))


def q_survival(within=(), band=False):
    def run(spark, sf_dir):
        c = customers(spark, sf_dir).withColumn("event", label_flag("churn"))
        # Tenure is capped at 72 months, so its values are few.
        return rounded(survival.kaplan_meier(c, "tenure", "event", within, band=band, splits=()), 9)

    return run


def q_km_median(spark, sf_dir):
    c = customers(spark, sf_dir).withColumn("event", label_flag("churn"))
    return survival.median_survival(
        survival.kaplan_meier(c, within=["contract"], splits=()), ["contract"]
    )


def q_km_reorder(spark, sf_dir):
    gaps = src.reorder_gaps(src.read_table(spark, sf_dir, "orders"))
    return rounded(survival.kaplan_meier(gaps, "duration", "event", weight="n"), 9)


def q_cox(spark, sf_dir):
    c = customers(spark, sf_dir).withColumn("event", label_flag("churn"))
    wide, names = survival.dummies(c, ["contract", "internet_service"])
    return rounded(
        survival.hazard_ratios(wide, "tenure", "event", ["monthly_charges", *names]), 9
    )


COX_AT = (0.01, -0.5)


def _cox_given(spark, sf_dir) -> survival.HazardFit:
    """Monthly charge and a two-year contract, to be looked at in given coefficients."""
    c = customers(spark, sf_dir).withColumn("event", label_flag("churn"))
    wide = c.withColumn("two_year", (F.col("contract") == K.CONTRACTS[2]).cast("int"))
    # Ranges of months, so that running sums cross their borders.
    return survival.HazardFit(wide, "tenure", "event", ["monthly_charges", "two_year"], splits=(20.0, 50.0))


def q_cox_step(spark, sf_dir):
    """Likelihood, gradient, information and the residuals' spread at given coefficients."""
    fit = _cox_given(spark, sf_dir)
    at = np.array(COX_AT)
    value, gradient, info = fit.step(at)
    spread = fit.spread(at)
    fit.rows.unpersist()
    numbers = {
        "log_likelihood": value, "u0": gradient[0], "u1": gradient[1], "h00": info[0, 0], "h01": info[0, 1],
        "h11": info[1, 1], "v00": spread[0, 0], "v01": spread[0, 1], "v11": spread[1, 1],
    }
    return spark.createDataFrame([tuple(round(float(v), 4) for v in numbers.values())], [*numbers])


def q_cox_residuals(spark, sf_dir):
    rows = _cox_given(spark, sf_dir).residuals(np.array(COX_AT))
    return rows.select(
        "time", F.col("hit").cast("int").alias("event"), F.col("x0").alias("monthly_charges"), F.col("x1").alias("two_year"),
        F.col("w").alias("customers"), F.round("r0", 6).alias("r0"), F.round("r1", 6).alias("r1"),
    ).withColumns({"monthly_charges": F.round("monthly_charges", 2), "two_year": F.round("two_year").cast("int")})


def q_linear_attribution(spark, sf_dir):
    weights = {
        "tenure": (F.col("tenure"), -0.04),
        "monthly_charges": (F.col("monthly_charges"), 0.02),
        "contract_month_to_month": ((F.col("contract") == K.CONTRACTS[0]).cast("int"), 1.0),
        "contract_two_year": ((F.col("contract") == K.CONTRACTS[2]).cast("int"), -1.0),
    }
    return attribution.linear_attribution(customers(spark, sf_dir), weights)


# Scoring takes a model; these fixed coefficients let SQL state its result.
GIVEN = GivenLogistic(
    1.2, {"tenure": -0.04, "monthly_charges": 0.02},
    {"contract": {K.CONTRACTS[0]: 1.0, K.CONTRACTS[1]: 0.0, K.CONTRACTS[2]: -1.0}},
)


GIVEN_TREES = GivenTrees(
    {"tenure": "tenure", "monthly_charges": "monthly_charges",
     "month_to_month": f"contract = '{K.CONTRACTS[0]}'", "fiber": "internet_service = 'Fiber optic'"},
    (
        Split(0, 12, 0.4, Split(1, 70, 0.5, 0.3, 0.9), -0.4),
        Split(2, 0.5, 0.4, -0.5, Split(0, 24, 0.6, 0.8, Split(3, 0.5, 0.7, 0.1, 0.5))),
        Split(0, 30, 0.6, Split(0, 6, 0.2, 0.6, Split(1, 50, 0.3, 0.0, 0.2)), Split(1, 90, 0.8, -0.6, -0.1)),
    ),
)


# --- queries that fit a model ----------------------------------------------

def q_train_gbt(spark, sf_dir):
    frame = models.with_label(cleaned(spark, sf_dir), TABLE_ROLES).persist()
    try:
        model = models.fit_boosted(frame, TABLE_ROLES, K.BOOSTING_DEFAULT)
    finally:
        frame.unpersist()
    return model.raw_probability(frame).select("customer_id", "p")


def q_train_lr(spark, sf_dir):
    frame = models.with_label(cleaned(spark, sf_dir), TABLE_ROLES)
    return models.fit_logistic(frame, TABLE_ROLES).probability(frame).select("customer_id", "y", "p")


def q_calibrate(spark, sf_dir):
    frame = models.with_label(cleaned(spark, sf_dir), TABLE_ROLES)
    return models.fit_calibrated(frame, TABLE_ROLES, K.BOOSTING_DEFAULT).probability(frame).select("customer_id", "p")


def q_select_model(spark, sf_dir):
    parts = training.split_frame(cleaned(spark, sf_dir), TABLE_ROLES).persist()
    try:
        results = models.candidate_results(
            parts.where("part = 0"), parts.where("part = 1"), TABLE_ROLES, K.BOOSTING_CANDIDATES
        )
    finally:
        parts.unpersist()
    return evaluate.best_candidate(results)


def q_train_run(spark, sf_dir):
    run = training.train(cleaned(spark, sf_dir), TABLE_ROLES, K.BOOSTING_CANDIDATES)
    return run.evaluation


def q_score_batch(spark, sf_dir):
    return presented(scoring.score_active(cleaned(spark, sf_dir), GIVEN, SCORED_AT, 0.5))


def q_score_summary(spark, sf_dir):
    return reports.score_summary(scores(spark, sf_dir))


def q_tree_attribution(spark, sf_dir):
    return rounded(attribution.tree_attribution(cleaned(spark, sf_dir), GIVEN_TREES), 9)


def q_global_attribution(spark, sf_dir):
    return rounded(attribution.global_attribution(cleaned(spark, sf_dir), GIVEN_TREES), 6)


def q_top_features(spark, sf_dir):
    ranked = attribution.global_attribution(cleaned(spark, sf_dir), GIVEN_TREES)
    return rounded(attribution.top_features(ranked, 3), 6)


def q_score_stream(spark, sf_dir):
    """Dated raw records as files, read as a stream, scored and merged.

    Each customer's record comes three times, shuffled over the files: as it was a
    month earlier, and twice as it is. A second stream then replays all files.
    """
    root = scratch_path(spark, "stream")
    now = raw_records(spark, sf_dir).withColumn("recorded_at", F.lit(SCORED_AT).cast("timestamp_ntz"))
    earlier = now.withColumns({
        "tenure": F.col("tenure") + 7, "recorded_at": F.col("recorded_at") - F.expr("INTERVAL 1 MONTH"),
    })
    arriving = now.unionByName(now).unionByName(earlier)
    arriving.repartition(4, F.xxhash64("customerID", "recorded_at", F.rand(7))).write.option("header", True).csv(f"{root}/in")
    table = score_table(spark, f"{root}/tables", QUERY_BUCKETS)
    for run in ("first", "replay"):
        records = live.arriving_records(spark, f"{root}/in", files_per_batch=2, dated=True)
        live.start_scoring(
            records, GIVEN, table, SCORED_AT, f"{root}/checkpoint-{run}", available_now=True
        ).awaitTermination()
    return presented(table.read())


def _on(source, operator, finish=None) -> Query:
    def run(spark, sf_dir):
        out = operator(source(spark, sf_dir))
        return finish(out) if finish else out

    return run


def _on_both(operator) -> Query:
    return lambda spark, sf_dir: operator(customers(spark, sf_dir), scores(spark, sf_dir))


QUERIES: dict[str, Query] = {
    "v3_contract": lambda s, d: semantic_views(customers(s, d), scores(s, d))["v_churn_contract_summary"],
    "v1_customer": _on(view, presented),
    "v2_kpis": _on(view, semantic.kpis),
    "q01_overall": _on(customers, segments.overall),
    "q02_contract": _on(customers, segments.by_contract),
    "q03_risk_revenue": _on(scores, segments.revenue_by_risk),
    "q04_internet_support": _on(customers, segments.by_internet_and_support),
    "q05_churned_vs_retained": _on(customers, segments.churned_vs_retained),
    "q06_missing_services": _on(customers, segments.missing_services),
    "q07_tenure_cohort": _on(customers, segments.by_tenure_cohort),
    "q08_payment_paperless": _on(customers, segments.by_payment_and_paperless),
    "q09_intervention_queue": _on(scores, segments.intervention_queue),
    "q10_senior": _on(customers, segments.by_senior),
    "q11_bundle_depth": _on(customers, segments.by_bundle_depth),
    "q12_high_bill": _on(customers, segments.high_bill_by_contract),
    "q13_fiber": _on(customers, segments.fiber_by_protection),
    "q14_clv_loss": _on(customers, segments.value_lost_by_payment),
    "q15_high_value": _on(scores, segments.high_value_at_risk),
    "load_clean": q_load_clean,
    "label_features": q_label_features,
    "features": q_features,
    "clv": q_clv,
    "contact_tier": q_contact_tier,
    "preview": _on(customers, lambda d: presented(files.preview(d, "customer_id", 50))),
    "upsert_customers": q_upsert_customers,
    "upsert_scores": q_upsert_scores,
    "delete_customers": q_delete_customers,
    "rollup_kpis": lambda s, d: _rolled_up(s, d)["v_churn_bi_kpis"],
    "rollup_contract": lambda s, d: _rolled_up(s, d)["v_churn_contract_summary"],
    "sketch_profile": q_sketch_profile,
    "v1_bucketed": q_v1_bucketed,
    "constraint_report": q_constraint_report,
    "cascade_scores": q_cascade,
    "wb_contract": _on_both(reports.contract_workbook),
    "wb_risk": _on(scores, reports.risk_workbook),
    "kpi_cards": _on_both(reports.kpi_cards),
    "score_summary": q_score_summary,
    "charge_histogram": _on(customers, profile.charge_histogram),
    "rate_by_contract": _on(customers, lambda d: profile.rate_by(d, "contract")),
    "rate_by_month": _on(customers, lambda d: profile.rate_by(d, "tenure")),
    "profile": _on(customers, profile.profile),
    "most_missing": _on(customers, profile.most_missing),
    "measures": _on(view, semantic.measures),
    "v1_risk_breakdown": _on(view, semantic.risk_breakdown),
    "v1_tenure_band": _on(view, semantic.by_tenure_band),
    "v1_queue": _on(view, semantic.flagged_queue),
    "support_heatmap": _on(view, semantic.support_heatmap),
    "charge_quartiles": _on(customers, semantic.charge_quartiles),
    "slicer_rollup": _on(view, semantic.slicer_rollup),
    "prefix_sum": q_prefix_sum,
    "stratified_split": q_stratified_split,
    "stratified_folds": q_folds,
    "dummies": q_dummies,
    "one_hot": q_one_hot,
    "design_matrix": q_design_matrix,
    "preprocess": _on(cleaned, lambda d: rounded(design.scaled_numerics(d, TABLE_ROLES), 6)),
    "confusion": _on(evaluation, lambda d: rounded(evaluate.confusion(d, [0.0, 0.07, 0.3, 0.5, 0.6, 0.9, 1.0]))),
    "roc_auc": _on(evaluation, lambda d: rounded(evaluate.roc_auc(d), 9)),
    "avg_precision": _on(evaluation, lambda d: rounded(evaluate.average_precision(d), 9)),
    "brier": _on(evaluation, lambda d: rounded(evaluate.brier(d), 9)),
    "calibration_curve": q_calibration_curve,
    "isotonic_steps": q_isotonic_steps,
    "financial_outcome": _on(evaluation, lambda d: rounded(policy.financial_outcome(d, 0.5), 4)),
    "threshold_curve": _on(evaluation, lambda d: rounded(policy.threshold_curve(d), 4)),
    "threshold_best": _on(evaluation, lambda d: rounded(policy.best_threshold(d), 4)),
    "policy_value": _on(evaluation, lambda d: rounded(policy.policy_value(d, 0.25), 4)),
    "fn_change": q_fn_change,
    "evaluation_table": q_evaluation_table,
    "score_columns": q_score_columns,
    "km_overall": q_survival(),
    "km_contract": q_survival(["contract"]),
    "km_band": q_survival(band=True),
    "km_median": q_km_median,
    "km_reorder": q_km_reorder,
    "linear_attribution": q_linear_attribution,
    "cox_step": q_cox_step,
    "cox_residuals": q_cox_residuals,
    "cox_ratios": q_cox,
    "train_gbt": q_train_gbt,
    "train_lr": q_train_lr,
    "calibrate": q_calibrate,
    "select_model": q_select_model,
    "train_run": q_train_run,
    "score_batch": q_score_batch,
    "tree_attribution": q_tree_attribution,
    "global_attribution": q_global_attribution,
    "top_features": q_top_features,
    "score_stream": q_score_stream,
}
