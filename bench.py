"""Headline queries, timed: median of three runs after a warm-up.

BENCH_SF_DIR names the tables, BENCH_CPUS the cores. Results go to the no-op
sink, so every row is computed and none is collected. Prints one JSON line.
"""

from __future__ import annotations

import json
import os
import statistics
import time

from holdfast.plans.catalog import QUERIES
from holdfast.session import local_session

HEADLINE = (
    "v1_customer", "v2_kpis", "v3_contract",
    "q01_overall", "q02_contract", "q03_risk_revenue", "q04_internet_support",
    "q05_churned_vs_retained", "q06_missing_services", "q07_tenure_cohort",
    "q08_payment_paperless", "q09_intervention_queue", "q10_senior", "q11_bundle_depth",
    "q12_high_bill", "q13_fiber", "q14_clv_loss", "q15_high_value",
    "load_clean", "features", "upsert_customers", "upsert_scores", "slicer_rollup",
    "profile", "charge_quartiles", "prefix_sum", "stratified_split", "design_matrix",
    "roc_auc", "avg_precision", "evaluation_table", "threshold_curve", "threshold_best",
    "km_contract", "km_reorder", "score_batch", "global_attribution",
)
RUNS = 3


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cores = os.environ.get("BENCH_CPUS", "4")
    spark = local_session(cores, shuffle_partitions=int(cores), app="bench")

    def timed(name: str) -> float:
        start = time.perf_counter()
        QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        return time.perf_counter() - start

    seconds = {}
    for name in HEADLINE:
        timed(name)
        seconds[name] = round(statistics.median(timed(name) for _ in range(RUNS)), 3)
    print(json.dumps({
        "metric": "total seconds, headline queries, median of three",
        "value": round(sum(seconds.values()), 3), "unit": "sec",
        "queries": seconds, "sf": os.path.basename(sf_dir.rstrip("/")),
    }))
    spark.stop()


if __name__ == "__main__":
    main()
