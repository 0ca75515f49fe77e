"""Jobs for spark-submit: load, train, score, stream, delete, rollup, publish, survival, workbook.

    spark-submit --py-files holdfast.zip -m holdfast load --raw DIR --root DIR

The session comes from spark-submit. Times are arguments, so that a repeated
job writes the same rows.
"""

from __future__ import annotations

import argparse
from collections.abc import Sequence

from pyspark.sql import SparkSession

from holdfast.operators.models import Classifier
from holdfast.plans import lifetimes, loading, rollups, scoring, training
from holdfast.plans.training import BOOSTED
from holdfast.functions.cleaning import clean
from holdfast.schema import TABLE_ROLES
from holdfast.sources.keyed_table import BUCKETS
from holdfast.streaming import live


def _arguments() -> argparse.ArgumentParser:
    parser = argparse.ArgumentParser(prog="holdfast", description=__doc__.splitlines()[0])
    jobs = parser.add_subparsers(dest="job", required=True)

    def job(name: str, *options: str, **defaults: str) -> argparse.ArgumentParser:
        sub = jobs.add_parser(name)
        sub.add_argument("--root", required=True, help="folder of the tables")
        sub.add_argument("--buckets", type=int, default=BUCKETS, help="of the tables, the same for all jobs")
        for option in (*options, *defaults):
            sub.add_argument(f"--{option}", required=option not in defaults, default=defaults.get(option))
        return sub

    job("load", "raw", run="latest")
    job("train", "models", "run")
    job("score", "models", "run", "at", "export")
    job("stream", "models", "run", "at", "records", "checkpoint")
    job("delete", "keys", "at")
    job("rollup", keys="")
    job("publish", "database", tables="200")
    job("survival", "out")
    job("workbook", "out")
    return parser


def main(argv: Sequence[str] | None = None, spark: SparkSession | None = None) -> None:
    args = _arguments().parse_args(argv)
    spark = spark or SparkSession.builder.appName(f"holdfast {args.job}").getOrCreate()

    def customers():
        return loading.customer_table(spark, args.root, args.buckets).read()

    def score_table():
        return loading.score_table(spark, args.root, args.buckets)

    def cleaned():
        return clean(customers(), TABLE_ROLES, "senior_citizen")

    def saved_model():
        path = f"{args.models}/models/{args.run}/{BOOSTED}"
        threshold = training.saved_threshold(spark, args.models, args.run)
        return Classifier.load(spark, path, TABLE_ROLES), threshold

    def keys():
        return spark.read.option("header", True).csv(args.keys).select("customer_id")

    if args.job == "load":
        rows = loading.load_customers(spark, args.raw, args.root, args.buckets, args.run)
        aside = loading.quarantined(spark, args.root, args.run).count()
        print(f"loaded or updated {rows:,} customer rows, set {aside:,} aside")
    elif args.job == "train":
        training.train(cleaned(), TABLE_ROLES).save(args.models, args.run)
    elif args.job == "score":
        model, threshold = saved_model()
        rows = scoring.score_active(cleaned(), model, args.at, threshold)
        scoring.publish_scores(rows, args.export, score_table()).show()
    elif args.job == "stream":
        model, threshold = saved_model()
        live.start_scoring(
            live.arriving_records(spark, args.records), model,
            score_table(), args.at, args.checkpoint, threshold,
        ).awaitTermination()
    elif args.job == "delete":
        loading.delete_customers(spark, args.root, keys(), args.at, args.buckets)
    elif args.job == "rollup":
        named = rollups.refresh(spark, args.root, keys() if args.keys else None, args.buckets)
        print(f"brought {len(named):,} of {args.buckets:,} buckets up to date")
    elif args.job == "publish":
        loading.publish_tables(spark, customers(), score_table().read(), args.database, int(args.tables))
    elif args.job == "survival":
        for name, table in lifetimes.survival_analysis(customers()).items():
            table.write.mode("overwrite").parquet(f"{args.out}/{name}")
    elif args.job == "workbook":
        loading.write_workbook(customers(), score_table().read(), args.out)


if __name__ == "__main__":
    main()
