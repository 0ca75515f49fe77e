"""Readers and writers for raw files, score exports and run records."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from holdfast.functions.cleaning import clean
from holdfast.schema import RAW, RAW_ROLES


def read_raw(spark: SparkSession, path: str) -> DataFrame:
    """The raw file, a folder or a glob of them, untouched.

    The schema is declared, so nothing is scanned to infer it. A missing path
    raises when the plan is built.
    """
    return (
        spark.read.schema(RAW)
        .option("header", True)
        .option("enforceSchema", False)
        .option("ignoreLeadingWhiteSpace", False)
        .option("ignoreTrailingWhiteSpace", False)
        .csv(path)
    )


_UNREAD = "_unread"


def read_checked(spark: SparkSession, path: str, key: str = RAW_ROLES.key) -> tuple[DataFrame, DataFrame]:
    """The raw file's sound records, and the others with their file, reason and text.

    A line with too few or too many cells, or with a cell that is no value of its
    column, is malformed; a record without a key names nobody. Both frames are plans
    over the same scan. Lines are split whole and cells are judged by expressions, so
    what a query selects does not change which lines are sound.
    """
    texts = T.StructType([*[T.StructField(n, T.StringType()) for n in (*RAW.fieldNames(), _UNREAD)]])
    rows = (
        spark.read.schema(texts)
        .option("header", True)
        .option("enforceSchema", False)
        .option("ignoreLeadingWhiteSpace", False)
        .option("ignoreTrailingWhiteSpace", False)
        .option("mode", "PERMISSIVE")
        .option("columnNameOfCorruptRecord", _UNREAD)
        .option("columnPruning", False)
        .csv(path)
    )
    malformed = F.col(_UNREAD).isNotNull()
    for field in RAW.fields:
        malformed |= F.col(field.name).isNotNull() & F.col(field.name).try_cast(field.dataType).isNull()
    unnamed = F.col(key).isNull() | (F.trim(key) == "")
    sound = rows.where(~malformed & ~unnamed).select(
        *[F.col(f.name).try_cast(f.dataType).alias(f.name) for f in RAW.fields]
    )
    text = F.coalesce(F.col(_UNREAD), F.to_csv(F.struct(*RAW.fieldNames())))
    others = rows.where(malformed | unnamed).select(
        F.col("_metadata.file_path").alias("source_file"),
        F.when(malformed, "malformed").otherwise("no key").alias("reason"), text.alias("record"),
    )
    return sound, others


def read_clean(spark: SparkSession, path: str) -> DataFrame:
    """The sound records of the raw file, cleaned."""
    return clean(read_checked(spark, path)[0], RAW_ROLES)


def preview(df: DataFrame, key: str, rows: int = 50) -> DataFrame:
    """The first rows in key order (a top-k, not a full sort)."""
    return df.orderBy(key).limit(rows)


def conform(df: DataFrame, schema: T.StructType) -> DataFrame:
    """The frame under a newer schema; columns it lacks become NULL."""
    have = set(df.columns)
    return df.select(
        *[
            (F.col(f.name) if f.name in have else F.lit(None)).cast(f.dataType).alias(f.name)
            for f in schema.fields
        ]
    )


def export_scores(scores: DataFrame, path: str, fmt: str = "csv",
                  by_level: bool = False) -> None:
    """Write the score export. One folder of part files; failures raise."""
    writer = scores.write.mode("overwrite")
    if by_level:
        writer = writer.partitionBy("risk_level")
    if fmt == "csv":
        writer = writer.option("header", True)
    writer.format(fmt).save(path)


def write_record(df: DataFrame, path: str, run_id: str) -> None:
    """One run's small result (metrics, threshold, attribution), in place of an
    earlier one of the same id. Other runs' results stay."""
    df.withColumn("run_id", F.lit(run_id)).write.mode("overwrite").option(
        "partitionOverwriteMode", "dynamic"
    ).partitionBy("run_id").parquet(path)


def read_record(spark: SparkSession, path: str, run_id: str) -> DataFrame:
    return spark.read.parquet(path).where(F.col("run_id") == run_id).drop("run_id")


def save_bucketed(df: DataFrame, table: str, key: str, buckets: int,
                  partition_by: str | None = None) -> None:
    """A catalog table bucketed and sorted on its key.

    Two tables bucketed alike join on the key without a shuffle.
    """
    writer = df.write.mode("overwrite").format("parquet").bucketBy(buckets, key).sortBy(key)
    if partition_by:
        writer = writer.partitionBy(partition_by)
    writer.saveAsTable(table)


def publish_views(views: dict[str, DataFrame]) -> None:
    """Register the semantic views under their names."""
    for name, df in views.items():
        df.createOrReplaceTempView(name)


def write_jdbc(df: DataFrame, url: str, table: str, **options: str) -> None:
    """Replace a database table's rows, keeping its definition and grants."""
    (
        df.write.format("jdbc")
        .options(url=url, dbtable=table, truncate="true", batchsize="10000", **options)
        .mode("overwrite")
        .save()
    )
