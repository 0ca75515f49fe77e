"""Scoring customer records as they arrive."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T
from pyspark.sql.streaming import StreamingQuery

from holdfast import constants as K
from holdfast.functions.cleaning import clean
from holdfast.functions.risk import contact_tier
from holdfast.operators.models import Classifier
from holdfast.plans.scoring import score_columns
from holdfast.schema import RAW, RAW_ROLES, RECORDED
from holdfast.sources.keyed_table import KeyedTable
from holdfast.streaming.newest import newest_per_key


def arriving_records(spark: SparkSession, path: str, fmt: str = "csv",
                     files_per_batch: int = 64, dated: bool = False) -> DataFrame:
    """A stream over a folder of raw files with the declared schema.

    ``dated`` records end with the time they were taken, ``recorded_at``.
    """
    schema = T.StructType([*RAW.fields, RECORDED]) if dated else RAW
    reader = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch)
    if fmt == "csv":
        # Columns go by the header's names, as in the batch reader.
        reader = (
            reader.option("header", True).option("enforceSchema", False)
            .option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False)
        )
    return reader.format(fmt).load(path)


def predict(records: DataFrame, model: Classifier, scored_at: str | Column,
            threshold: float = K.DEFAULT_THRESHOLD) -> DataFrame:
    """Score-table rows and the contact tier, for a batch or a stream.

    Every step works row by row, so no state and no watermark is needed.
    """
    cleaned = clean(records, RAW_ROLES)
    if model.roles.key not in cleaned.columns:
        cleaned = cleaned.withColumnsRenamed(K.RAW_TO_TABLE)
    scored = model.probability(cleaned)
    return score_columns(
        scored, threshold, scored_at, model.roles, extra={"tier": contact_tier("p", threshold)}
    )


def start_scoring(records: DataFrame, model: Classifier, table: KeyedTable, scored_at: str,
                  checkpoint: str, threshold: float = K.DEFAULT_THRESHOLD,
                  available_now: bool = False) -> StreamingQuery:
    """Score records as they arrive and merge what is new into the table.

    A dated record's score carries the time of the record, others ``scored_at``.
    Keyed state drops records that are not newer than what their customer had
    before, so a micro-batch names only the buckets of real changes. The merge keeps
    the newer row as well, so that a replayed batch and a second stream that starts
    from nothing change nothing.
    """
    dated = RECORDED.name in records.columns
    at = F.col(RECORDED.name) if dated else scored_at
    scored = predict(records, model, at, threshold)
    changes = newest_per_key(scored, table.key, table.order)

    def publish(batch: DataFrame, batch_id: int) -> None:
        table.upsert(batch, on_duplicate="latest")

    writer = changes.writeStream.foreachBatch(publish).option("checkpointLocation", checkpoint)
    if available_now:
        writer = writer.trigger(availableNow=True)
    return writer.start()
