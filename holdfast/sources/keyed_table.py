"""Tables by key on plain Parquet, in folders by key-hash bucket.

A batch is staged once, merged with the rows of the buckets it names, and written by
Spark's dynamic partition overwrite: its committer swaps those buckets' folders when
all tasks are done, and no other folder is opened or touched. The cost of a batch is
the buckets it names, not the table.

A deleted key leaves a row that says so. It hides the key from readers, and, where
the table has an order column, keeps older rows of that key from coming back.

One writer at a time, as for any plain Parquet folder. The number of buckets belongs
to the table: always open it with the same one, such that a bucket is a file or two.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from holdfast.operators.keyed import KeyConflict, latest_per_key, merge_rows
from holdfast.session import scratch_path
from holdfast.sources.files import conform

BUCKETS = 64
_BUCKET, _GONE = "bucket", "deleted"


class KeyedTable:
    def __init__(self, spark: SparkSession, root: str, schema: T.StructType, key: str,
                 order: str | None = None, buckets: int = BUCKETS):
        self.spark, self.root, self.schema = spark, root.rstrip("/"), schema
        self.key, self.order, self.buckets = key, order, buckets
        self._stored = T.StructType([*schema.fields, T.StructField(_GONE, T.BooleanType())])

    def bucket(self) -> Column:
        """The bucket of a row's key."""
        return F.pmod(F.xxhash64(F.col(self.key)), F.lit(self.buckets)).cast("int").alias(_BUCKET)

    def _rows(self) -> DataFrame:
        """All stored rows with their bucket, a filter on which opens only those folders."""
        whole = T.StructType([*self._stored.fields, T.StructField(_BUCKET, T.IntegerType())])
        try:
            return self.spark.read.schema(whole).parquet(self.root)
        except AnalysisException as error:
            if error.getCondition() != "PATH_NOT_FOUND":
                raise
            return self.spark.createDataFrame([], whole)

    def read(self, buckets: Sequence[int] | None = None) -> DataFrame:
        """The rows of all keys that are not deleted; of some buckets, only their
        folders are opened."""
        rows = self._rows().where(~F.col(_GONE))
        if buckets is not None:
            rows = rows.where(F.col(_BUCKET).isin(list(buckets)))
        return rows.select(*self.schema.fieldNames())

    def buckets_of(self, keys: DataFrame) -> list[int]:
        """The buckets that hold the given keys; at most as many numbers as the table has."""
        named = keys.where(F.col(self.key).isNotNull()).select(self.bucket()).distinct()
        return sorted(r[_BUCKET] for r in named.collect())

    def _newest(self, rows: DataFrame) -> DataFrame:
        """One row for each key: the newest; of equally new ones a deletion, then the greatest."""
        return latest_per_key(rows.select(self.key, self.order, _GONE, *[
            c for c in rows.columns if c not in (self.key, self.order, _GONE)
        ]), self.key, self.order).select(*rows.columns)

    def _write(self, batch: DataFrame, newest: bool) -> None:
        """Merge a staged batch of stored rows into the buckets that it names."""
        # At most as many numbers as the table has buckets.
        named = [r[_BUCKET] for r in batch.select(_BUCKET).distinct().collect()]
        if not named:
            return
        current = self._rows().where(F.col(_BUCKET).isin(named))
        if newest:
            merged = self._newest(current.unionByName(batch))
        else:
            merged = merge_rows(current, batch, self.key)
        (
            merged.repartition(len(named), _BUCKET).write.mode("overwrite")
            .option("partitionOverwriteMode", "dynamic").partitionBy(_BUCKET).parquet(self.root)
        )

    def _staged(self, rows: DataFrame) -> DataFrame:
        """A batch in the shared folder: computed once, whatever reads it."""
        path = scratch_path(self.spark, "batch")
        rows.select(*self._stored.fieldNames(), self.bucket()).write.parquet(path)
        return self.spark.read.parquet(path)

    def upsert(self, rows: DataFrame, on_duplicate: str = "error") -> int:
        """Insert new keys, overwrite known ones; returns the incoming row count.

        ``on_duplicate='error'`` refuses a batch that holds a key twice, and the batch
        wins over the table. ``'latest'`` keeps the row with the greatest order column
        of batch and table, so that late, repeated and replayed rows change nothing.
        A NULL key is refused.
        """
        batch = self._staged(conform(rows, self.schema).withColumn(_GONE, F.lit(False)))
        count, most, unnamed = batch.groupBy(self.key).agg(F.count(F.lit(1)).alias("n")).agg(
            F.coalesce(F.sum("n"), F.lit(0)), F.coalesce(F.max("n"), F.lit(0)),
            F.count_if(F.col(self.key).isNull()),
        ).first()
        if unnamed:
            raise KeyConflict(f"a row has no key ({self.key})")
        if on_duplicate == "latest":
            self._write(batch, newest=True)
        elif most > 1:
            raise KeyConflict(f"a key occurs more than once in one batch ({self.key})")
        else:
            self._write(batch, newest=False)
        return count

    def delete(self, keys: DataFrame, at: str | None = None) -> None:
        """Remove keys, those not there included. ``at``: a table with an order column
        needs to know when; rows that are newer stay or may come back."""
        rows = keys.select(self.key).where(F.col(self.key).isNotNull()).distinct()
        if self.order:
            if at is None:
                raise ValueError(f"a deletion needs a value of {self.order}")
            rows = rows.withColumn(self.order, F.lit(at))
        gone = conform(rows, self.schema).withColumn(_GONE, F.lit(True))
        self._write(self._staged(gone), newest=self.order is not None)
