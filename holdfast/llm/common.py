"""What the operators of this package share: staged tables, column names, packed integers."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from holdfast.session import scratch_path


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def staged(df: DataFrame, purpose: str, by: str | None = None) -> DataFrame:
    """Write to the shared folder and read back: a frame that is used twice is
    computed once, and its lineage ends at files a lost executor can't take away.
    ``by``: a column with few values that gets a folder for each."""
    path = scratch_path(df.sparkSession, purpose)
    (df.write.partitionBy(by) if by else df.write).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def sized(df: DataFrame, purpose: str, most: int, size: Column | None = None) -> DataFrame:
    """A staged frame, sent to every task if it has at most ``most`` rows or, where
    ``size`` gives the bytes of a row, that many bytes; to none if it has more."""
    held = staged(df, purpose)
    total, = held.agg(F.coalesce(F.sum(F.lit(1) if size is None else size), F.lit(0))).first()
    return F.broadcast(held) if total <= most else unsent(held)


def unsent(df: DataFrame) -> DataFrame:
    """A side of a join that is never sent to every task. Left to itself, Spark sends
    what it takes for small: it counts no rows that an explode adds, and takes the
    size of packed files for that of their rows."""
    return df.hint("merge")


def without(df: DataFrame, names: Sequence[str]) -> list[str]:
    """The columns of a frame, less those an operator is about to write."""
    gone = {n.lower() for n in names}
    return [c for c in df.columns if c.lower() not in gone]


def quoted(name: str):
    """A column whose name may hold dots or blanks."""
    return F.col("`" + name.replace("`", "``") + "`")


def slices(batches: Iterator[pa.RecordBatch], column: str, most_bytes: int) -> Iterator[pa.RecordBatch]:
    """Cut batches so that each holds about ``most_bytes`` of one text or binary
    column (a longer row stands alone); no row is lost or cut."""
    for batch in batches:
        if not batch.num_rows:
            continue
        values = batch.column(batch.schema.get_field_index(column))
        sizes = values.fill_null("" if pa.types.is_string(values.type) else b"")
        sizes = pa.compute.binary_length(sizes).to_numpy(zero_copy_only=False)
        start, held = 0, 0
        for row, size in enumerate(sizes):
            if held and held + size > most_bytes:
                yield batch.slice(start, row - start)
                start, held = row, 0
            held += size
        yield batch.slice(start)


def pack(numbers: np.ndarray) -> bytes:
    """Whole numbers below 2**32, one compressed plane for each byte."""
    planes = np.ascontiguousarray(numbers, dtype="<u4").view(np.uint8).reshape(-1, 4).T
    return zstandard.ZstdCompressor(level=1).compress(np.ascontiguousarray(planes).tobytes())


def unpack(data: bytes) -> np.ndarray:
    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(data), np.uint8).reshape(4, -1)
    return np.ascontiguousarray(planes.T).view("<u4").reshape(-1)


def framed(parts: Sequence[bytes]) -> bytes:
    """Several byte strings as one."""
    return b"".join(len(p).to_bytes(8, "little") + p for p in parts)


def unframed(data: bytes) -> list[bytes]:
    out, at = [], 0
    while at < len(data):
        size = int.from_bytes(data[at:at + 8], "little")
        out.append(data[at + 8:at + 8 + size])
        at += 8 + size
    return out


def whole_groups(batches: Iterator[pa.RecordBatch], keys: Sequence[str]) -> Iterator[pa.Table]:
    """Tables that hold one group each, of batches sorted by the group's columns.

    One group is held at a time; the caller sees to it that groups are bounded.
    """
    held: list[pa.RecordBatch] = []
    current = None
    for batch in batches:
        if not batch.num_rows:
            continue
        columns = [batch.column(batch.schema.get_field_index(k)).to_numpy(zero_copy_only=False) for k in keys]
        changed = np.zeros(batch.num_rows - 1, bool)
        for c in columns:
            changed |= c[1:] != c[:-1]
        cuts = [0, *(np.flatnonzero(changed) + 1).tolist(), batch.num_rows]
        for start, end in zip(cuts, cuts[1:]):
            name = tuple(c[start] for c in columns)
            if held and name != current:
                yield pa.Table.from_batches(held)
                held = []
            current = name
            held.append(batch.slice(start, end - start))
    if held:
        yield pa.Table.from_batches(held)


def matrix(lists: pa.ChunkedArray | pa.Array, width: int, kind=np.float64) -> np.ndarray:
    """Lists of one length as rows of a matrix."""
    if isinstance(lists, pa.ChunkedArray):
        parts = [c.flatten().to_numpy(zero_copy_only=False) for c in lists.chunks]
        flat = np.concatenate(parts) if parts else np.zeros(0)
    else:
        flat = lists.flatten().to_numpy(zero_copy_only=False)
    return np.asarray(flat, kind).reshape(-1, width)


def finite_vectors(df: DataFrame, key: str, vector: str) -> DataFrame:
    """(id, x): vectors of doubles, one for each id.

    A NULL id, and a vector that is NULL or holds NULL, NaN or an infinity, takes
    no part. Repeated rows count once; of different vectors under one id the
    smallest counts, in array order.
    """
    bad = F.exists("x", lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf")))
    return (
        df.select(quoted(key).cast("bigint").alias("id"), quoted(vector).cast("array<double>").alias("x"))
        .where("id is not null and x is not null").where(~bad)
        .groupBy("id").agg(F.min("x").alias("x"))
    )


def padded(width: int):
    """The vector ``x`` with zeros up to a width."""
    return F.concat("x", F.array_repeat(F.lit(0.0), F.lit(width) - F.size("x")))
