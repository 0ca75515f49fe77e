"""Stratified parts of exact size, decided by a hash of the key.

The parts are cut out of the hash order of each class. Two scans of key and
label find the cut keys (counts per hash bucket, which also say in which bucket
a cut falls; then the cut row in that bucket). Assigning rows is then a comparison with a few literals: no
shuffle, the same answer on every run and after any lost executor.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from math import ceil

from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame, Window, functions as F

from holdfast import constants as K

BUCKET_BITS = 16

Quotas = Callable[[list[int]], list[list[int]]]


def holdout_quotas(fraction: float) -> Quotas:
    """Sizes (kept, held out) per class; the held-out total is rounded up.

    The kept total is shared in proportion, remainders going to the classes
    with the largest fractional parts.
    """

    def quotas(counts: list[int]) -> list[list[int]]:
        n = sum(counts)
        keep = n - ceil(round(n * fraction, 9))
        exact = [c * keep / n if n else 0.0 for c in counts]
        kept = [int(e) for e in exact]
        by_remainder = sorted(range(len(counts)), key=lambda i: (kept[i] - exact[i], i))
        for i in by_remainder[: keep - sum(kept)]:
            kept[i] += 1
        return [[k, c - k] for k, c in zip(kept, counts)]

    return quotas


def fold_quotas(folds: int) -> Quotas:
    """Fold sizes per class when the class-sorted rows are dealt out in turn."""

    def quotas(counts: list[int]) -> list[list[int]]:
        out, start = [], 0
        for c in counts:
            end = start + c
            out.append([(end - i + folds - 1) // folds - (start - i + folds - 1) // folds
                        for i in range(folds)])
            start = end
        return out

    return quotas


@dataclass(frozen=True)
class Cuts:
    """Per class, the last (hash, key) of each part but the last; None for an
    empty start."""

    label: str
    key: str
    seed: int
    by_class: dict

    def part(self) -> Column:
        """The part number of a row."""
        h = _hash(self.key, self.seed)
        chain = None
        for value, cuts in self.by_class.items():
            number = F.lit(0)
            for cut in cuts:
                if cut is None:
                    number = number + 1
                else:
                    after = (h > cut[0]) | ((h == cut[0]) & (F.col(self.key) > cut[1]))
                    number = number + F.when(after, 1).otherwise(0)
            test = F.col(self.label) == value
            chain = F.when(test, number) if chain is None else chain.when(test, number)
        return chain if chain is not None else F.lit(0)


def _hash(key: str, seed: int) -> Column:
    return F.xxhash64(F.col(key), F.lit(seed))


def find_cuts(df: DataFrame, label: str, key: str, quotas: Quotas, seed: int = K.SEED) -> Cuts:
    """Cut points for parts of exact size per class. The key must be unique."""
    h = _hash(key, seed)
    # Signed shift keeps the hash order, so buckets are ranges of it.
    rows = df.select(
        F.col(label).alias("c"), F.col(key).alias("k"), h.alias("h"),
        F.shiftright(h, 64 - BUCKET_BITS).alias("b"),
    )
    buckets = rows.groupBy("c", "b").agg(F.count(F.lit(1)).alias("n"))
    # At most 2^BUCKET_BITS rows per class; kept so that one scan fills it.
    buckets = buckets.persist(StorageLevel.MEMORY_AND_DISK)
    try:
        totals = sorted(map(tuple, buckets.groupBy("c").agg(F.sum("n")).collect()))
        # (class, number of the last row of a part) for each part but the last
        wanted = []
        for (value, _), sizes in zip(totals, quotas([n for _, n in totals])):
            upto = 0
            for size in sizes[:-1]:
                upto += size
                wanted.append((value, upto))
        inner = [w for w in wanted if w[1] > 0]
        found = _cut_rows(rows, buckets, inner) if inner else {}
    finally:
        buckets.unpersist()
    by_class = {value: [] for value, _ in totals}
    for cut in wanted:
        by_class[cut[0]].append(found.get(cut))
    return Cuts(label, key, seed, by_class)


def _cut_rows(rows: DataFrame, buckets: DataFrame, wanted: list[tuple]) -> dict:
    """The (hash, key) standing at each wanted place of its class's hash order."""
    upto = Window.partitionBy("c").orderBy("b").rowsBetween(Window.unboundedPreceding, 0)
    ends = buckets.withColumn("hi", F.sum("n").over(upto)).withColumn("lo", F.col("hi") - F.col("n"))
    holds = F.lit(False)
    for value, place in wanted:
        holds = holds | ((F.col("c") == value) & (F.col("lo") < place) & (F.col("hi") >= place))
    contested = ends.where(holds).select("c", "b", "lo").collect()

    before = F.lit(None).cast("bigint")
    for r in contested:
        before = F.when((F.col("c") == r["c"]) & (F.col("b") == r["b"]), r["lo"]).otherwise(before)
    # A contested bucket is about one 65,536th of a class.
    near = rows.withColumn("lo", before).where(F.col("lo").isNotNull())
    rank = F.row_number().over(Window.partitionBy("c", "b").orderBy("h", "k"))
    last = F.lit(False)
    for value, place in wanted:
        last = last | ((F.col("c") == value) & (F.col("place") == place))
    cut = near.withColumn("place", rank + F.col("lo")).where(last).collect()
    return {(r["c"], r["place"]): (r["h"], r["k"]) for r in cut}


def assign_parts(df: DataFrame, label: str, key: str, quotas: Quotas, seed: int = K.SEED,
                 name: str = "part") -> DataFrame:
    return df.withColumn(name, find_cuts(df, label, key, quotas, seed).part())
