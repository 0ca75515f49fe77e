"""SimHash near-duplicates by multi-index hashing.

Fingerprints take one narrow pass over whole texts. Equal fingerprints collapse
first, so a group of exact copies is one row afterwards, however many there are.
Each distinct fingerprint is filed once under the value of every segment; it
asks for every value in the small Hamming ball around its own segments. If two
fingerprints differ in at most ``distance`` bits, at least one of ``segments``
parts differs in at most ``distance // segments`` bits, so no link is missed.
Whole distances are verified inside the join, so only links leave it; a busy
segment value is an ordinary skewed join key, which adaptive execution splits.
Both sides of every join grow with the corpus, so none is ever broadcast.

Components come from rounds of large-star and small-star steps over the links
(never over pairs of copies), each round staged in the shared folder.

Rows: every input row gives one output row. A NULL text counts as empty; a text
without words has fingerprint zero and is linked like any other. A NULL key
takes part, but never names a component unless all keys of it are NULL, which
gives NULL. Repeated keys stay repeated.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F, types as T

from holdfast.llm.common import quoted, slices, staged, unsent, without

BITS = 64
SEED = 42
BATCH_BYTES = 2_000_000


def shingle_hashes(text: bytes, words: int) -> np.ndarray:
    """XXH64 of every run of ``words`` words, A-Z lower-cased, joined by a space."""
    found = text.lower().split()  # of bytes: ASCII letters and the six ASCII blanks
    if not found:
        return np.zeros(0, np.uint64)
    joined = b" ".join(found)
    ends = np.cumsum([len(w) + 1 for w in found]) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    count = max(len(found) - words + 1, 1)
    digest = xxhash.xxh64_intdigest
    return np.fromiter(
        (digest(joined[s:e], SEED) for s, e in
         zip(starts[:count].tolist(), ends[min(words, len(found)) - 1:].tolist())),
        np.uint64, count,
    )


def fingerprint_of(hashes: np.ndarray) -> int:
    """Each bit: set in over half of the hashes."""
    if not len(hashes):
        return 0
    ones = np.zeros(BITS, np.int64)
    for at in range(0, len(hashes), 65_536):
        bits = np.unpackbits(hashes[at:at + 65_536].astype("<u8").view(np.uint8).reshape(-1, 8),
                             axis=1, bitorder="little")
        ones += bits.sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(hashes), bitorder="little").view("<i8")[0])


def fingerprints(docs: DataFrame, text: str, words: int = 3, into: str = "fingerprint") -> DataFrame:
    """All columns but the text, and the fingerprint as a signed long."""
    kept = without(docs, [text, into])
    slim = docs.select(*[quoted(c) for c in kept], quoted(text).cast("string").alias("__text"))
    schema = T.StructType([*[docs.schema[c] for c in kept], T.StructField(into, T.LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "__text", BATCH_BYTES):
            texts = batch.column(batch.num_columns - 1).to_pylist()
            prints = [fingerprint_of(shingle_hashes((t or "").encode(), words)) for t in texts]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:-1], pa.array(prints, pa.int64())], names=[*kept, into]
            )

    return slim.mapInArrow(run, schema)


def ball(width: int, radius: int) -> list[int]:
    """Every mask of ``width`` bits with at most ``radius`` set."""
    return [sum(1 << b for b in some) for r in range(radius + 1) for some in combinations(range(width), r)]


def links(prints: DataFrame, column: str = "fingerprint", distance: int = 3, segments: int = 2) -> DataFrame:
    """Pairs (a, b), a < b, of distinct fingerprints at most ``distance`` bits apart."""
    cuts = [BITS * s // segments for s in range(segments + 1)]
    parts = [(s, lo, hi - lo) for s, (lo, hi) in enumerate(zip(cuts, cuts[1:]))]
    distinct = prints.select(F.col(column).alias("fp")).where("fp is not null").distinct()

    def value(lo: int, width: int):
        return F.shiftrightunsigned("fp", lo).bitwiseAND(F.lit((1 << width) - 1))

    filed = distinct.select("fp", F.explode(F.array(*[
        F.struct(F.lit(s).alias("seg"), value(lo, w).alias("key")) for s, lo, w in parts
    ])).alias("at")).select("at.*", F.col("fp").alias("b"))

    def asks(s: int, lo: int, width: int):
        masks = F.lit(ball(width, distance // segments)).cast("array<bigint>")
        return F.struct(F.lit(s).alias("seg"), F.transform(
            masks, lambda mask: value(lo, width).bitwiseXOR(mask)
        ).alias("keys"))

    asked = distinct.select("fp", F.explode(F.array(*[asks(*part) for part in parts])).alias("q")).select(
        F.col("fp").alias("a"), "q.seg", F.explode("q.keys").alias("key")
    )
    near = F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= distance
    pairs = unsent(asked).join(unsent(filed), ["seg", "key"]).where((F.col("a") < F.col("b")) & near)
    return pairs.select("a", "b").distinct()


def components(edges: DataFrame) -> DataFrame:
    """(node, root): the smallest node that each other linked node can reach.

    Large-star and small-star rounds; about the logarithm of the longest chain.
    A star's centre keeps one row for each member, so a component that holds a
    third of all nodes is a hot key of sums and joins only.
    """
    current = staged(edges.select(F.col("a").alias("u"), F.col("b").alias("v")), "links")
    before = None
    while True:
        both = current.union(current.select("v", "u")).toDF("u", "v")
        lowest = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = unsent(both).join(unsent(lowest), "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = large.where("u <> v").distinct()
        down = large.groupBy("u").agg(F.min("v").alias("m"))
        small = unsent(large).join(unsent(down), "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        small = small.union(down.select("u", F.col("m").alias("v"))).where("u <> v").distinct()
        current = staged(small, "links")
        state = current.agg(
            F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))
        ).first()
        if state == before:
            return current.groupBy(F.col("u").alias("node")).agg(F.min("v").alias("root"))
        before = state


def near_duplicates(docs: DataFrame, key: str, text: str, words: int = 3, distance: int = 3,
                    segments: int = 2, into: Sequence[str] = ("fingerprint", "component_id")) -> DataFrame:
    """Per row: the key, the fingerprint (signed long) and the smallest key its
    fingerprint reaches over links of at most ``distance`` bits."""
    slim = docs.select(quoted(key).alias("key"), quoted(text).alias("text"))
    prints = staged(fingerprints(slim, "text", words, "fp"), "fingerprints")
    classes = prints.groupBy("fp").agg(F.min("key").alias("least"))
    roots = components(links(prints, "fp", distance, segments))
    rooted = unsent(classes).join(unsent(roots), F.col("fp") == F.col("node"), "left").select(
        "fp", "least", F.coalesce("root", "fp").alias("root")
    )
    named = unsent(rooted).join(
        unsent(rooted.groupBy("root").agg(F.min("least").alias("component"))), "root"
    ).select("fp", "component")
    return unsent(prints).join(unsent(named), "fp").select(
        F.col("key").alias(key), F.col("fp").alias(into[0]), F.col("component").alias(into[1])
    )
