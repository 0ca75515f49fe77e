"""Fill-in-middle: a text is cut at two units (code points) and its parts reordered.

The cuts are found without decoding. A batch's UTF-8 bytes are viewed as 64-bit
words; a byte ends a unit if the next byte is no continuation (10xxxxxx), which
shifts and masks tell for eight bytes at once. One population count for each word
and their running sum give the number of units before any byte; the byte of unit
k is found by a binary search for its word and a select inside the word, again by
arithmetic on all bytes of it (a product with 0x0101... sums the marks up to each
byte). Forms: ``psm`` is <P>prefix<S>suffix<M>middle, ``spm`` is
<S>suffix<P>prefix<M>middle, ``plain`` is the text itself.

Rows: every input row gives one output row, in one narrow pass over whole texts.
A NULL text counts as empty; an empty text and one that holds a sentinel stay
plain. A NULL key draws like the empty key. Rows that repeat an id draw alike, so
equal rows give equal results. A column to keep that is named like a result gives
way to the result. An empty table gives an empty one. Texts are valid UTF-8.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, functions as F, types as T

from holdfast.llm.common import quoted, slices, without

BATCH_BYTES = 4_000_000
ONES = np.uint64(0x0101010101010101)
HIGHS = np.uint64(0x8080808080808080)
RESULTS = ("output", "form", "n", "prefix_chars", "middle_chars")


@dataclass(frozen=True)
class Recipe:
    """Sentinels of prefix, suffix and middle; per cent of texts that are reordered,
    and of those the per cent that put the suffix first."""

    sentinels: tuple[str, str, str] = ("<P>", "<S>", "<M>")
    reordered: int = 90
    suffix_first: int = 20
    seed: int = 1


class Units:
    """Rank and select of unit ends in UTF-8 bytes."""

    def __init__(self, data: np.ndarray):
        padded = np.zeros((len(data) // 8 + 2) * 8, np.uint8)
        padded[:len(data)] = data
        words = padded.view("<u8")
        starts = ~((words >> np.uint64(7)) & ~(words >> np.uint64(6))) & ONES
        # A byte ends a unit where the byte after it, perhaps of the next word, starts one.
        self.ends = starts[:-1] >> np.uint64(8) | starts[1:] << np.uint64(56)
        self.before = np.concatenate([[0], np.cumsum(np.bitwise_count(self.ends), dtype=np.int64)])

    def rank(self, at: np.ndarray) -> np.ndarray:
        """Units that end before each byte offset."""
        word, byte = at >> 3, (at & 7).astype(np.uint64)
        below = (np.uint64(1) << byte * np.uint64(8)) - np.uint64(1)
        return self.before[word] + np.bitwise_count(self.ends[word] & below)

    def select(self, k: np.ndarray) -> np.ndarray:
        """The byte offset behind the k-th unit; 0 for none."""
        word = np.maximum(np.searchsorted(self.before, k, side="left") - 1, 0)
        need = np.maximum(k - self.before[word], 1).astype(np.uint64)
        upto = self.ends[word] * ONES  # byte j: the ends in bytes 0 to j, eight at most
        reached = upto + (np.uint64(128) - need) * ONES & HIGHS
        return np.where(k > 0, word * 8 + 9 - np.bitwise_count(reached), 0)


def draws(seed: int, key: Column) -> list[Column]:
    """Four unsigned 32-bit numbers of a key."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(key.cast("string"), F.lit(""))).cast("binary"), 256)
    return [F.conv(F.substring(digest, 8 * i + 1, 8), 16, 10).cast("bigint") for i in range(4)]


def _reordered(batch: pa.RecordBatch, recipe: Recipe) -> dict[str, pa.Array]:
    """The results for a batch with the columns __text and __h0 to __h3."""
    texts = batch.column("__text").cast(pa.large_string())
    h = [batch.column(f"__h{i}").to_numpy(zero_copy_only=False) for i in range(4)]
    offsets = np.frombuffer(texts.buffers()[1], "<i8")[texts.offset:texts.offset + len(texts) + 1]
    whole = texts.buffers()[2]
    data = np.frombuffer(whole, np.uint8)[offsets[0]:offsets[-1]] if whole else np.zeros(0, np.uint8)
    start, end = offsets[:-1] - offsets[0], offsets[1:] - offsets[0]
    units = Units(data)
    first, n = units.rank(start), units.rank(end) - units.rank(start)
    one, two = h[0] % (n + 1), h[1] % (n + 1)
    low, high = np.minimum(one, two), np.maximum(one, two)
    left, right = units.select(first + low), units.select(first + high)

    plain = (n == 0) | (h[2] % 100 >= recipe.reordered)
    for sentinel in recipe.sentinels:
        plain |= pc.match_substring(texts, sentinel).to_numpy(zero_copy_only=False)
    spm = h[3] % 100 < recipe.suffix_first
    p, s, m = (x.encode() for x in recipe.sentinels)
    data, out = data.tobytes(), []
    for is_plain, is_spm, a, b, c, d in zip(*(x.tolist() for x in (plain, spm, start, left, right, end))):
        if is_plain:
            out.append(data[a:d])
        elif is_spm:
            out.append(b"".join((s, data[c:d], p, data[a:b], m, data[b:c])))
        else:
            out.append(b"".join((p, data[a:b], s, data[c:d], m, data[b:c])))
    form = np.where(plain, "plain", np.where(spm, "spm", "psm"))
    return {
        "output": pa.array(out, pa.binary()).cast(pa.string()),
        "form": pa.array(form.tolist(), pa.string()),
        "n": pa.array(n, pa.int64()),
        "prefix_chars": pa.array(low, pa.int64(), mask=plain),
        "middle_chars": pa.array(high - low, pa.int64(), mask=plain),
    }


def transform(docs: DataFrame, key: str, text: str, keep: Sequence[str] | None = None,
              recipe: Recipe = Recipe(), into: Sequence[str] = RESULTS) -> DataFrame:
    """The kept columns, then output, form, units, and units of prefix and middle (NULL if plain).

    ``keep`` are all columns but the text if not given.
    """
    kept = [c for c in (without(docs, [text]) if keep is None else keep) if c.lower() not in {n.lower() for n in into}]
    slim = docs.select(
        *[quoted(c) for c in kept], F.coalesce(quoted(text).cast("string"), F.lit("")).alias("__text"),
        *[d.alias(f"__h{i}") for i, d in enumerate(draws(recipe.seed, quoted(key)))],
    )
    kinds = (T.StringType(), T.StringType(), T.LongType(), T.LongType(), T.LongType())
    schema = T.StructType([*[docs.schema[c] for c in kept], *[T.StructField(*f) for f in zip(into, kinds)]])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "__text", BATCH_BYTES):
            found = _reordered(batch, recipe)
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:len(kept)], *(found[r] for r in RESULTS)], names=[*kept, *into]
            )

    return slim.mapInArrow(run, schema)


def restored(output: Column, form: Column, recipe: Recipe = Recipe()) -> Column:
    """The text that an output was made from. No sentinel overlaps itself or another
    and the text holds none, so a reordered output splits into four parts."""
    parts = F.split(output, "|".join(f"\\Q{s}\\E" for s in recipe.sentinels), -1)
    return (
        F.when(form == "psm", F.concat(parts[1], parts[3], parts[2]))
        .when(form == "spm", F.concat(parts[2], parts[3], parts[1]))
        .otherwise(output)
    )
