"""Phrase collocations by Toivonen's sampling.

Texts are tokenised once into staged chunks: a chunk's distinct words and its token
ids, so that later passes touch integers only. A sample of the documents is mined
level by level under a lowered threshold. One full pass then counts exactly, for all
lengths at once, the proposed phrases and their negative border: every phrase of the
data whose parts one word shorter are both proposed (every word, for single words).
A border phrase that turns out frequent is a failure: what was not counted because
of it is counted in a further pass, until no pass finds another one. The result is
exact whatever the sample; the sample decides only how many passes there are.

Tasks learn what is proposed from a bitmap with two probes a phrase. Its size follows
the sample's phrases up to ``MOST_BITS`` (16 MB); it can say yes to a phrase that was
not proposed, which adds a phrase to count, but never no to one that was. A fuller
bitmap therefore prunes less and stays exact.

Rows: A NULL text counts as empty and gives no words; a NULL language counts as
``und``. Repeated rows count each time. Empty tables give no phrases. Columns other
than the three named are not looked at. Equal scores and counts are ordered by the
phrase's UTF-8 bytes.
"""

from __future__ import annotations

import math
from collections import defaultdict
from collections.abc import Iterator, Sequence
from dataclasses import dataclass
from itertools import count

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame, Window, functions as F

from holdfast.llm.common import pack, quoted, slices, staged, unpack

CHUNK_BYTES = 8_000_000
OUT_ROWS = 100_000
LEAST_BITS, MOST_BITS = 1 << 16, 1 << 27
BITS_A_PHRASE = 16
UNKNOWN = "und"
# Lower-cases A-Z and makes every character that ends a piece a line feed.
_SEPARATORS = b".,;:!?\n\x0b\x0c\r"
_TABLE = bytes(
    10 if b in _SEPARATORS else b + 32 if 65 <= b <= 90 else b for b in range(256)
)
_BREAK = b"\xff"  # a byte that UTF-8 never has


@dataclass(frozen=True)
class Mining:
    """``least``: occurrences of a frequent phrase; ``longest``: its most words. One
    of ``sample`` documents is mined first, down to ``lowered`` of what a frequent
    phrase is expected to have there."""

    least: int = 30
    longest: int = 4
    sample: int = 8
    lowered: float = 0.6

    def sample_least(self) -> int:
        return max(2, math.ceil(self.least * self.lowered / self.sample))


# --- chunks ------------------------------------------------------------------

class _Chunk:
    """Token ids of some texts; 0 ends a piece. Words of each language have ids of their own."""

    def __init__(self):
        self.fresh = count(1)
        self.words: dict[str, defaultdict] = {}
        self.ids: list[np.ndarray] = []
        self.size = 0

    def add(self, lang: str, text: bytes) -> None:
        if lang not in self.words:
            self.words[lang] = defaultdict(self.fresh.__next__, {_BREAK: 0})
        tokens = text.translate(_TABLE).replace(b"\n", b" \xff ").split()
        tokens.append(_BREAK)
        self.ids.append(np.fromiter(map(self.words[lang].__getitem__, tokens), np.uint32, len(tokens)))
        self.size += len(text)

    def row(self, sampled: bool) -> pa.RecordBatch:
        """Ids are dealt anew, language by language."""
        ids = np.concatenate(self.ids)
        renamed = np.zeros(next(self.fresh), np.uint32)
        lists, at = [], 1
        for known in self.words.values():
            del known[_BREAK]
            renamed[np.fromiter(known.values(), np.int64, len(known))] = np.arange(at, at + len(known))
            at += len(known)
            lists.append(pa.array(list(known), pa.binary()).cast(pa.string()))
        ids = renamed[ids]
        tops = np.cumsum([1, *map(len, lists)])
        n = np.diff(np.searchsorted(np.sort(ids), tops))
        sizes = np.cumsum([0, *map(len, lists)], dtype=np.int32)
        words = pa.ListArray.from_arrays(pa.array(sizes), pa.concat_arrays(lists))
        return pa.record_batch({
            "sampled": pa.array([sampled]), "langs": pa.array([list(self.words)], pa.list_(pa.string())),
            "words": pa.ListArray.from_arrays(pa.array([0, len(words)], pa.int32()), words),
            "n": pa.array([n.tolist()], pa.list_(pa.int64())), "ids": pa.array([pack(ids)], pa.binary()),
        })


CHUNKS = "sampled boolean, langs array<string>, words array<array<string>>, n array<bigint>, ids binary"


def chunks(docs: DataFrame, key: str, text: str, lang: str, sample: int) -> DataFrame:
    """The documents as staged chunks of one task's texts; the sample has chunks of its own."""
    slim = docs.select(
        (F.pmod(F.xxhash64(quoted(key).cast("string")), F.lit(sample)) == 0).alias("sampled"),
        F.coalesce(quoted(lang).cast("string"), F.lit(UNKNOWN)).alias("lang"),
        F.coalesce(quoted(text).cast("string"), F.lit("")).alias("text"),
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = {True: _Chunk(), False: _Chunk()}
        for batch in slices(batches, "text", CHUNK_BYTES):
            texts = batch.column("text").cast(pa.binary()).to_pylist()
            for is_sampled, name, data in zip(batch.column("sampled").to_pylist(), batch.column("lang").to_pylist(), texts):
                held[is_sampled].add(name, data)
                if held[is_sampled].size >= CHUNK_BYTES:
                    yield held[is_sampled].row(is_sampled)
                    held[is_sampled] = _Chunk()
        for is_sampled, chunk in held.items():
            if chunk.ids:
                yield chunk.row(is_sampled)

    return staged(slim.mapInArrow(run, CHUNKS), "chunks", by="sampled")


# --- what is proposed --------------------------------------------------------

_STEP, _MIX, _TURN = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93), np.uint64(0xA0761D6478BD642F)


def _word_hashes(lang: str, words: Sequence[str]) -> np.ndarray:
    prefix = lang.encode() + b"\0"
    return np.fromiter((xxhash.xxh64_intdigest(prefix + w.encode()) for w in words), np.uint64, len(words))


def _longer(hashes: np.ndarray, word: np.ndarray) -> np.ndarray:
    """Hashes of phrases that one more word follows."""
    return hashes * _STEP + word


def _probes(hashes: np.ndarray, bits: int) -> list[np.ndarray]:
    shift = np.uint64(64 - bits.bit_length() + 1)
    mixed = (hashes ^ hashes >> np.uint64(32)) * _MIX
    mixed ^= mixed >> np.uint64(29)
    return [(mixed * m) >> shift for m in (_STEP, _TURN)]


def _has(bitmap: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    found = np.ones(len(hashes), bool)
    for at in _probes(hashes, 64 * len(bitmap)):
        found &= (bitmap[at >> np.uint64(6)] >> (at & np.uint64(63)) & np.uint64(1)).astype(bool)
    return found


def _phrase_hashes(batch: pa.RecordBatch) -> np.ndarray:
    """Hashes of the rows' phrases, as the counting pass makes them of adjacent words."""
    out = np.zeros(batch.num_rows, np.uint64)
    for i, (lang, phrase) in enumerate(zip(batch.column("lang").to_pylist(), batch.column("phrase").to_pylist())):
        words = _word_hashes(lang, phrase.split(" "))
        h = words[:1]
        for w in range(1, len(words)):
            h = _longer(h, words[w:w + 1])
        out[i] = h[0]
    return out


def _added(bitmap: np.ndarray, phrases: DataFrame) -> np.ndarray:
    """The bitmap with some phrases more. Tasks send set bits, or-ed by 64-bit word,
    so the driver gets no more than the bitmap's own size."""
    bits = 64 * len(bitmap)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = np.concatenate(_probes(_phrase_hashes(batch), bits))
            mask = np.uint64(1) << (at & np.uint64(63))
            yield pa.record_batch({"slot": pa.array((at >> np.uint64(6)).astype(np.int64)), "mask": pa.array(mask.view(np.int64))})

    found = (
        phrases.select("lang", "phrase").mapInArrow(run, "slot bigint, mask bigint")
        .groupBy("slot").agg(F.bit_or("mask").alias("mask")).toArrow()
    )
    out = bitmap.copy()
    out[found.column("slot").to_numpy()] |= found.column("mask").to_numpy().view(np.uint64)
    return out


# --- counting ----------------------------------------------------------------

def _marked(places: np.ndarray, flags: np.ndarray, size: int) -> np.ndarray:
    out = np.zeros(size + 1, bool)
    out[places] = flags
    return out


def _counted(ids: np.ndarray, hashes: np.ndarray, lengths: Sequence[int], known: np.ndarray,
             before: np.ndarray | None) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For each length: the word ids of the candidates (a row each) and their counts.

    A phrase is a candidate if ``known`` has both its parts one word shorter, but
    not if ``before`` has both as well: then an earlier pass counted it.
    """
    h, places = hashes[ids], np.flatnonzero(ids)
    width = np.int64(len(hashes))
    if 1 in lengths:
        n = np.bincount(ids, minlength=len(hashes))
        n[0] = 0
        found = np.flatnonzero(n)
        yield found[:, None], n[found]
    # h and places: phrases one word shorter, by where they start; reached: those
    # among them that the earlier pass looked at, too.
    reached = ids > 0
    passes = _has(known, hashes)[ids[places]]
    passed = _has(before, hashes)[ids[places]] if before is not None else None
    for length in range(2, max(lengths) + 1):
        if length > 2:
            passes = _has(known, h[places])
            passed = _has(before, h[places]) & reached[places] if before is not None else None
        ok = _marked(places, passes, len(ids))
        starts = np.flatnonzero(ok[:-1] & ok[1:])
        if passed is not None:
            ok = _marked(places, passed, len(ids))
            reached = ok[:-1] & ok[1:]
        if length < max(lengths):
            longer = np.zeros_like(h)
            longer[starts] = _longer(h[starts], hashes[ids[starts + length - 1]])
            h, places = longer, starts
        if length in lengths:
            yield _distinct(ids, starts if passed is None else starts[~reached[starts]], length, width)


def _distinct(ids: np.ndarray, starts: np.ndarray, length: int, width: np.int64) -> tuple[np.ndarray, np.ndarray]:
    """The distinct phrases of a length that start at some places, and their counts.

    A phrase's number is its first words' number and its last word in one, so that it
    fits 64 bits at every length; sorted numbers give the words back.
    """
    keys, tables = ids[starts].astype(np.int64), []
    for w in range(1, length):
        if w > 1:
            tables.append(np.unique(keys))
            keys = np.searchsorted(tables[-1], keys)
        keys = keys * width + ids[starts + w]
    keys, n = np.unique(keys, return_counts=True)
    columns = []
    while True:
        keys, last = np.divmod(keys, width)
        columns.append(last)
        if not tables:
            break
        keys = tables.pop()[keys]
    columns.append(keys)
    return np.stack(columns[::-1], axis=1).astype(np.uint32), n


def counts(parts: DataFrame, lengths: Sequence[int], known: np.ndarray, before: np.ndarray | None,
           least: int) -> DataFrame:
    """(lang, phrase, f) of the candidates that occur ``least`` times in the chunks."""
    spark = parts.sparkSession
    shared = spark.sparkContext.broadcast((known, before))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, before = shared.value
        for batch in batches:
            for r in range(batch.num_rows):
                langs = batch.column("langs")[r].as_py()
                lists = batch.column("words")[r].values
                words = pa.concat_arrays([pa.array([""]), lists.flatten()])
                hashes = np.concatenate([np.zeros(1, np.uint64), *(
                    _word_hashes(lang, lists[i].as_py()) for i, lang in enumerate(langs))])
                tops = np.cumsum([1, *pc.list_value_length(lists).to_pylist()])
                ids = unpack(batch.column("ids")[r].as_py())
                for found, n in _counted(ids, hashes, lengths, known, before):
                    which = np.searchsorted(tops, found[:, 0], side="right") - 1
                    for at in range(0, len(n), OUT_ROWS):
                        some = found[at:at + OUT_ROWS]
                        parts = [words.take(pa.array(some[:, w])) for w in range(some.shape[1])]
                        yield pa.record_batch({
                            "lang": pa.array(langs, pa.string()).take(pa.array(which[at:at + OUT_ROWS])),
                            "phrase": pc.binary_join_element_wise(*parts, " "),
                            "f": pa.array(n[at:at + OUT_ROWS], pa.int64()),
                        })

    # Chunks give each phrase once, so nothing is left to combine ahead of the exchange.
    found = parts.select("langs", "words", "ids").mapInArrow(run, "lang string, phrase string, f bigint")
    return found.repartition("lang", "phrase").groupBy("lang", "phrase").agg(F.sum("f").alias("f")).where(F.col("f") >= least)


def _failures(frequent: DataFrame, known: np.ndarray) -> DataFrame:
    """Frequent phrases that were not proposed."""
    shared = frequent.sparkSession.sparkContext.broadcast(known)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.filter(pa.array(~_has(shared.value, _phrase_hashes(batch))))

    return frequent.mapInArrow(run, frequent.schema)


def proposed(parts: DataFrame, mining: Mining) -> np.ndarray:
    """The bitmap of what is frequent in the sample, mined level by level. Phrases
    of the greatest length are no part of a longer one and need no place in it."""
    sample, least = parts.where("sampled"), mining.sample_least()
    nothing = np.zeros(LEAST_BITS // 64, np.uint64)
    words = staged(counts(sample, [1], nothing, None, least), "level")
    wanted = BITS_A_PHRASE * max(words.count(), 1) * max(mining.longest - 1, 1)
    bits = min(max(1 << (wanted - 1).bit_length(), LEAST_BITS), MOST_BITS)
    known = _added(np.zeros(bits // 64, np.uint64), words)
    for length in range(2, mining.longest):
        known = _added(known, counts(sample, [length], known, None, least))
    return known


def frequent_phrases(parts: DataFrame, mining: Mining = Mining()) -> DataFrame:
    """(lang, phrase, f): every phrase of up to ``longest`` words with at least ``least`` occurrences."""
    known, before = proposed(parts, mining), None
    lengths: Sequence[int] = range(1, mining.longest + 1)
    passes = []
    while True:
        passes.append(staged(counts(parts, lengths, known, before, mining.least), "frequent"))
        missed = staged(
            _failures(passes[-1].where(F.size(F.split("phrase", " ")) < mining.longest), known), "failures"
        )
        if missed.isEmpty():
            break
        known, before = _added(known, missed), known
        lengths = range(2, mining.longest + 1)
    out = passes[0]
    for more in passes[1:]:
        out = out.unionByName(more)
    return out


# --- scores ------------------------------------------------------------------

def _slice(words: Column, start: Column | int, size: Column | int) -> Column:
    return F.array_join(F.slice(words, start, size), " ")


def cuts(frequent: DataFrame, scale: int = 2_000_000) -> DataFrame:
    """(lang, phrase, words, a, l, r, score): each longer phrase at its lowest-scoring cut."""
    words = F.split("phrase", " ")
    longer = frequent.select("lang", "phrase", F.col("f").alias("a"), words.alias("w")).where(F.size("w") > 1)
    each = longer.withColumn("k", F.explode(F.sequence(F.lit(1), F.size("w") - 1))).select(
        "lang", "phrase", "a", "k", F.size("w").alias("words"), _slice(F.col("w"), 1, F.col("k")).alias("first"),
        _slice(F.col("w"), F.col("k") + 1, F.size("w") - F.col("k")).alias("rest"),
    )
    left = frequent.select("lang", F.col("phrase").alias("first"), F.col("f").alias("l"))
    right = frequent.select("lang", F.col("phrase").alias("rest"), F.col("f").alias("r"))
    parts = each.join(left, ["lang", "first"]).join(right, ["lang", "rest"])
    # Products may pass 64 bits; the quotient can't, as neither part is rarer than the whole.
    product = F.col("a").cast("decimal(20,0)") * F.lit(scale).cast("decimal(10,0)")
    total = F.col("l").cast("decimal(20,0)") + F.col("r").cast("decimal(20,0)")
    scored = parts.withColumn("score", F.call_function("div", product, total))
    lowest = scored.groupBy("lang", "phrase", "words", "a").agg(F.min(F.struct("score", "k", "l", "r")).alias("cut"))
    return lowest.select("lang", "phrase", "words", "a", "cut.l", "cut.r", "cut.score")


def covers(frequent: DataFrame) -> DataFrame:
    """(lang, phrase, cover): the count of the most frequent longer phrase that holds a phrase of two words or more."""
    words = frequent.select("lang", "f", F.split("phrase", " ").alias("w")).where(F.size("w") > 2)
    spans = F.explode(F.expr(
        "flatten(transform(sequence(2, size(w) - 1), n -> transform(sequence(1, size(w) - n + 1), i -> array_join(slice(w, i, n), ' '))))"
    ))
    return words.select("lang", "f", spans.alias("phrase")).groupBy("lang", "phrase").agg(F.max("f").alias("cover"))


def best_of(rows: DataFrame, group: str, order: Sequence[Column], most: int, salt: Column) -> DataFrame:
    """The first ``most`` rows of each group with their ``rank``. A group is sorted in
    parts first, of which only the first rows meet, so that no task sorts a large one."""
    parts = max(1, math.isqrt(rows.count() // most))
    dealt = Window.partitionBy(group, F.pmod(salt, F.lit(parts))).orderBy(*order)
    met = rows.withColumn("rank", F.row_number().over(dealt)).where(F.col("rank") <= most)
    whole = Window.partitionBy(group).orderBy(*order)
    return met.withColumn("rank", F.row_number().over(whole).cast("bigint")).where(F.col("rank") <= most)


def collocations(docs: DataFrame, key: str, text: str, lang: str, mining: Mining = Mining(),
                 most: int = 2000, covered: int = 80) -> DataFrame:
    """(lang, rank, phrase, words, a, l, r, n, score): each language's ``most`` best
    phrases of two words or more, but for those that a longer phrase with at least
    ``covered`` per cent of their count holds. ``n``: all words of the language."""
    parts = chunks(docs, key, text, lang, mining.sample)
    frequent = staged(frequent_phrases(parts, mining), "phrases")
    totals = parts.select(F.explode(F.arrays_zip("langs", "n")).alias("t")).groupBy(F.col("t.langs").alias("lang")).agg(
        F.sum("t.n").alias("n")
    )
    percent = F.col("cover").cast("decimal(20,0)") * 100 < F.col("a").cast("decimal(20,0)") * covered
    kept = staged(
        cuts(frequent).join(covers(frequent), ["lang", "phrase"], "left").where(F.col("cover").isNull() | percent), "scored"
    )
    order = [F.col("score").desc(), F.col("a").desc(), F.col("phrase").asc()]
    ranked = best_of(kept, "lang", order, most, F.xxhash64("phrase"))
    return ranked.join(totals, "lang").select("lang", "rank", "phrase", "words", "a", "l", "r", "n", "score")
