"""Byte-level BPE: every distinct word of a chunk meets the merges once.

Plan, three narrow steps around two exchanges:

1. *Pre-tokens with positions.* Each task splits its texts by the vocabulary's
   pattern and takes them in chunks of ``chunk_chars``. A chunk keeps its
   distinct words apart (numbered by frequency) from its positions (one word
   number for each pre-token, in order). Words leave in ``buckets`` packed rows
   by hash, so what the exchange carries is the chunk's vocabulary and a
   compressed list of numbers, not one row for each pre-token.
2. *Distinct words.* A bucket holds every occurrence of its words over the
   whole corpus; a word is encoded when it is first seen there. A word that is
   everywhere is one entry for each chunk, so no key grows hot. There are as many
   buckets as the texts have ``BUCKET_BYTES``, so what a bucket holds does not grow
   with the corpus (beyond half a terabyte of text, buckets grow instead).
3. *Ids back, reassembled by position.* Rows meet again by chunk; the ids of
   each word number are laid out along the positions.

A chunk's name holds a digest of its content, and step 3 refuses a chunk that
does not have all its buckets, so a recomputed task whose input order changed
ends in an error and never in wrong ids. Read the input from a table.

Rows: every input row gives one output row. A NULL text counts as empty, an
empty text has no ids. NULL and repeated keys stay as they are. A kept column
of the result's own name is replaced by the result.
"""

from __future__ import annotations

import base64
import zlib
from collections.abc import Callable, Iterator, Sequence
from itertools import chain

import numpy as np
import pyarrow as pa
import regex
import tiktoken
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from holdfast.llm.common import framed, pack, quoted, slices, unframed, unpack, without

CHUNK_CHARS = 16_000_000
BUCKET_BYTES = 8_000_000  # of text, whose words share a bucket
LEAST_BUCKETS, MOST_BUCKETS = 8, 65_536
BATCH_BYTES = 4_000_000
MOST_VOCABULARY_BYTES = 64_000_000
ROWS = "bucket int, chunk string, kind int, data binary"
WORDS, POSITIONS, IDS = 0, 1, 2


class Vocabulary:
    """Ranks of a byte-level BPE and the pattern that splits texts.

    Shipped to the workers as the rank file's content, whose size is checked.
    """

    def __init__(self, spark: SparkSession, path: str, pattern: str):
        with open(path, "rb") as file:
            content = file.read(MOST_VOCABULARY_BYTES + 1)
        if len(content) > MOST_VOCABULARY_BYTES:
            raise ValueError(f"{path} has more than {MOST_VOCABULARY_BYTES} bytes")
        self.pattern = pattern
        self.content = spark.sparkContext.broadcast(content)

    def ranks(self) -> dict[bytes, int]:
        lines = (line.split() for line in self.content.value.splitlines() if line)
        return {base64.b64decode(token): int(rank) for token, rank in lines}

    def encoder(self) -> tiktoken.Encoding:
        return tiktoken.Encoding(
            "given", pat_str=self.pattern, mergeable_ranks=self.ranks(), special_tokens={}
        )

    def token_bytes(self) -> pa.Array:
        """The token-byte table, by id."""
        ranks = self.ranks()
        out: list[bytes | None] = [None] * (max(ranks.values(), default=-1) + 1)
        for token, rank in ranks.items():
            out[rank] = token
        return pa.array(out, pa.binary())


def encode(docs: DataFrame, text: str, vocabulary: Vocabulary, keep: Sequence[str] = (),
           into: str = "ids", chunk_chars: int = CHUNK_CHARS, buckets: int | None = None,
           finish: Callable[[], Callable[[pa.RecordBatch], pa.RecordBatch]] | None = None,
           schema: T.StructType | str | None = None) -> DataFrame:
    """``keep`` columns and the token ids of the whole text, as ``array<int>``.

    ``finish()`` gives a function of such batches whose result, of the given
    ``schema``, is returned in their place: what is derived from the ids then
    needs no pass of its own. ``buckets``: by default as the bytes of the texts need.
    """
    buckets = buckets or _buckets(docs, text)
    kept = [c for c in keep if c.lower() != into.lower()]
    slim = docs.select(*[quoted(c).alias(f"k{i}") for i, c in enumerate(kept)],
                       quoted(text).cast("string").alias("text"))
    chunks = slim.mapInArrow(_splitter(vocabulary.pattern, chunk_chars, buckets), ROWS)
    coded = (
        chunks.repartition("bucket").sortWithinPartitions("bucket")
        .mapInArrow(_encoder(vocabulary), ROWS)
    )
    lay_out = _assembler(len(kept), buckets, [*kept, into])
    own = T.StructType([
        *[T.StructField(c, docs.schema[c].dataType) for c in kept],
        T.StructField(into, T.ArrayType(T.IntegerType())),
    ])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        done = finish() if finish else None
        for batch in lay_out(batches):
            yield done(batch) if done else batch

    return coded.repartition("chunk").sortWithinPartitions("chunk", "kind", "bucket").mapInArrow(run, schema or own)


def _buckets(docs: DataFrame, text: str) -> int:
    total, = docs.agg(F.coalesce(F.sum(F.octet_length(quoted(text).cast("string"))), F.lit(0))).first()
    return min(MOST_BUCKETS, max(LEAST_BUCKETS, -(-total // BUCKET_BYTES)))


def decode(encoded: DataFrame, ids: str, vocabulary: Vocabulary, into: str = "decoded") -> DataFrame:
    """All columns and the bytes of the ids, read off the token-byte table.

    NULL ids, and ids the table does not hold, give NULL.
    """
    kept = without(encoded, [into])
    schema = T.StructType([*[encoded.schema[c] for c in kept], T.StructField(into, T.BinaryType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens = vocabulary.token_bytes()
        for batch in batches:
            lists = batch.column(batch.schema.get_field_index(ids))
            columns = [batch.column(batch.schema.get_field_index(c)) for c in kept]
            yield pa.RecordBatch.from_arrays(
                [*columns, pa.array(token_text(lists, tokens), pa.binary())], names=[*kept, into]
            )

    return encoded.mapInArrow(run, schema)


def token_text(lists: pa.ListArray, tokens: pa.Array) -> list[bytes | None]:
    """Join each list's ids with the token-byte table and put them together."""
    flat = lists.flatten()
    known = pa.compute.and_(pa.compute.greater_equal(flat, 0), pa.compute.less(flat, len(tokens)))
    known = pa.compute.fill_null(known, False)
    found = tokens.take(pa.compute.if_else(known, flat, pa.scalar(None, flat.type)))
    missing = np.concatenate([[0], np.cumsum(found.is_null().to_numpy(zero_copy_only=False))])
    filled = pa.compute.fill_null(found, b"")
    ends = np.frombuffer(filled.buffers()[1], np.int32)[filled.offset:filled.offset + len(filled) + 1] if len(filled) else [0]
    data = memoryview(filled.buffers()[2] or b"") if len(filled) else b""
    out: list[bytes | None] = []
    at = 0
    for length in pa.compute.list_value_length(lists).to_pylist():
        if length is None:
            out.append(None)
            continue
        whole = missing[at + length] == missing[at]
        out.append(bytes(data[ends[at]:ends[at + length]]) if whole else None)
        at += length
    return out


# --- step 1 ----------------------------------------------------------------

class _Chunk:
    """Words numbered as they come, and the numbers along the texts."""

    def __init__(self):
        self.numbers: dict[str, int] = {}
        self.codes: list[np.ndarray] = []
        self.keys: list[pa.RecordBatch] = []
        self.lengths: list[int] = []
        self.chars = 0

    def add(self, batch: pa.RecordBatch, split) -> None:
        numbers = self.numbers
        for value in batch.column(batch.num_columns - 1).to_pylist():
            words = split(value) if value else ()
            self.codes.append(np.fromiter(
                (numbers.setdefault(w, len(numbers)) for w in words), np.uint32, len(words)
            ))
            self.lengths.append(len(words))
            self.chars += len(value or "")
        self.keys.append(batch.select(range(batch.num_columns - 1)))

    def rows(self, place: str, buckets: int) -> list[tuple]:
        codes = np.concatenate(self.codes) if self.codes else np.zeros(0, np.uint32)
        order = np.argsort(-np.bincount(codes, minlength=len(self.numbers)), kind="stable")
        rank = np.empty(len(order), np.uint32)
        rank[order] = np.arange(len(order), dtype=np.uint32)
        words = list(self.numbers)
        listed: list[list[bytes]] = [[] for _ in range(buckets)]
        home = np.empty(len(order), np.uint32)
        for r, number in enumerate(order):
            word = words[number].encode()
            home[r] = b = zlib.crc32(word) % buckets
            listed[b].append(word)
        # Without key columns a batch has no rows of its own to count.
        rows = pa.record_batch({"n": pa.array(self.lengths, pa.int64())})
        keys = pa.Table.from_batches(self.keys) if self.keys[0].num_columns else pa.table({"n": rows.column(0)})
        sink = pa.BufferOutputStream()
        with pa.ipc.new_stream(sink, keys.schema) as writer:
            writer.write_table(keys)
        squeeze = zstandard.ZstdCompressor(level=1).compress
        payload = framed([
            squeeze(sink.getvalue().to_pybytes()), pack(np.array(self.lengths)),
            pack(rank[codes] if len(codes) else codes), pack(home),
        ])
        blobs = [
            framed([pack(np.array([len(w) for w in ws])), squeeze(b"".join(ws))]) if ws else b""
            for ws in listed
        ]
        digest = xxhash.xxh64(payload)
        for blob in blobs:
            digest.update(blob)
        name = f"{place}-{digest.hexdigest()}"
        return [
            (zlib.crc32(name.encode()) % buckets, name, POSITIONS, payload),
            *[(b, name, WORDS, blob) for b, blob in enumerate(blobs) if blob],
        ]


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    buckets, chunks, kinds, data = zip(*rows)
    return pa.record_batch({
        "bucket": pa.array(buckets, pa.int32()), "chunk": pa.array(chunks, pa.string()),
        "kind": pa.array(kinds, pa.int32()), "data": pa.array(data, pa.binary()),
    })


def _splitter(pattern: str, chunk_chars: int, buckets: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        split = regex.compile(pattern).findall
        task, made, chunk = TaskContext.get().partitionId(), 0, _Chunk()
        for batch in slices(batches, "text", BATCH_BYTES):
            chunk.add(batch, split)
            if chunk.chars >= chunk_chars:
                yield _batch(chunk.rows(f"{task}-{made}", buckets))
                made, chunk = made + 1, _Chunk()
        if chunk.keys:
            yield _batch(chunk.rows(f"{task}-{made}", buckets))

    return run


# --- step 2 ----------------------------------------------------------------

def _encoder(vocabulary: Vocabulary):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode_word = vocabulary.encoder().encode_ordinary
        unsqueeze = zstandard.ZstdDecompressor().decompress
        bucket, known = None, {}
        for row in _rows(batches):
            if row[2] == POSITIONS:
                yield _batch([row])
                continue
            if row[0] != bucket:
                bucket, known = row[0], {}
            sizes, text = unframed(row[3])
            text, at, ids = unsqueeze(text), 0, []
            for size in unpack(sizes).tolist():
                word = text[at:at + size]
                at += size
                got = known.get(word)
                if got is None:
                    got = known[word] = encode_word(word.decode())
                ids.append(got)
            blob = framed([
                pack(np.fromiter(map(len, ids), np.uint32, len(ids))),
                pack(np.fromiter(chain.from_iterable(ids), np.uint32)),
            ])
            yield _batch([(row[0], row[1], IDS, blob)])

    return run


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    for batch in batches:
        for i in range(batch.num_rows):
            yield tuple(batch.column(c)[i].as_py() for c in range(4))


# --- step 3 ----------------------------------------------------------------

def _assembler(keys: int, buckets: int, names: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chunk, held, blobs = None, None, {}
        for bucket, name, kind, data in _rows(batches):
            if name != chunk:
                if held is not None:
                    yield from _lay_out(chunk, held, blobs, keys, buckets, names)
                chunk, held, blobs = name, None, {}
            if kind == POSITIONS:
                held = data
            else:
                blobs[bucket] = data
        if held is not None:
            yield from _lay_out(chunk, held, blobs, keys, buckets, names)

    return run


def _lay_out(chunk, payload, blobs, keys, buckets, names, most=400_000) -> Iterator[pa.RecordBatch]:
    rows, lengths, codes, home = unframed(payload)
    rows = pa.ipc.open_stream(zstandard.ZstdDecompressor().decompress(rows)).read_all()
    lengths, codes, home = unpack(lengths), unpack(codes), unpack(home)
    sizes, flat = [], []
    counts = np.bincount(home, minlength=buckets)
    for b in range(buckets):
        if not counts[b]:
            continue
        size, ids = map(unpack, unframed(blobs[b])) if b in blobs else ([], [])
        if len(size) != counts[b]:
            raise RuntimeError(f"chunk {chunk} came without the ids of bucket {b}; read the input from a table")
        sizes.append(size)
        flat.append(ids)
    none = np.zeros(0, np.uint32)
    sizes, flat = (np.concatenate(x or [none]) for x in (sizes, flat))
    place = np.empty(len(home), np.int64)
    place[np.argsort(home, kind="stable")] = np.arange(len(home))
    starts = np.concatenate([[0], np.cumsum(sizes, dtype=np.int64)])[:-1]
    ends = np.concatenate([[0], np.cumsum(lengths, dtype=np.int64)])
    first = 0
    while first < len(lengths):
        last = max(first + 1, int(np.searchsorted(ends, ends[first] + most, "right")) - 1)
        at = place[codes[ends[first]:ends[last]]]
        n = sizes[at].astype(np.int64)
        before = np.concatenate([[0], np.cumsum(n)])
        ids = flat[np.repeat(starts[at] - before[:-1], n) + np.arange(before[-1])].astype(np.int32)
        offsets = before[ends[first:last + 1] - ends[first]].astype(np.int32)
        lists = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(ids, pa.int32()))
        kept = [c.combine_chunks() if isinstance(c, pa.ChunkedArray) else c
                for c in rows.slice(first, last - first).columns[:keys]]
        kept = [c.chunk(0) if isinstance(c, pa.ChunkedArray) else c for c in kept]
        yield pa.RecordBatch.from_arrays([*kept, lists], names=names)
        first = last
