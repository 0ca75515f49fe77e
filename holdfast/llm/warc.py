"""WARC archives: written by Spark's text sink, read back by byte ranges.

Writing. Every row becomes one gzip member. The sink puts a NUL byte after each
row; a member ends with the high byte of its length, which is NUL below 16 MB,
so each row leaves without that byte and the sink's separator completes it (a
larger record gets an empty member behind it, which ends in NUL). The files are
plain concatenated members, in any store Spark can write, with Spark's commit.

Reading. A task gets a byte range of a file, looks for the gzip magic, and
accepts a candidate only if what it inflates to starts as a WARC header, of any
length. It owns the records that start inside its range and reads past the end to
finish the last one. What starts as a record and is none is an error.

Payloads: a NULL page counts as empty. Of rows with equal payloads of at least
``least_bytes`` bytes, the one with the largest id is the response, and the rest
are revisits that name it. Rows that share that largest id are all responses. A
row without an id is a revisit if some row of its group has one, else a
response. Smaller payloads are always responses. Repeated rows stay repeated.
"""

from __future__ import annotations

import gzip
import hashlib
import re
import zlib
from collections.abc import Iterator
from urllib.parse import quote

import pyarrow as pa
import pyarrow.fs
from pyspark.sql import DataFrame, SparkSession, functions as F

from holdfast.llm.common import quoted, slices

LEAST_BYTES = 1000
RANGE_BYTES = 16_000_000
READ_BYTES = 1_000_000
BATCH_BYTES = 4_000_000
START = b"WARC/"
MAGIC = b"\x1f\x8b\x08"
EMPTY_MEMBER = gzip.compress(b"", mtime=0)
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
ID = "urn:x-page:"


# --- writing ---------------------------------------------------------------

def classified(pages: DataFrame, page_id: str, url: str, html: str, least_bytes: int = LEAST_BYTES) -> DataFrame:
    """page_id, url, payload text, its digest, and the id it refers to, if any."""
    rows = pages.select(
        quoted(page_id).cast("bigint").alias("page_id"), quoted(url).cast("string").alias("url"),
        F.coalesce(quoted(html).cast("string"), F.lit("")).alias("payload"),
    ).withColumn("digest", F.sha1(F.col("payload").cast("binary")))
    # Only groups with a second member need an answer; sums of them combine map-side.
    heads = (
        rows.where(F.octet_length("payload") >= least_bytes).groupBy(F.col("digest").alias("same"))
        .agg(F.max("page_id").alias("head"), F.count(F.lit(1)).alias("n"))
        .where("n > 1 and head is not null").drop("n")
    )
    held = (F.col("digest") == F.col("same"))
    return rows.join(heads, held, "left").select(
        "page_id", "url", "payload", "digest",
        F.when(~F.col("page_id").eqNullSafe(F.col("head")), F.col("head")).alias("refers_to"),
    )


def write_warc(pages: DataFrame, path: str, page_id: str = "page_id", url: str = "url",
               html: str = "html", date: str = "2024-01-01T00:00:00Z",
               least_bytes: int = LEAST_BYTES) -> None:
    """One record for each row, in one archive for each task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "payload", BATCH_BYTES):
            rows = zip(*[batch.column(c).to_pylist() for c in range(5)])
            yield pa.record_batch({"member": pa.array([_member(*r, date) for r in rows], pa.binary())})

    members = classified(pages, page_id, url, html, least_bytes).mapInArrow(run, "member binary")
    # Bytes pass through the cast and the text sink as they are.
    members.select(F.col("member").cast("string").alias("value")).write.option("lineSep", "\0").text(path)


def _member(page, url, payload, digest, refers_to, date) -> bytes:
    body = payload.encode()
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(body)}\r\n\r\n".encode()
    block = http if refers_to is not None else http + body
    lines = ["WARC/1.1", f"WARC-Type: {'response' if refers_to is None else 'revisit'}",
             f"WARC-Record-ID: <{ID}{'' if page is None else page}>", f"WARC-Date: {date}"]
    if url is not None:
        # Blanks, line ends and whatever is not ASCII can't stand in a header.
        lines.append(f"WARC-Target-URI: {quote(url, safe=':/?#[]@!$&()*+,;=%~')}")
    lines.append(f"WARC-Payload-Digest: sha1:{digest}")
    if refers_to is not None:
        lines += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: <{ID}{refers_to}>"]
    lines += ["Content-Type: application/http;msgtype=response", f"Content-Length: {len(block)}", "", ""]
    member = gzip.compress("\r\n".join(lines).encode() + block + b"\r\n\r\n", 6, mtime=0)
    return member[:-1] if member[-1] == 0 else member + EMPTY_MEMBER[:-1]


# --- reading ---------------------------------------------------------------

RECORD = ("file string, offset bigint, record_type string, record_id string, target_uri string, "
          "refers_to string, payload_digest string, payload_bytes bigint, payload binary")


def read_warc(spark: SparkSession, path: str, range_bytes: int = RANGE_BYTES, with_payload: bool = True) -> DataFrame:
    """Every record of the archives under ``path``.

    ``payload_bytes`` and ``payload_digest`` of a response are those of the
    payload read, and a stated digest that differs is an error; those of a
    revisit are the stated ones. An archive that ends inside a record is an error.
    """
    files = spark.read.format("binaryFile").load(path).select("path", "length").where("length > 0")
    starts = F.sequence(F.lit(0).cast("bigint"), F.col("length") - 1, F.lit(range_bytes).cast("bigint"))
    # A stated number: to Spark the ranges are a few small rows, which it would put into one task.
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    ranges = files.select("path", F.explode(starts).alias("start")).repartition(tasks, "path", "start")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, start in zip(*[batch.column(c).to_pylist() for c in range(2)]):
                rows, held = [], 0
                for offset, content in members(name, start, start + range_bytes):
                    rows.append((name, offset, *parsed(content, f"{name} at {offset}", with_payload)))
                    held += len(content)
                    if held >= BATCH_BYTES:
                        yield _records(rows)
                        rows, held = [], 0
                if rows:
                    yield _records(rows)

    return ranges.mapInArrow(run, RECORD)


def _records(rows: list[tuple]) -> pa.RecordBatch:
    kinds = {"string": pa.string(), "bigint": pa.int64(), "binary": pa.binary()}
    columns = [c.split() for c in RECORD.split(", ")]
    return pa.record_batch({n: pa.array(v, kinds[k]) for (n, k), v in zip(columns, zip(*rows))})


def members(name: str, start: int, end: int) -> Iterator[tuple[int, bytes]]:
    """(offset, inflated content) of the WARC members that start in [start, end)."""
    store, inner = pa.fs.FileSystem.from_uri(re.sub(r"^file:/+", "file:///", name))
    with store.open_input_file(inner) as file:
        at = start
        while at < end:
            at = _next_magic(file, at, end)
            if at is None:
                return
            found = _inflated(file, at, name)
            if found is None:
                at += 1
                continue
            size, content = found
            yield at, content
            at += size


def _next_magic(file, at: int, end: int) -> int | None:
    while at < end:
        window = file.read_at(min(READ_BYTES, end - at) + len(MAGIC) - 1, at)
        hit = window.find(MAGIC)
        if hit >= 0:
            return at + hit
        if len(window) < len(MAGIC):
            return None
        at += len(window) - len(MAGIC) + 1
    return None


def _inflated(file, at: int, name: str) -> tuple[int, bytes] | None:
    """Compressed size and content of the member at an offset; None if it is no WARC member."""
    inflate, content, read, sure = zlib.decompressobj(31), bytearray(), 0, False
    while not inflate.eof:
        data = file.read_at(READ_BYTES, at + read)
        if not data:
            if sure:
                raise ValueError(f"{name} ends inside the record at {at}")
            return None
        read += len(data)
        try:
            # Until the start is sure, no more than a read's worth is inflated.
            content += inflate.decompress(data, 0 if sure else READ_BYTES)
            if not sure:
                if not content.startswith(START[:len(content)]) or len(content) < len(START) and inflate.eof:
                    return None
                sure = len(content) >= len(START)
                if sure and not inflate.eof:
                    content += inflate.decompress(inflate.unconsumed_tail)
        except zlib.error:
            if sure:
                raise ValueError(f"{name}: the record at {at} is damaged") from None
            return None
    if b"\r\n\r\n" not in content:
        raise ValueError(f"{name}: the record at {at} has no end of its header")
    return read - len(inflate.unused_data), bytes(content)


def parsed(content: bytes, place: str, with_payload: bool) -> tuple:
    head, _, rest = content.partition(b"\r\n\r\n")
    fields = dict(line.split(": ", 1) for line in head.decode().split("\r\n")[1:])
    block = rest[:int(fields["Content-Length"])]
    http, _, payload = block.partition(b"\r\n\r\n")
    stated = fields.get("WARC-Payload-Digest", "").removeprefix("sha1:")
    kind = fields.get("WARC-Type")
    if kind == "revisit":
        size = re.search(rb"(?i)\r\nContent-Length: (\d+)", http)
        size, digest, payload = int(size[1]) if size else None, stated, None
    else:
        size, digest = len(payload), hashlib.sha1(payload).hexdigest()
        if stated and stated != digest:
            raise ValueError(f"{place}: the payload does not match its digest")
    named = [fields.get(f, "")[1:-1] or None for f in ("WARC-Record-ID", "WARC-Refers-To")]
    return (kind, named[0], fields.get("WARC-Target-URI"), named[1], digest, size,
            payload if with_payload else None)


def page_of(name: str):
    """The page id in a record id that this module wrote; NULL if it holds none."""
    return F.nullif(F.substring(F.col(name), len(ID) + 1, 64), F.lit("")).cast("bigint")
