"""The dealt operators as queries over the given tables."""

from __future__ import annotations

from hashlib import sha256

import numpy as np
import pyarrow as pa
import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, functions as F

from holdfast.llm import bpe, classes, collocations, fim, licenses, mixing, neighbours, pages, secrets, simhash, topk, toxicity, warc
from holdfast.llm.common import staged, table
from holdfast.session import scratch_path

VOCABULARY = "byte_bpe_multi_50k.tiktoken"
PREDICTED = 0.7
# What the mixture asks for: half of all tokens, each document twice at most.
MIX_WEIGHTS = {"domain": {"*": 2, "src0": 3, "src1": 4}, "lang": {"*": 1, "en": 4, "de": 2, "fr": 2}}
MIX_PERMILLE, MIX_EPOCHS = 500, 2


def op1_exact_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.exact_top_k(table(spark, sf_dir, "embeddings"), "vec_id", "embedding", F.col("id") % 100 == 0)


def op2_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    versions = table(spark, sf_dir, "documents")
    # A first run: the ledger it meets is empty, and what it leaves is a table.
    ledger = staged(secrets.scan_unseen(versions, "text"), "ledger")
    found = secrets.findings(versions, ["doc_id"], "text", ledger)

    def count(kind: str):
        return F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("bigint").alias(f"n_{kind}")

    listed = secrets.joined(F.col("spans"))
    return found.select(
        "doc_id", *[count(r.kind) for r in secrets.BASE_RULES],
        F.sha2(listed.cast("binary"), 256).alias("base_sha256"), listed.alias("spans"),
    )


def mixed(docs: DataFrame) -> DataFrame:
    """A source's domain is what its name shares with others: its first four characters."""
    levels = [("domain", F.substring("source", 1, 4)), ("lang", F.col("lang")), ("source", F.col("source"))]
    return mixing.mix(docs, "doc_id", "text", levels, MIX_WEIGHTS, MIX_PERMILLE, MIX_EPOCHS)


def op3_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixed(table(spark, sf_dir, "documents")).select(
        "doc_id", "domain", "lang", "source", "n_tokens", "copies"
    )


def op4_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neighbours.nearest(table(spark, sf_dir, "embeddings"), "vec_id", "embedding", F.col("id") % 20 == 0)


def toxicity_model(spark: SparkSession, docs: DataFrame, sf_dir: str) -> toxicity.Field:
    return toxicity.fit(docs, table(spark, sf_dir, "labels"), "doc_id", "text", "toxic", ~toxicity.held_out(F.col("id")))


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    scored = toxicity.score(docs, "text", toxicity_model(spark, docs, sf_dir), keep=["doc_id"])
    offsets = F.array_join(F.transform("toxic_spans", lambda s: F.concat_ws(
        ":", s["start"].cast("string"), s["end"].cast("string"))), ",")
    return scored.select(
        "doc_id", toxicity.held_out(F.col("doc_id")).alias("held_out"), "score",
        (F.col("score") >= PREDICTED).cast("int").alias("predicted"), offsets.alias("toxic_offsets"),
    )


def encoded(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """Digests of each text's ids, and of the bytes that decoding them gives back."""
    vocabulary = bpe.Vocabulary(spark, public_tokenizers.path(VOCABULARY), public_tokenizers.PATTERN)

    def finish():
        tokens = vocabulary.token_bytes()

        def digests(batch: pa.RecordBatch) -> pa.RecordBatch:
            ids = batch.column(1)
            texts = bpe.token_text(ids, tokens)
            flat = ids.flatten().to_numpy(zero_copy_only=False).astype("<u4")
            sizes = pa.compute.list_value_length(ids).to_numpy(zero_copy_only=False)
            parts = np.split(flat, np.cumsum(sizes)[:-1])
            return pa.record_batch({
                "doc_id": batch.column(0), "n_tokens": pa.array(sizes, pa.int64()),
                "ids_sha256": pa.array([sha256(p).hexdigest() for p in parts], pa.string()),
                "decoded_sha256": pa.array([sha256(t).hexdigest() for t in texts], pa.string()),
            })

        return digests

    schema = "doc_id bigint, n_tokens bigint, ids_sha256 string, decoded_sha256 string"
    return bpe.encode(docs, "text", vocabulary, keep=["doc_id"], finish=finish, schema=schema)


def op6_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encoded(spark, table(spark, sf_dir, "documents"))


def op7_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pages.extract(table(spark, sf_dir, "pages").select("page_id", "url", "html"), "url", "html")
    return found.select("page_id", "url", "text", F.char_length("text").cast("bigint").alias("n_chars"))


def op8_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan_licenses(table(spark, sf_dir, "documents"), "doc_id", "text")


def op9_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch_path(spark, "warc")
    warc.write_warc(table(spark, sf_dir, "pages"), path)
    records = warc.read_warc(spark, path, with_payload=False)
    return records.select(
        warc.page_of("record_id").alias("page_id"), "payload_bytes", "payload_digest", "record_type",
        warc.page_of("refers_to").alias("refers_to"),
    )


def op10_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(table(spark, sf_dir, "documents"), "doc_id", "text")
    return found.select(
        "doc_id", F.lower(F.lpad(F.hex("fingerprint"), 16, "0")).alias("fingerprint"), "component_id"
    )


def op11_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = collocations.collocations(table(spark, sf_dir, "documents"), "doc_id", "text", "lang")
    return found.select("lang", "rank", "phrase", "a", "l", "r", "n", "score")


def op12_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = fim.transform(table(spark, sf_dir, "documents"), "doc_id", "text", keep=["doc_id"])
    back = fim.restored(F.col("output"), F.col("form"))
    return made.select(
        "doc_id", "n", "form", "prefix_chars", "middle_chars",
        F.sha2(F.col("output").cast("binary"), 256).alias("output_sha256"),
        F.sha2(back.cast("binary"), 256).alias("restored_sha256"),
    )


def op13_class_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    train = F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % 7 != 2
    return classes.score(table(spark, sf_dir, "documents"), "doc_id", "text", train)


LLM_QUERIES = {
    f.__name__: f for f in (
        op1_exact_top_k, op2_secret_scan, op3_source_mixing, op4_nearest_neighbours, op5_toxicity, op6_byte_bpe,
        op7_html_extraction, op8_license_scan, op9_warc, op10_simhash, op11_collocations, op12_fill_in_middle,
        op13_class_model,
    )
}
