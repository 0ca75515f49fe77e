"""A corpus pipeline: toxic documents go, one of each near-duplicate group stays,
secrets are masked, sources are mixed to weights, and what remains is encoded.

Each stage takes the documents its predecessor kept, as a table, and returns the
documents' own columns; the last returns each document's token digests.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from holdfast.llm import queries as Q, secrets, simhash, toxicity
from holdfast.llm.common import quoted, staged, table, unsent


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents scored below ``PREDICTED`` stay, with all their columns; repeated rows
    are scored alike, and an empty or NULL text gets the score of no evidence."""
    model = Q.toxicity_model(spark, docs, sf_dir)
    scored = toxicity.score(docs, "text", model, into=["toxic_score"], with_spans=False)
    return scored.where(F.col("toxic_score") < Q.PREDICTED).select(*map(quoted, docs.columns))


def keep_one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document that names its component stays. Of rows that repeat its id the
    smallest counts, by text, then by the other columns in order (maps left out), so
    every run keeps the same one. Rows without an id can't be told apart by it and stay.
    An empty table gives no rows."""
    found = simhash.near_duplicates(docs, "doc_id", "text")
    kept = found.where("doc_id = component_id").select("doc_id")
    rest = [f.name for f in docs.schema if f.name not in ("doc_id", "text") and not isinstance(f.dataType, T.MapType)]
    smallest = F.min_by(F.struct(*map(quoted, docs.columns)), F.struct("text", *map(quoted, rest)))
    # Both meet by id, which the rows have to do for the next step anyway.
    chosen = unsent(docs).join(unsent(kept), "doc_id", "left_semi").groupBy("doc_id").agg(smallest.alias("row"))
    return chosen.select("row.*").unionByName(docs.where("doc_id is null"))


def mask_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document stays; spans found in its text are masked and ``n_chars`` follows.
    Texts without a finding, empty and NULL ones included, stay as they are."""
    ledger = staged(secrets.scan_unseen(docs, "text"), "ledger")
    found = secrets.findings(docs, docs.columns, "text", ledger, into="__spans")
    masked = secrets.redacted(F.col("text"), F.col("__spans"))
    return (
        found.withColumn("text", masked)
        .withColumn("n_chars", F.when(F.size("__spans") > 0, F.char_length("text").cast("bigint")).otherwise(F.col("n_chars")))
        .select(*map(quoted, docs.columns))
    )


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A document taken by several epochs appears once for each."""
    taken = Q.mixed(docs)
    return taken.withColumn("epoch", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int")))).select(*map(quoted, docs.columns))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A row of token digests for each row; a NULL text counts as empty."""
    return Q.encoded(spark, docs)


STAGES = [
    ("toxicity", drop_toxic),
    ("simhash_near_dedup", keep_one_of_each),
    ("secret_scan", mask_secrets),
    ("source_mixing", mix_sources),
    ("byte_bpe", encode),
]

# A fitted model and a tokenizer are no SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages in order, each written and read again for the next."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = staged(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
