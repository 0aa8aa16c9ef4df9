"""Corpus preparation in five stages: toxic documents go, one of each near-duplicate group stays, secrets are masked,
sources are mixed to their weights, and the texts become piece ids.

Each stage takes (spark, docs, sf_dir) and works on all documents that its predecessor kept; every stage but the last returns the
columns of documents. run() writes each stage's result to the shared folder and reads it back for the next.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexloom.llm import contracts, mixing, pieces, secrets, simhash, toxicity
from lexloom.llm.common import stored
from lexloom.session import table


def remove_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity model, fitted without the held-out labels, scores below 0.5."""
    labels = table(spark, sf_dir, "labels").where(~contracts.held_out(F.col("doc_id")))
    scored = toxicity.score_toxicity(docs, toxicity.fit_toxicity(docs, labels), passages=False)
    return scored.where(F.col("tox_score") < 0.5).select(*docs.columns)


def remove_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest id of each SimHash component."""
    return simhash.deduplicated(docs)


def mask_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document, with its secrets masked and n_chars counted anew."""
    found = secrets.secrets(docs)
    text = F.when(F.size("spans") > 0, secrets.redacted(F.col("text"), F.col("spans"))).otherwise(F.col("text"))
    masked = found.withColumn("text", text)
    n_chars = F.when(F.size("spans") > 0, F.char_length("text").cast("long")).otherwise(F.col("n_chars"))
    return masked.withColumn("n_chars", n_chars).select(*docs.columns)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix of the sources: each document as often as it is taken."""
    return mixing.mix(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, source, n_pieces and piece_ids (little-endian uint32) of every row of the mix."""
    rows = pieces.encode_pieces(docs, contracts.PIECES, keep=("doc_id", "source"))
    return rows.withColumn("n_pieces", (F.octet_length("piece_ids") / 4).cast("long")).select("doc_id", "source", "n_pieces", "piece_ids")


STAGES = [
    ("toxicity", remove_toxic),
    ("near_dedup", remove_near_duplicates),
    ("secrets", mask_secrets),
    ("mixing", mix_sources),
    ("pieces", encode),
]

#: The toxicity model, XXH64 fingerprints and the piece coder have no SQL form; tests hold run() against a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
