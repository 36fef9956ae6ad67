"""The corpus pipeline: stages that each apply one training-data operator.

A stage is ``(spark, docs, sf_dir) -> DataFrame``; its rows are written as
Parquet to the shared folder and read again as the next stage's documents. All
stages but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from creditspark.llm import catalogue, mixing, neardup, packing, secretscan, toxicity
from creditspark.llm.shared import discard, folder, table


def reject_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents predicted toxic go; the others stay as they are."""
    return toxicity.accept(docs, table(spark, sf_dir, "labels"))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group stays: five-word shingles, similarity 0.8."""
    return neardup.without_copies(docs, words=5, s=0.8)


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets are masked, the documents stay; n_chars follows the new text, and
    stays as it is where the text is null."""
    redacted = secretscan.redact(docs)
    length = F.coalesce(F.length("text"), F.col("n_chars")).cast(docs.schema["n_chars"].dataType)
    return redacted.withColumn("n_chars", length).select(*docs.columns)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as their source's target weight asks for."""
    return mixing.mixed_documents(docs)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each row's ids in pieces, placed in sequences of at most 2048 ids."""
    return packing.pack_documents(docs, catalogue.tokenizer_path(), catalogue.END_ID, packing.CAPACITY)


STAGES = [
    ("toxicity", reject_toxic),
    ("near_duplicates", drop_near_duplicates),
    ("secrets", redact_secrets),
    ("mixing", mix_sources),
    ("packing", pack_sequences),
]

# Classifiers, randomness tests and tokenizers have no SQL; tests/llm holds the
# stages against brute-force versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages, one after another, over the documents of ``sf_dir``. A stage's
    rows go once the next stage's are written; the last ones stay."""
    docs = table(spark, sf_dir, "documents")
    written, before = folder(spark, "pipeline"), None
    for k, (name, stage) in enumerate(STAGES):
        path = f"{written}/{k}-{name}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
        if before:
            discard(spark, before)
        before = path
    return docs
