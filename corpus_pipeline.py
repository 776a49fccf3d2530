"""Corpus cleaning and packing: five stages, each on all that the one before it kept.

Each stage is a function of (spark, docs, sf_dir), where docs has the columns of `documents`; all but the last return
those columns. run() writes each stage's rows to the shared folder and reads them back as the next one's docs.

Defined cases, of every stage: an empty table gives an empty table; null and empty texts have no words, no secrets and
no windows, and are packed as their end id; texts of any length are read whole; rows that are repeated are decided
alike; a null doc_id is kept as such; further columns, whatever their names, go with their rows (the last stage returns
pieces alone).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from planeworks.llm import op3_packing, op5_simhash, op8_decontaminate, op9_secrets, op10_toxicity
from planeworks.llm.text import shared_dir


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the ordinal model rejects go. Null and empty texts have no features, and are rejected only if a text
    without any is; without labels of both classes nothing goes."""
    model = op10_toxicity.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return op10_toxicity.drop_toxic(docs, model)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of linked fingerprints the document with the least doc_id stays, with all rows of that id; rows without a
    doc_id stay. Texts without words are one group."""
    return op5_simhash.keep_one(docs)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a window of a benchmark item go, all rows of the same id and text alike. An empty benchmark
    removes nothing."""
    return op8_decontaminate.drop_contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets are masked; every row stays, and texts without secrets as they were."""
    return op9_secrets.redact(docs)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents in sequences, with their ids' checksum; every row's ids are packed, repeated or not."""
    return op3_packing.digests(op3_packing.pack_documents(docs))


STAGES = [("toxicity", toxicity), ("near_duplicates", near_duplicates), ("decontaminate", decontaminate), ("secrets", secrets), ("packing", packing)]

#: SQL cannot express the stages; tests/llm/test_pipeline.py holds them against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        folder = shared_dir(spark, f"stage-{name}")
        stage(spark, docs, sf_dir).write.parquet(folder)
        docs = spark.read.parquet(folder)
    return STAGES[-1][1](spark, docs, sf_dir)
