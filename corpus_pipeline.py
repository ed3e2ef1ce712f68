"""The corpus pipeline: from raw documents to a mixed training corpus, in five stages.

Every stage takes (spark, docs, sf_dir), works on all documents its predecessor kept and returns a DataFrame, which is written as Parquet and
read again as the next stage's documents. All stages but the last return the columns of documents.

1. language ID: documents without a letter, or whose language is not certain enough, go
2. near duplicates: of documents linked by a Jaccard similarity of 0.8 or more of their five-word shingles, found by SimHash, one stays
3. decontamination: passages of the benchmark are cut out of the texts; a document that is nothing else goes
4. secrets: credentials are replaced by a mark
5. mixing: the copies of documents in the mixed corpus, in the order of the mix, with the words to use of each
"""
from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from scanledger.llm import decontamination, language_id, mixing, secret_scan, simhash
from scanledger.staging import shared_folder


def known_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    judged = language_id.predict(docs, language_id.fit(docs), lang_col="_lang", score_col="_score", accepted_col="_accepted")
    return judged.filter("_accepted").select(*docs.columns)


def one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return simhash.drop_similar(docs, shingle=5, radius=22, similarity=0.8)


def without_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontamination.decontaminate(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def without_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return secret_scan.redact(docs)


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.mix(docs, keep=docs.columns)


STAGES = [("language_id", known_language), ("simhash_near_dedup", one_of_each), ("benchmark_decontamination", without_benchmark),
          ("secret_scan", without_secrets), ("source_mixing", mixed)]

ORACLE_SQL = None  # the stages learn a model, compare fingerprints and search an index, which SQL cannot say; tests/llm compares by brute force


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents; the output of each is written to the shared folder before the next reads it."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    folder = f"{shared_folder(spark).rstrip('/')}/corpus-{uuid.uuid4().hex}"
    for name, stage in STAGES[:-1]:
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
