"""From raw documents to token ids in five stages, each stored before the next one reads it.

Every stage works on all rows that its predecessor kept, and all but the last return the columns of `documents`
(and any further ones that came in, whatever their names, with their values). Null texts count as empty and are kept
as they are. What a stage writes on its way, and the table that it read, are deleted once its output is stored.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from riskloom.llm import byte_bpe, decontamination, secrets, simhash, toxicity
from riskloom.llm.rows import documents, table
from riskloom.session import remove, scratch_path, temporaries


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the nearest labelled examples do not call toxic (score below 0.5)."""
    labels = table(spark, sf_dir, "labels").where(~toxicity.held_out("doc_id")).select("doc_id", "toxic")
    return toxicity.without_toxic(docs, toxicity.fit(docs, labels))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies: the one with the smallest id. Groups are those of SimHashes of three-word
    shingles that differ by two bits or fewer from one to the next."""
    return simhash.deduplicate(docs, radius=2, words=3)


def drop_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which no item of `benchmark` is found."""
    return decontamination.decontaminate(docs, table(spark, sf_dir, "benchmark"))


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with secrets replaced in their texts."""
    return secrets.redact(docs, secrets.fit(docs))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of each document, their number and hash, and the hash of the bytes that they decode to."""
    return byte_bpe.encode_documents(docs, public_tokenizers.path(byte_bpe.RANKS), keep=["doc_id"])


STAGES = [
    ("toxicity", drop_toxic),
    ("simhash_near_dedup", drop_near_copies),
    ("benchmark_decontamination", drop_benchmark),
    ("secret_scan", redact_secrets),
    ("byte_bpe", encode),
]

ORACLE_SQL = None  # tokenizer, learnt models and hashes are beyond SQL; see tests/llm


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, before = documents(spark, sf_dir), None
    for name, stage in STAGES:
        path = scratch_path(spark, name)
        with temporaries(spark):
            out = stage(spark, docs, sf_dir)
            out.write.parquet(path)
        if before:
            remove(spark, before)
        docs, before = spark.read.schema(out.schema).parquet(path), path
    return docs
