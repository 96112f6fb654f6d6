"""Corpus pipeline over ``documents``: quality rules, near-duplicates, secrets, packing.

Each stage is a function of (spark, docs, sf_dir) that returns a DataFrame; it is written as Parquet and read
again as the next stage's docs.  All but the last return the columns of documents:

* quality: documents that the rules reject go;
* near_dedup: one document of each near-duplicate class stays;
* secrets: found secrets are masked in the text, n_chars follows;
* packing: the pieces of all remaining documents in sequences.

Part of retailkit.llm.  SQL can't express the stages (perplexity, signatures, entropy, tokens), so ORACLE_SQL is None.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from retailkit.llm import near_dup, packing, quality, secret_scan
from retailkit.session import ensure_checkpoint_dir


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality.keep_good(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return near_dup.keep_one(docs)


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return secret_scan.redact(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    import public_tokenizers
    return packing.pack_documents(docs, public_tokenizers.path("byte_bpe_50k.json"))


STAGES = [("quality rules", quality_rules), ("near-dedup", near_dedup), ("secret scan", secrets), ("packing", pack)]
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    folder = f"{ensure_checkpoint_dir(spark).rstrip('/')}/pipeline-{uuid.uuid4().hex}"
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs.write.parquet(f"{folder}/{i}")
            docs = spark.read.parquet(f"{folder}/{i}")
    return docs
