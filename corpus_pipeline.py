"""The corpus pipeline: quality, near-duplicates, secrets, mix, token ids.

Each stage takes the documents that its predecessor kept, is written as Parquet and read again.
``ORACLE_SQL`` is None: SQL cannot express the trained models and the tokenizer; the tests hold each
stage against a brute-force version.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from priceshape.llm import mixing, quality, secrets, simhash, tree_bpe
from priceshape.llm.common import table
from priceshape.scratch import pin

ORACLE_SQL = None


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop the documents that the quality classifier rejects."""
    model = quality.train(docs, table(spark, sf_dir, "labels"))
    return quality.keep_quality(docs, model)


def near_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep the smallest doc_id of each group of fingerprints linked at 3 bits or fewer (three-word shingles)."""
    return simhash.drop_near_duplicates(docs)


def secrets_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replace secrets; every document stays."""
    return secrets.redact(docs, secrets.fit(secrets.scan(docs)))


def mix_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeat documents as the mix of the sources takes them."""
    return mixing.mixed_documents(docs)


def bpe_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every document of the mix, as digests."""
    return tree_bpe.digest(docs, public_tokenizers.path("byte_bpe_50k.json"))


STAGES = [
    ("quality", quality_stage),
    ("near_dedup", near_dedup_stage),
    ("secrets", secrets_stage),
    ("mix", mix_stage),
    ("bpe", bpe_stage),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = pin(stage(spark, docs, sf_dir), name)
    return docs
