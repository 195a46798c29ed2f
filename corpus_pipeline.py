"""A training corpus in five stages: quality rules, near duplicates, personal data, source mix, packed sequences.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame. ``run`` writes the result of each stage as Parquet to the
shared folder and reads it again as the next one's documents.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from roadweave.llm import mixing, ngram_join, packing, pii, quality_rules
from roadweave.session import Scratch


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that pass every quality rule."""
    return quality_rules.keep(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, the one with the smallest id, null ids last, of every group that n-gram links join.

    Documents without words link with nothing and stay.
    """
    return ngram_join.keep_one(docs)


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents with personal data replaced by its kind."""
    return pii.redact(docs, pii.fit(docs))


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents, or runs of their words, as often as the mix of sources takes them."""
    return mixing.mixed_documents(docs)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of the training sequences."""
    return packing.pack(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [
    ("quality_rules", quality),
    ("ngram_join", near_duplicates),
    ("pii", personal_data),
    ("mixing", source_mix),
    ("packing", packed),
]

#: Tokenisation and the drawn mix have no SQL form; the stages are tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, scratch = spark.read.parquet(f"{sf_dir}/documents.parquet"), Scratch(spark, "pipeline")
    for _, stage in STAGES[:-1]:
        # The documents of the stage before are deleted once these are written.
        docs = scratch.put("documents", stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
