"""Corpus pipeline: from documents to packed sequences.

Each stage is a function of (spark, docs, sf_dir); its result is written as Parquet and reread as
the next one's docs.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from cellweave.llm import fertility, jaccard_join, line_dedup, mixing, packing
from cellweave.llm.common import materialize


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents within their language's bands of tokeniser fertility; the others go."""
    return fertility.keep_good(docs, public_tokenizers.path("piece_bpe_32k.model"))


def dedup_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without lines that stand earlier; those left without a line go."""
    return line_dedup.dedup_lines(docs, drop_emptied=True, counts=False)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group linked by five-word shingles at a similarity of 0.8."""
    return jaccard_join.one_of_each(docs, width=5, percent=80)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents repeated or cut so that sources meet their targets."""
    return mixing.mixed_documents(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Power-of-two pieces with their token ids."""
    return packing.pack_power_of_two(docs, public_tokenizers.path("byte_bpe_50k.json"))


STAGES = [("quality rules", quality_rules), ("line dedup", dedup_lines), ("n-gram Jaccard join", near_duplicates), ("mixing", mix_sources), ("packing", pack)]

#: Tokenisers and hashed draws have no SQL form; tests/llm/test_pipeline.py holds the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES:
        docs = materialize(stage(spark, docs, sf_dir), "pipeline")
    return docs
