"""A pipeline of corpus operators: quality rules, near duplicates, secrets, source mix, packing."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from factloom.llm import mix, ngram_join, packing, quality_rules, secret_scan
from factloom.llm.common import stored


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the rules."""
    return quality_rules.kept(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates: that with the smallest doc_id."""
    return ngram_join.one_per_group(docs, ngram_join.Measure(words=5, percent=80))


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with each secret replaced by a mark."""
    return secret_scan.redacted(docs)


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix of all sources at their targets, as documents (a document that is taken twice comes twice)."""
    return mix.mixed_documents(mix.mix_sources(docs, block_words=256, shard_blocks=1024))


def sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the mix's documents and their places in fixed-length sequences."""
    return packing.pack(docs)


STAGES = [("quality_rules", quality), ("ngram_jaccard_join", near_duplicates), ("secret_scan", secrets), ("source_mix", source_mix), ("best_fit_packing", sequences)]
#: The mix draws pseudorandomly and the secrets stage compresses, which SQL cannot say; the tests check it stage by stage.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; what a stage returns is stored before the next reads it."""
    docs = spark.read.parquet(f"{sf_dir.rstrip('/')}/documents.parquet")
    for number, (_, stage) in enumerate(STAGES, 1):
        docs = stage(spark, docs, sf_dir)
        if number < len(STAGES):
            docs = stored(docs)
    return docs
