"""The corpus pipeline: documents through quality, near-duplicate, contamination and secret stages into packed sequences.

Every stage takes the session, its predecessor's documents and the folder of the tables; its result is stored and read again before the next.
Null texts count as empty ones, and whether they stay is the quality stage's decision; repeated rows are copies of each other, of which one stays;
null sources and languages pass as they are; the columns of documents pass all stages but the last; an empty table gives an empty one.  Ids are whole numbers.
"""

from __future__ import annotations

from granary.llm import decontaminate, near_dup, packing, quality, secret_crf
from granary.llm.shared import stash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier accepts."""
    return quality.keep_good(docs)


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates."""
    return near_dup.deduplicated(docs)


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item."""
    return decontaminate.keep_clean(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def secret_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with their secrets replaced, and their length counted again."""
    return secret_crf.redacted(docs).withColumn("n_chars", F.length("text").cast("long"))


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of 1024-token sequences."""
    return packing.pack(docs)


STAGES = [
    ("quality classifier", quality_stage),
    ("near duplicates", near_duplicate_stage),
    ("benchmark decontamination", decontamination_stage),
    ("secret scan", secret_stage),
    ("packing", packing_stage),
]

#: No SQL: the stages train models, verify sketches' candidates and tokenise; tests compare them with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (_, stage) in enumerate(STAGES):
        docs = stash(stage(spark, docs, sf_dir), f"stage{k}")
    return docs
