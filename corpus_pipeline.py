"""A training corpus from raw documents in five stages: quality, near-duplicates, benchmark, mix, token shards.

Every stage takes (spark, docs, sf_dir) and works on all that the one before kept; all but the last
return the columns of ``docs``. Null texts count as empty and null ids as values of their own; what
each stage makes of ties, repeated rows and empty tables is stated in its operator's module. Extra
columns of the documents pass through to the last stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from biascomp.llm import decontaminate, mixing, quality, simhash, tokenshards
from biascomp.llm.common import written


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier accepts; it learns from the labelled documents among them."""
    return quality.accepted(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of every SimHash group (three-word shingles, two bits): the one with the smallest id."""
    return simhash.near_dedup(docs, shingle=simhash.SHINGLE, max_bits=simhash.MAX_BITS)


def benchmark_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no window of a benchmark item."""
    return decontaminate.decontaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document as often as the mix of sources takes it."""
    return mixing.mixed(docs)


def token_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The token shards, one row per sequence: slot, shard, place, documents and digest of its ids."""
    return tokenshards.sequences(docs)


STAGES = [
    ("quality classifier", quality_stage),
    ("SimHash near-dedup", near_duplicate_stage),
    ("benchmark decontamination", benchmark_stage),
    ("source mixing", mixing_stage),
    ("token shards", token_stage),
]

#: No SQL: boosted trees, XXH64 and byte-pair ids are beyond it; the tests hold plain versions beside it.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
