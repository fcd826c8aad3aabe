"""From raw documents to packed sequences: each stage reads what the one before it kept, written as Parquet."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from glyphward.llm.exact_dedup import survivors
from glyphward.llm.mixing import mix
from glyphward.llm.ngram_join import one_of_each
from glyphward.llm.packing import pack
from glyphward.llm.quality_classifier import accepted, fit
from glyphward.llm.shared import documents, shared_dir, written


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier rejects go."""
    shared_dir(spark)
    return accepted(docs, fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts one document stays, the one with the largest id."""
    return survivors(docs)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each class of near-duplicates one document stays."""
    return one_of_each(docs)


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix of sources takes it."""
    return mix(docs)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of the packed sequences."""
    return pack(docs)


STAGES = [("quality", quality), ("exact", exact), ("near", near), ("mixed", mixed), ("packed", packed)]

#: Learned weights, minimal hashes and a tokenizer are beyond SQL; tests/llm holds the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
