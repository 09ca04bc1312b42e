"""From raw documents to packed sequences: five stages, each one operator of goldseam.llm."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from goldseam.llm import exact_dedup, jaccard_join, packing, pareto_mix, rule_quality
from goldseam.llm.common import load, remove
from goldseam.llm.queries import tokenizer_file
from goldseam.session import scratch_path


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the rule ensemble rejects go."""
    return rule_quality.keep_good(docs, load(spark, sf_dir, "labels"))


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the row with the largest doc_id stays."""
    return exact_dedup.keep_last(docs)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near duplicates the document with the least doc_id stays."""
    return jaccard_join.keep_one(docs)


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as their source's target asks: up to twice, or not at all."""
    return pareto_mix.mix(docs)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces and their places in sequences of 1024 tokens."""
    return packing.pack(docs, tokenizer_file())


STAGES = [
    ("quality classifier", quality),
    ("exact dedup", exact),
    ("n-gram Jaccard join", near),
    ("mixing to weights", mixture),
    ("best-fit packing", packed),
]

#: Fitted rules, MinHash and byte-pair encoding are not SQL; tests compare each stage with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; what a stage returns is written, read again by the next, and dropped when that is written."""
    docs, before = load(spark, sf_dir, "documents"), None
    for number, (_, stage) in enumerate(STAGES):
        path = scratch_path(spark, f"pipeline-{number}")
        stage(spark, docs, sf_dir).write.parquet(path)
        if before:
            remove(spark, before)
        docs, before = spark.read.parquet(path), path
    return docs
