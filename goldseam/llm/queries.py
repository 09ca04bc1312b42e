"""The registered queries of this package and, where SQL can say it, their SQL twins."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from goldseam.llm import (
    exact_dedup,
    jaccard_join,
    merkle,
    packing,
    pareto_mix,
    passage_dedup,
    piecewise_hash,
    prefix_trie,
    private_data,
    rule_quality,
    secrets,
    twins,
    url_filter,
    weak_rules,
)
from goldseam.llm.common import load


def tokenizer_file() -> str:
    """The public byte-level BPE that the contract names."""
    import public_tokenizers

    return str(public_tokenizers.path("byte_bpe_50k.json"))


def op1_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pareto_mix.mixed_sizes(load(spark, sf_dir, "documents"))


def op2_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    return piecewise_hash.fingerprints(load(spark, sf_dir, "documents"))


def op3_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.find_secrets(load(spark, sf_dir, "documents"))


def op5_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.judge_urls(load(spark, sf_dir, "pages"))


def op4_drop_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return passage_dedup.drop_repeats(load(spark, sf_dir, "documents"))


def op6_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(load(spark, sf_dir, "documents"), tokenizer_file())


def op7_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rule_quality.quality_scores(load(spark, sf_dir, "documents"), load(spark, sf_dir, "labels"))


def op8_private_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    return private_data.find_private_data(load(spark, sf_dir, "documents"))


def op10_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.jaccard_join(load(spark, sf_dir, "documents"))


def op9_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_duplicates(load(spark, sf_dir, "documents"))


def op11_votes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return weak_rules.judge(load(spark, sf_dir, "documents"))


def op12_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_trie.prefix_trie(load(spark, sf_dir, "conversations"))


def op13_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merkle.manifest(load(spark, sf_dir, "documents"))


QUERIES = {
    "op1_mix": op1_mix,
    "op2_fingerprint": op2_fingerprint,
    "op3_secrets": op3_secrets,
    "op4_drop_repeats": op4_drop_repeats,
    "op5_urls": op5_urls,
    "op6_pack": op6_pack,
    "op7_quality": op7_quality,
    "op8_private_data": op8_private_data,
    "op9_exact_dedup": op9_exact_dedup,
    "op10_jaccard_join": op10_jaccard_join,
    "op11_votes": op11_votes,
    "op12_prefix_trie": op12_prefix_trie,
    "op13_manifest": op13_manifest,
}

ORACLE = {
    "op9_exact_dedup": """
        with normal as (
            select doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as t
            from documents)
        select doc_id, max(doc_id) over (partition by t) as keep_id, count(*) over (partition by t) as group_size,
               doc_id = max(doc_id) over (partition by t) as kept, sha256(t) as text_sha256
        from normal""",
    "op12_prefix_trie": twins.TRIE_SQL,
    "op13_manifest": twins.merkle_sql(),
}
