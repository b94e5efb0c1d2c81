"""The registered query of each operator, and the DuckDB statement of those that SQL can express."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rxncurate.llm import bpe, exact_dedup, jaccard_join, mixing, phrases, ppm, quality, search, sharding, simhash, surrogates, token_files, toxicity
from rxncurate.llm.common import documents
from rxncurate.llm.oracles import ORACLE  # noqa: F401

#: The key of registered runs; a real run takes its own secret.
SURROGATE_KEY = b"example key, not a secret"
SHARDS = tuple(f"shard-{k:03d}" for k in range(64))


def exact_dedup_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_duplicates(documents(spark, sf_dir)).select("doc_id", "keep_id", "group_size", "kept", "text_sha256")


def source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mixed_sizes(documents(spark, sf_dir)).select("doc_id", "size", "source_size", "target", "taken")


def lookup_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.assign_shards(documents(spark, sf_dir).select("doc_id"), "doc_id", SHARDS).select("doc_id", F.col("shard_slot").alias("slot"), "shard")


def _tokenizer(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def _labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/labels.parquet")


def token_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_files.token_files(documents(spark, sf_dir), _tokenizer("word_bpe_49k.json"))


def ppm_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ppm.score_documents(documents(spark, sf_dir))


def prefix_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.encode_documents(documents(spark, sf_dir), _tokenizer("byte_bpe_50k.json"))


def jaccard_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.near_components(documents(spark, sf_dir))


def quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    trusted = _labels(spark, sf_dir).where("quality = 1").select("doc_id")
    return quality.apply_rules(documents(spark, sf_dir), trusted).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "score")


def toxicity_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.toxicity_scores(documents(spark, sf_dir), _labels(spark, sf_dir))


def surrogate_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return surrogates.replace_entities(documents(spark, sf_dir), SURROGATE_KEY)


def dual_tree_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.rank_documents(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def phrase_automata(spark: SparkSession, sf_dir: str) -> DataFrame:
    return phrases.mine_phrases(documents(spark, sf_dir))


def simhash_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_components(documents(spark, sf_dir))


QUERIES = {
    "op1_surrogates": surrogate_texts,
    "op2_token_blocks": token_blocks,
    "op3_exact_dedup": exact_dedup_index,
    "op4_ppm": ppm_scores,
    "op5_prefix_bpe": prefix_bpe,
    "op6_jaccard_join": jaccard_components,
    "op7_quality_rules": quality_rules,
    "op8_source_mixing": source_mixing,
    "op9_toxicity": toxicity_model,
    "op10_lookup_sharding": lookup_sharding,
    "op11_dual_tree_search": dual_tree_search,
    "op12_phrase_automata": phrase_automata,
    "op13_simhash_trie": simhash_components,
}
