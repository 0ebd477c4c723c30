"""The corpus operators' registered queries: each applies its operator to the whole of its table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tidemark.llm import alignment, bitslice, bpe, chat, mixing, oracles, packing, prefixbpe, privacy, quality, resampling, sharding, simhash, toxicity
from tidemark.session import table


#: The key of the surrogates in the registered query and the pipeline; production passes its own.
SURROGATE_KEY = "tidemark"


def op1_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents as packed rows of 2,048 tokens under the 50k byte-level vocabulary."""
    import public_tokenizers

    return packing.packed(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.tiktoken"))


def op2_perspective_rotation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every conversation from every participant's side."""
    return chat.rotation_report(table(spark, sf_dir, "conversations"))


def op3_bit_sliced_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten best rows of each hundredth vector."""
    return bitslice.top_k(table(spark, sf_dir, "embeddings"))


def op4_temperature_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents taken for a budget of all tokens, at 95 % of the greatest entropy, each at most four times."""
    return mixing.mixture(table(spark, sf_dir, "documents"))


def op5_hilbert_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in 16 shards cut from the Hilbert order; law ``rows``."""
    return sharding.shard_report(table(spark, sf_dir, "documents"))


def op6_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts and verdict of every document."""
    return quality.quality_counts(table(spark, sf_dir, "documents"))


def op7_simhash_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprint and component of every document."""
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


def op8_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token counts and digests of every document under the 49k-word vocabulary."""
    import public_tokenizers

    return bpe.token_digests(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Score and verdict of every document."""
    return toxicity.toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op10_surrogates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's text with surrogates for personal data."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return privacy.anonymised(docs, SURROGATE_KEY, n_entities="n_entities")


def op11_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Weight and score of every document for the benchmark's words, and the rank of the twentieth that is drawn."""
    return resampling.resampled(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op12_prefix_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token counts and digests of every document under the 50k byte-level vocabulary."""
    import public_tokenizers

    return prefixbpe.token_digests(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


def op13_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links and groups of every document's tokens under the byte-level and the sentence-piece vocabulary."""
    import public_tokenizers

    return alignment.digests(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    every = (
        op1_best_fit_packing,
        op2_perspective_rotation,
        op3_bit_sliced_top_k,
        op4_temperature_mixing,
        op5_hilbert_sharding,
        op6_quality_rules,
        op7_simhash_near_duplicates,
        op8_bpe,
        op9_toxicity,
        op10_surrogates,
        op11_importance_resampling,
        op12_prefix_bpe,
        op13_token_alignment,
    )
    return {f.__name__: f for f in every}


def oracle_sql() -> dict[str, str]:
    return {"op2_perspective_rotation": chat.ORACLE, "op3_bit_sliced_top_k": oracles.TOP_K, "op4_temperature_mixing": oracles.MIXTURE, "op6_quality_rules": oracles.QUALITY, "op11_importance_resampling": oracles.RESAMPLING}
