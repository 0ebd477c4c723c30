"""A training-data pipeline of five corpus operators over the documents.

Stages, in order: quality rules (rejected documents go), SimHash near-dedup (one document of each group
stays), surrogates for personal data, mixing of sources to target weights (no document is left out; documents of
small sources are repeated), and BPE tokens. Every stage but the last returns the columns of documents. The
result of each is written as Parquet to the shared folder and read again as the next one's input.

ORACLE_SQL is None: shingle similarity, surrogates and BPE have no SQL form. The pipeline is tested against a
brute-force version of its stages.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tidemark.llm import bpe, mixing, neardup, privacy, quality
from tidemark.llm.common import scratch, stored
from tidemark.llm.queries import SURROGATE_KEY
from tidemark.session import table


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality.quality_filter(docs)


def near_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return neardup.deduplicated(docs)


def privacy_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return privacy.anonymised(docs, SURROGATE_KEY)


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.mixed(docs)


def tokens_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, source, n_tokens, ids and the digest of the decoded text of every document that the mixture holds, as often as it does."""
    import public_tokenizers

    out = bpe.encoded(docs, public_tokenizers.path("word_bpe_49k.json"), into="bpe_", outputs=("n_tokens", "ids", "decoded_sha256"))
    return out.select("doc_id", "source", "bpe_.*")


STAGES = [
    ("quality rules", quality_stage),
    ("near-dedup", near_dedup_stage),
    ("surrogates", privacy_stage),
    ("temperature mixing", mixing_stage),
    ("BPE tokens", tokens_stage),
]
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents of a data folder through all stages."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        # What a stage stores on its way goes once its result is written.
        with scratch(spark, keep=1):
            docs = stored(stage(spark, docs, sf_dir), name.split()[0].lower())
    return STAGES[-1][1](spark, docs, sf_dir)
