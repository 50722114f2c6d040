"""The corpus pipeline: documents in, tokenized clean documents out.

Each stage works on all that the one before kept; all but the last return rows of ``documents`` unchanged.
Nulls in any column are kept as they are; a null or empty text has no language and goes in the first stage.
Further columns of ``documents`` pass through. An empty table passes every stage.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from tidemark.llm import q_bpe, q_language_id, q_quality
from tidemark.llm.bpe_codec import encoded
from tidemark.llm.common import table
from tidemark.llm.decontaminate import decontaminated
from tidemark.llm.language_id import identified
from tidemark.llm.ngram_join import deduplicated
from tidemark.llm.quality_crf import good
from tidemark.session import fresh_path


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without letters, or of no language with a posterior of 0.5, go."""
    return identified(docs, q_language_id.trained(docs))


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the line field scores below 0.5 go."""
    return good(docs, q_quality.trained(docs, table(spark, sf_dir, "labels")))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each component of linked documents the one with the smallest doc_id stays."""
    return deduplicated(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a passage of a benchmark item go."""
    return decontaminated(docs, table(spark, sf_dir, "benchmark"))


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256, ids), ids as little-endian unsigned 32-bit integers."""
    path = public_tokenizers.path("byte_bpe_50k.json")
    return q_bpe.digests(encoded(docs, path), path, keep_ids=True)


STAGES = [
    ("language ID", language),
    ("quality classifier", quality),
    ("n-gram Jaccard join", near_duplicates),
    ("benchmark decontamination", decontamination),
    ("BPE encoding and decoding", tokens),
]

# Fitted models decide the first two stages, which SQL cannot express; tests hold the rest against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages one after the other, each written and reread."""
    docs = table(spark, sf_dir, "documents")
    for i, (_, stage) in enumerate(STAGES):
        path = fresh_path(spark, f"corpus-{i}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
