"""Queries op6_bpe_codec and op7_token_counts; their results have no SQL, tests compare with the library."""

from __future__ import annotations

import hashlib

import numpy as np
import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from tidemark.llm.bpe_codec import codec, encoded
from tidemark.llm.common import map_rows, table
from tidemark.llm.token_count import token_counts

LIMIT = 1024


def digests(ids: DataFrame, path: str, keep_ids: bool = False) -> DataFrame:
    """Digests of ids and of the text they decode to, for rows (doc_id, ids); with ``keep_ids`` also the ids."""

    def run(rows):
        own = codec(path)
        arrays = [np.frombuffer(i, "<u4") for i in rows["ids"]]
        return {
            "doc_id": rows["doc_id"],
            "n_tokens": [len(a) for a in arrays],
            "ids_sha256": [hashlib.sha256(own.written(a)).hexdigest() for a in arrays],
            "decoded_sha256": [hashlib.sha256(own.decode(a).encode()).hexdigest() for a in arrays],
            "ids": rows["ids"],
        }

    kind = ids.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {kind}, n_tokens bigint, ids_sha256 string, decoded_sha256 string" + ", ids binary" * keep_ids
    return map_rows(ids, ["doc_id", "ids"], schema, run)


def op6_bpe_codec(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = public_tokenizers.path("byte_bpe_50k.json")
    return digests(encoded(table(spark, sf_dir, "documents"), path), path)


def op7_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    counts = token_counts(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))
    return counts.withColumn("over_limit", counts.n_tokens > LIMIT)


QUERIES = {"op6_bpe_codec": op6_bpe_codec, "op7_token_counts": op7_token_counts}
ORACLES: dict[str, str] = {}
