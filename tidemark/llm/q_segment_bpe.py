"""Query op11_segment_bpe; its result has no SQL, tests compare with the library."""

from __future__ import annotations

import hashlib

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from tidemark.llm.common import map_rows, table
from tidemark.llm.segment_bpe import encoded, segment_codec


def op11_segment_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = public_tokenizers.path("byte_bpe_50k.tiktoken")
    ids = encoded(table(spark, sf_dir, "documents"), path)

    def run(rows):
        own = segment_codec(path)
        return {
            "doc_id": rows["doc_id"],
            "n_tokens": [len(i) // 4 for i in rows["ids"]],
            "ids_sha256": [hashlib.sha256(own.written(i)).hexdigest() for i in rows["ids"]],
            "decoded_sha256": [hashlib.sha256(own.decode(i)).hexdigest() for i in rows["ids"]],
        }

    kind = ids.schema["doc_id"].dataType.simpleString()
    return map_rows(ids, ["doc_id", "ids"], f"doc_id {kind}, n_tokens bigint, ids_sha256 string, decoded_sha256 string", run)


QUERIES = {"op11_segment_bpe": op11_segment_bpe}
ORACLES: dict[str, str] = {}
