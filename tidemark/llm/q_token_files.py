"""Query op3_token_files; it has no SQL, tests compare with the library and hold round trips."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from tidemark.llm.common import table
from tidemark.llm.token_files import read, with_crc, written

END = 2


def op3_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = public_tokenizers.path("word_bpe_49k.json")
    return with_crc(read(spark, written(table(spark, sf_dir, "documents"), path, END)))


QUERIES = {"op3_token_files": op3_token_files}
ORACLES: dict[str, str] = {}
