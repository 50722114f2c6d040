"""Query op10_language_id; it has no SQL, tests measure held-out accuracy."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.common import Shared, table
from tidemark.llm.language_id import learn, predictions, row_hash


def held_out():
    return F.pmod(row_hash(), F.lit(4)) == 2


def trained(docs: DataFrame) -> Shared:
    """The model of the rows that are not held out."""
    return Shared(docs.sparkSession, learn(docs.where(~held_out()).select("doc_id", "lang", "text")))


def op10_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    found = predictions(docs, trained(docs))
    return found.select("doc_id", held_out().alias("held_out"), "lang_pred", "score")


QUERIES = {"op10_language_id": op10_language_id}
ORACLES: dict[str, str] = {}
