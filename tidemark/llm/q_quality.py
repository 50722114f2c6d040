"""Query op4_quality; it has no SQL, tests measure held-out accuracy."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.common import Shared, table
from tidemark.llm.language_id import row_hash
from tidemark.llm.quality_crf import learn, scores


def held_out():
    return F.pmod(row_hash(), F.lit(3)) == 1


def trained(docs: DataFrame, labels: DataFrame) -> Shared:
    """The model of the labelled rows that are not held out."""
    return Shared(docs.sparkSession, learn(docs, labels.where(~held_out())))


def op4_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    found = scores(docs, trained(docs, table(spark, sf_dir, "labels")))
    return found.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


QUERIES = {"op4_quality": op4_quality}
ORACLES: dict[str, str] = {}
