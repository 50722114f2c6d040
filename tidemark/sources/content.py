"""Content responses landed as a table: one row per asked entity and revision."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions.ids import format_id
from tidemark.functions.payload import RESPONSE_FIELDS, document_revision, only_object, parsed_objects
from tidemark.plans.local import local_table
from tidemark.plans.once import evaluated_once
from tidemark.schemas import KEY

CONTENT_SCHEMA = "entity_type STRING, entity_num BIGINT, requested_revision BIGINT, body STRING"

# Ids of a block of landed content: 16,384 bodies of some kilobytes make files of tens of megabytes.
BLOCK_BITS = 14


def read_content(spark: SparkSession, path: str, fmt: str = "parquet") -> DataFrame:
    return spark.read.schema(CONTENT_SCHEMA).format(fmt).load(path)


class ContentTable:
    """Landed content laid out by entity type and block of ids, so that a batch of changes reads its blocks alone.

        <path>/entity_type=<t>/id_block=<n>/*.parquet      rows sorted by id and asked revision

    Content is landed by appending, from any number of jobs. ``bits`` is a property of the table: it has to be the same
    for all that land and read it. Rows without a type or id go to partitions of their own and are never asked for.
    """

    columns = tuple(field.split()[0] for field in CONTENT_SCHEMA.split(", "))

    def __init__(self, spark: SparkSession, path: str, bits: int = BLOCK_BITS):
        self.spark, self.path, self.bits = spark, path.rstrip("/"), bits

    def land(self, content: DataFrame) -> None:
        """Append responses. A block that many of them fall into is split over tasks, each writing a file of its own."""
        block = F.shiftright("entity_num", self.bits).alias("id_block")
        keys = ["entity_type", "id_block", "entity_num", "requested_revision"]
        rows = content.select(*self.columns, block).repartitionByRange(*keys).sortWithinPartitions(*keys)
        rows.write.mode("append").partitionBy("entity_type", "id_block").parquet(self.path)

    def read(self) -> DataFrame:
        """All landed rows."""
        return self._rows([self.path])

    def _rows(self, paths: list[str]) -> DataFrame:
        reader = self.spark.read.schema(f"{CONTENT_SCHEMA}, id_block BIGINT").option("basePath", self.path)
        return reader.parquet(*paths).select(*self.columns)

    def _folders(self, blocks: dict[str, list[int]]) -> list[str]:
        """The folders of blocks that exist, looked up a thousand at a time."""
        jvm = self.spark.sparkContext._jvm
        base = jvm.org.apache.hadoop.fs.Path(self.path)
        fs = base.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())
        found = []
        for ty, numbers in blocks.items():
            for at in range(0, len(numbers), 1000):
                names = ",".join(map(str, numbers[at : at + 1000]))
                pattern = jvm.org.apache.hadoop.fs.Path(base, f"entity_type={ty}/id_block={{{names}}}")
                found += [status.getPath().toString() for status in fs.globStatus(pattern) or []]
        return found

    def asked(self, asked: DataFrame) -> DataFrame:
        """The rows for (entity_type, entity_num, requested_revision), out of the blocks that these fall into.

        The blocks are listed on the driver: no more than the batch has rows, and than the table has partitions.
        """
        blocks: dict[str, list[int]] = {}
        for ty, block in asked.select("entity_type", F.shiftright("entity_num", self.bits)).distinct().collect():
            blocks.setdefault(ty, []).append(block)
        folders = self._folders(blocks)
        if not folders:
            return local_table(self.spark, [], CONTENT_SCHEMA)
        return self._rows(folders).join(asked, [*KEY, "requested_revision"], "left_semi").select(*self.columns)


def extract_content(content: DataFrame) -> DataFrame:
    """(entity_type, entity_num, requested_revision, revision, data, raw, reason).

    A response without the asked entity (empty, or a redirect to another one) gives no row. A document
    without a usable revision carries a reason.
    """
    asked = format_id(F.col("entity_type"), F.col("entity_num"))
    answers = evaluated_once(content, answers=parsed_objects(F.col("body"), RESPONSE_FIELDS))
    document = only_object(F.col("answers"))["entities"][asked]
    found = evaluated_once(answers, data=document).where(F.col("data").isNotNull())
    read = evaluated_once(found, revision=document_revision(F.col("data")))
    return read.select(
        "entity_type",
        "entity_num",
        "requested_revision",
        "revision",
        "data",
        F.col("body").alias("raw"),
        F.when(F.col("revision").isNull(), "bad_revision").alias("reason"),
    )
