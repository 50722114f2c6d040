"""First load: reconcile a dump with the ids that should exist."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.plans.reduce import highest_revision
from tidemark.schemas import KEY, entity_type

# Fixed value: ids beyond the latest known one that a first load still covers.
END_MARGIN = 100

# Ids of the spine that a task reconciles.
TASK_IDS = 1 << 17


def id_spine(spark: SparkSession, ty: str, lo: int, hi: int) -> DataFrame:
    """Every id from ``lo`` to ``hi`` of a type."""
    return spark.range(lo, hi + 1).select(
        F.lit(entity_type(ty).name).alias("entity_type"), F.col("id").alias("entity_num")
    )


def bootstrap_end(latest_num: int) -> int:
    return latest_num + END_MARGIN


def resume_from(dump: DataFrame, lo: int) -> DataFrame:
    """Dump rows that a load resumed at id ``lo`` still needs."""
    return dump.where(F.col("entity_num") >= lo)


def one_per_entity(entities: DataFrame) -> DataFrame:
    """Repeated entities reduced to the highest revision, of equal ones the greatest body."""
    return highest_revision(entities.select(*KEY, "revision", "data"), KEY)


def missing_ids(spine: DataFrame, dump: DataFrame) -> DataFrame:
    """Ids of the spine the dump does not have."""
    return spine.join(dump.select(*KEY), list(KEY), "left_anti")


def reconcile(spine: DataFrame, dump: DataFrame, content: DataFrame) -> DataFrame:
    """One entity per spine id: the dump's row, else the looked-up content, else nothing.

    Dump rows outside the spine are dropped. Content may have several revisions of an entity, as the feed
    asks for them; the highest counts. Adds ``origin`` (dump or lookup). Which ids are missing is found on the
    narrow keys, and only the content of those is reduced. Ids are dealt to as many tasks as the spine needs, so that what a
    task sorts does not grow with it.
    """
    key = list(KEY)
    tasks = max(spine.sparkSession.sparkContext.defaultParallelism, -(-spine.count() // TASK_IDS))
    spine = spine.repartition(tasks, "entity_num")  # joins deal their other side alike
    dumped = one_per_entity(dump.join(spine, key, "left_semi"))
    looked_up = one_per_entity(content.join(missing_ids(spine, dump), key, "left_semi"))
    columns = [*key, "revision", "data"]
    return dumped.select(*columns, F.lit("dump").alias("origin")).unionByName(
        looked_up.select(*columns, F.lit("lookup").alias("origin"))
    )
