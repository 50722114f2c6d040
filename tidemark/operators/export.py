"""Sorted newline-JSON exports of one entity type, whole or for a range of ids."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.operators.volumes import MAX_VOLUME_BYTES, cut_volumes, raw_size, route
from tidemark.plans.local import local_table
from tidemark.plans.prefix import number_rows
from tidemark.schemas import entity_type_by_export_name

COMPRESSIONS = ("none", "gzip", "bzip2")


def pinned(table: DataFrame) -> DataFrame:
    """A volume table (one row per piece of the byte budget) computed once."""
    return local_table(table.sparkSession, table.collect(), table.schema)


def select_range(
    entities: DataFrame, export_name: str, lo: int | None = None, hi: int | None = None
) -> DataFrame:
    """Entities of the exported type with lo <= id <= hi; an unknown name is a ValueError."""
    chosen = entities.where(F.col("entity_type") == entity_type_by_export_name(export_name).name)
    if lo is not None:
        chosen = chosen.where(F.col("entity_num") >= lo)
    if hi is not None:
        chosen = chosen.where(F.col("entity_num") <= hi)
    return chosen


def export_lines(
    entities: DataFrame, export_name: str, lo: int | None = None, hi: int | None = None
) -> DataFrame:
    """The lines of an export with their position in it, as a table."""
    chosen = select_range(entities, export_name, lo, hi).where(F.col("data") != "")
    return number_rows(chosen.select("entity_num", "revision", "data"), "entity_num", out="position")


def write_volumes(tables: list[DataFrame], out: str, compression: str = "gzip") -> None:
    """Write lines (value, piece) of stored volumes below ``out``, a folder for each piece; path order is id order."""
    if compression not in COMPRESSIONS:
        raise ValueError(f"unknown compression: {compression}")
    for i, lines in enumerate(tables):
        writer = lines.write.mode("append" if i else "errorifexists").option("compression", compression)
        writer.partitionBy("piece").text(out)


def export(
    entities: DataFrame,
    export_name: str,
    out: str,
    lo: int | None = None,
    hi: int | None = None,
    compression: str = "gzip",
    piece_bytes: int = MAX_VOLUME_BYTES,
) -> int:
    """Write the export below ``out`` as text files whose name order is id order; returns their number.

    The pieces are cut by raw bytes from the narrow columns, then each piece is one partition: no
    sampling pass over the bodies, no task with more than one piece. Gzip pieces can be concatenated in
    name order. ``entities`` with a raw_bytes column spare reading the bodies for the cut.
    """
    if compression not in COMPRESSIONS:
        raise ValueError(f"unknown compression: {compression}")
    chosen = select_range(entities, export_name, lo, hi)
    if "raw_bytes" not in chosen.columns:
        chosen = chosen.withColumn("raw_bytes", raw_size(F.col("data")))
    chosen = chosen.where(F.col("raw_bytes") > 1)
    sizes = chosen.select("entity_type", "entity_num", "raw_bytes")
    pieces = pinned(cut_volumes(sizes, piece_bytes).select("entity_type", "volume_id", "lo", "hi"))
    count = max(pieces.count(), 1)
    rows = chosen.select("entity_type", "entity_num", "data")
    (
        route(rows, pieces)
        .repartitionById(count, F.col("volume_id"))
        .sortWithinPartitions("entity_num")
        .select(F.col("data").alias("value"))
        .write.option("compression", compression)
        .text(out)
    )
    return count
