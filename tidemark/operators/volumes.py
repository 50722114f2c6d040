"""Volumes: contiguous id ranges of one entity type with a raw-byte budget."""

from __future__ import annotations

from collections.abc import Sequence
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.plans.prefix import running_before
from tidemark.plans.stored import BROADCAST_ROWS

# Fixed value: raw bytes after which a volume is closed.
MAX_VOLUME_BYTES = 250 * 1024 * 1024

ROUTE_BITS = 16


def raw_size(data: Column) -> Column:
    """Bytes of a body in an export: its UTF-8 text and a newline."""
    return (F.octet_length(data) + 1).cast("bigint")


def cut_volumes(sizes: DataFrame, max_bytes: int = MAX_VOLUME_BYTES, bits: int = ROUTE_BITS) -> DataFrame:
    """Volume table (entity_type, volume_id, lo, hi, rows, raw_bytes, first_num, last_num).

    ``sizes`` has (entity_type, entity_num, raw_bytes). In id order, an entity belongs to the volume its
    first byte falls into, so a volume is below the budget plus its last entity. Ranges touch each
    other, the first starts at 1 (or at a smaller existing id) and the last one is open (hi is null).
    """
    placed = running_before(
        sizes.select("entity_type", "entity_num", "raw_bytes"),
        {"offset": (F.col("raw_bytes"), "sum")},
        "entity_num",
        partition=["entity_type"],
        bits=bits,
    )
    bucket = F.expr(f"offset div {max(max_bytes, 1)}L")
    cut = placed.groupBy("entity_type", bucket.alias("bucket")).agg(
        F.count("*").alias("rows"),
        F.sum("raw_bytes").alias("raw_bytes"),
        F.min("entity_num").alias("first_num"),
        F.max("entity_num").alias("last_num"),
    )
    # One row per volume from here on.
    in_order = Window.partitionBy("entity_type").orderBy("bucket")
    volume_id = F.row_number().over(in_order) - 1
    before = F.lag("last_num").over(in_order)
    after = F.lead("bucket").over(in_order)
    return cut.select(
        "entity_type",
        volume_id.cast("int").alias("volume_id"),
        F.coalesce(before + 1, F.least(F.lit(1).cast("bigint"), F.col("first_num"))).alias("lo"),
        F.when(after.isNotNull(), F.col("last_num")).alias("hi"),
        "rows",
        "raw_bytes",
        "first_num",
        "last_num",
    )


def volume_sizes(entities: DataFrame) -> DataFrame:
    return entities.select("entity_type", "entity_num", raw_size(F.col("data")).alias("raw_bytes"))


class RouteFacts(NamedTuple):
    """What routing knows of a volume table: its size once spread over blocks, and the open volumes, one per type."""

    size: int | None
    open: Sequence[tuple[str, int]]


def route(
    rows: DataFrame, volumes: DataFrame, broadcast_rows: int = BROADCAST_ROWS, facts: RouteFacts | None = None
) -> DataFrame:
    """Add the volume_id that is responsible for each row's entity.

    An id in no closed range belongs to the open volume. Ranges are looked up by block of ids, an
    equi-join, so the cost per row does not grow with the number of volumes. Who has the table at hand gives ``facts``.
    """
    first_block = F.shiftright("lo", ROUTE_BITS)
    last_block = F.shiftright(F.coalesce("hi", "lo"), ROUTE_BITS)
    is_open = F.col("hi").isNull()
    facts = facts or volumes.agg(
        F.sum(last_block - first_block + 1).alias("size"),
        F.collect_list(F.when(is_open, F.struct("entity_type", "volume_id"))).alias("open"),
    ).first()
    closed = volumes.where(~is_open)
    lookup = closed.select(
        "entity_type", "volume_id", "lo", "hi", F.explode(F.sequence(first_block, last_block)).alias("_block")
    )
    if (facts.size or 0) <= broadcast_rows:
        lookup = F.broadcast(lookup)
    # One candidate per range that touches the block; the range test is part of the join condition.
    left = rows.withColumn("_block", F.shiftright("entity_num", ROUTE_BITS)).alias("r")
    right = lookup.alias("v")
    inside = (
        (F.col("r.entity_type") == F.col("v.entity_type"))
        & (F.col("r._block") == F.col("v._block"))
        & F.col("r.entity_num").between(F.col("v.lo"), F.col("v.hi"))
    )
    fallback = F.lit(None).cast("int")
    for ty, volume_id in facts.open:
        fallback = F.when(F.col("r.entity_type") == ty, volume_id).otherwise(fallback)
    return left.join(right, inside, "left").select(
        *[F.col(f"r.{c}") for c in rows.columns],
        F.coalesce(F.col("v.volume_id"), fallback).alias("volume_id"),
    )


def volume_report(assigned: DataFrame) -> DataFrame:
    """Entities, first and last id and raw size per volume, from rows with a volume_id."""
    return assigned.groupBy("entity_type", "volume_id").agg(
        F.count("*").alias("rows"),
        F.min("entity_num").alias("first_num"),
        F.max("entity_num").alias("last_num"),
        F.sum("raw_bytes").alias("raw_bytes"),
    )


def initialized_up_to(volumes: DataFrame, initialized: DataFrame) -> DataFrame:
    """Per type, the id up to which the first load is stored.

    ``volumes`` is a volume table with ``last_num``; ``initialized`` has (entity_type, initialized).
    """
    per_type = volumes.groupBy("entity_type").agg(
        F.max("last_num").alias("last_num"), F.max("hi").alias("last_hi")
    )
    return per_type.join(F.broadcast(initialized), "entity_type").select(
        "entity_type",
        F.when(F.col("initialized"), F.col("last_num")).otherwise(F.col("last_hi")).alias("initialized_up_to"),
    )
