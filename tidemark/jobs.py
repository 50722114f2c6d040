"""The three jobs of the service: first load, continuous update, dump."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from tidemark.functions.position import decode_position, position_ts_ms
from tidemark.operators.bootstrap import bootstrap_end, id_spine, reconcile, resume_from
from tidemark.operators.export import export, write_volumes
from tidemark.operators.metrics import start_position as start_position_of
from tidemark.operators.volumes import initialized_up_to
from tidemark.plans.local import local_table
from tidemark.schemas import entity_type_by_export_name
from tidemark.sources.content import ContentTable
from tidemark.sources.feed import ALL_TYPES
from tidemark.sources.store import EntityStore
from tidemark.streaming.apply import resume_feed, run_stream


def first_load(
    store: EntityStore,
    ty: str,
    latest_num: int,
    start_position: str,
    content: DataFrame,
    dump: DataFrame | None = None,
    lo: int = 1,
) -> int:
    """Load every id of a type up to a margin beyond ``latest_num``, and publish a version.

    Ids come from the dump, or from the looked-up content where the dump has none (all of them without a
    dump). ``start_position`` is where the feed takes over: the dump's own, or the feed's head taken
    before the load. With ``lo``, stored entities below it are kept and the rest is loaded; the feed then
    takes over at the earlier of the stored and the given position, since the kept entities need it. Content
    may have several revisions of an entity.
    """
    spark = store.spark
    spine = id_spine(spark, ty, lo, bootstrap_end(latest_num))
    rows = content.limit(0).select("entity_type", "entity_num", "revision", "data") if dump is None else dump
    loaded = reconcile(spine, resume_from(rows, lo), content).drop("origin")
    if lo > 1:
        loaded = loaded.unionByName(store.read([ty], hi=lo - 1).select(*loaded.columns))
    offered = decode_position(F.col("position"))
    at = local_table(spark, [(ty, start_position)], "entity_type STRING, position STRING")
    held = store.progress().where((F.col("entity_type") == ty) & F.col("last_event_id").isNotNull())
    if lo > 1 and not held.isEmpty():
        at = start_position_of(held.withColumn("position", F.lit(start_position)), offered)
    else:
        at = at.withColumn("last_event_id", offered)
    at = at.withColumn("last_event_ts_ms", position_ts_ms(F.col("last_event_id")))
    return store.load(loaded, at.select("entity_type", "last_event_id", "last_event_ts_ms"))


def stored_up_to(store: EntityStore) -> DataFrame:
    """Per type, the id up to which the first load is stored, and the last position."""
    progress = store.progress()
    return initialized_up_to(store.manifest(), progress.select("entity_type", "initialized")).join(
        progress.select("entity_type", "last_event_id", "last_event_ts_ms"), "entity_type"
    )


def follow(
    store: EntityStore,
    feed: DataFrame,
    content: DataFrame | ContentTable,
    wiki: str,
    stream_id: str,
    checkpoint: str,
    types: Sequence[str] = ALL_TYPES,
    trigger: dict | None = None,
) -> StreamingQuery:
    """Keep the store current from the stored position on."""
    return run_stream(store, resume_feed(store, feed, types=types), content, wiki, stream_id, checkpoint, types, trigger)


def dump(
    store: EntityStore,
    export_name: str,
    out: str,
    lo: int | None = None,
    hi: int | None = None,
    compression: str = "gzip",
    piece_bytes: int | None = None,
    version: int | None = None,
) -> int:
    """Write the sorted dump of a type, or of a range of its ids, from one version of the store; returns the pieces.

    Stored volumes go out as they are, a folder ``piece=<volume>`` for each; path order is id order. With
    ``piece_bytes`` they are cut anew by raw bytes, into files below ``out`` itself.
    """
    ty = entity_type_by_export_name(export_name).name
    if piece_bytes is None:
        tables, pieces = store.volume_lines(ty, lo, hi, version)
        write_volumes(tables or [local_table(store.spark, [], "value STRING, piece STRING")], out, compression)
        return pieces
    return export(store.read([ty], lo, hi, version), export_name, out, lo, hi, compression, piece_bytes)
