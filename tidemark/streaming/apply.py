"""The continuous job: feed to commands to a new version of the store, one micro-batch at a time."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from tidemark.functions.position import START_REWIND_MS
from tidemark.operators.resolve import asked_by, one_per_request, resolve
from tidemark.schemas import COMMAND_SCHEMA
from tidemark.sources.content import ContentTable, extract_content
from tidemark.sources.feed import ALL_TYPES, decode_feed, feed_from, one_delivery, renumbered, with_identity
from tidemark.sources.quarantine import accepted, rejected, write_quarantine
from tidemark.sources.store import EntityStore


def apply_batch(
    store: EntityStore,
    feed: DataFrame,
    content: DataFrame | ContentTable,
    wiki: str,
    stream_id: str,
    batch_id: int,
    types: Sequence[str] = ALL_TYPES,
) -> int | None:
    """Apply one batch of feed records; a batch that is already published is skipped.

    A record delivered more than once counts once, by its position and payload. Records need no ``seq``: where one has
    none, those of the batch are numbered by position, on from the highest number the stream has used. ``content`` is a
    ``ContentTable``, of which only the batch's blocks are read, or a landed table (with ``body``) or a parsed one; the rows the
    batch asks for are picked first, and only they are parsed. Every followed type moves on to the batch's last position,
    also one that had no change. Changes and commands are written below the store first: the following steps read them
    several times, and a lost executor then costs no second decode or join. They go once the batch is published; rejected
    rows stay.
    """
    if store.applied(stream_id, batch_id):
        return None
    spark = store.spark
    at = f"{store.root}/batches/{stream_id}/{batch_id}"
    decoded = decode_feed(with_identity(feed), wiki, types, keep=("identity",))
    # Only rejected rows keep their text, so that what is reduced and written is narrow.
    narrow = decoded.withColumn("raw", F.when(F.col("reason").isNotNull(), F.col("raw")))
    one_delivery(narrow).write.mode("overwrite").parquet(f"{at}/changes")
    decoded = spark.read.schema(narrow.schema).parquet(f"{at}/changes")
    changes = accepted(decoded)
    facts = decoded.agg(
        *[F.count_if(F.col("reason").isNull() & c).alias(name) for name, c in (("records", F.lit(True)), ("unnumbered", F.col("seq").isNull()))],
        F.max(F.when(F.col("reason").isNull(), F.col("seq"))).alias("last_seq"),
        F.max_by(F.when(F.col("reason").isNull(), F.col("event_id")), F.when(F.col("reason").isNull(), F.col("event_ts_ms"))).alias("event_id"),
        F.max(F.when(F.col("reason").isNull(), F.col("event_ts_ms"))).alias("event_ts_ms"),
    ).first()
    last_seq = facts.last_seq
    if facts.unnumbered:
        above = store.last_seq(stream_id)
        changes, last_seq = renumbered(changes, above), above + facts.records
    wanted = asked_by(changes, content)
    if "body" in content.columns:
        wanted = one_per_request(wanted, lambda landed: accepted(extract_content(landed)))
    else:
        wanted = one_per_request(wanted)
    resolve(changes, wanted).write.mode("overwrite").parquet(f"{at}/commands")
    commands = spark.read.schema(COMMAND_SCHEMA).parquet(f"{at}/commands")
    write_quarantine(rejected(decoded, "feed"), f"{at}/quarantine")
    version = store.apply(commands, batch_positions(store, facts, types), stream_id, batch_id, last_seq=last_seq)
    for used in ("changes", "commands"):
        store.forget(f"batches/{stream_id}/{batch_id}/{used}")
    return version


def batch_positions(store: EntityStore, last: Row, types: Sequence[str]) -> list[tuple]:
    """The batch's last position for every followed type, unless the stored one is later."""
    stored = store.positions()
    if last.event_ts_ms is None:
        return []
    later = [ty for ty in types if stored.get(ty) is None or stored[ty] < last.event_ts_ms]
    return [(ty, last.event_id, last.event_ts_ms) for ty in later]


def run_stream(
    store: EntityStore,
    feed: DataFrame,
    content: DataFrame | ContentTable,
    wiki: str,
    stream_id: str,
    checkpoint: str,
    types: Sequence[str] = ALL_TYPES,
    trigger: dict | None = None,
) -> StreamingQuery:
    """Keep the store current from a streaming feed.

    ``trigger`` is passed to ``DataStreamWriter.trigger``; by default a batch starts every two seconds.
    Where batches are cut does not change the result. ``stream_id`` names the checkpoint: a repeated
    batch id of the same stream is applied once.
    """

    def handle(batch: DataFrame, batch_id: int) -> None:
        if not batch.isEmpty():
            apply_batch(store, batch, content, wiki, stream_id, batch_id, types)

    return (
        feed.writeStream.foreachBatch(handle)
        .option("checkpointLocation", checkpoint)
        .trigger(**(trigger or {"processingTime": "2 seconds"}))
        .start()
    )


def resume_feed(
    store: EntityStore, feed: DataFrame, rewind_ms: int = START_REWIND_MS, types: Sequence[str] = ALL_TYPES
) -> DataFrame:
    """The part of a feed a job that starts now still needs: from the stored position, minus an overlap.

    The earliest position of the followed types counts.

    Records of the overlap were applied before. The revision rule skips the ones that are older than the
    stored entity; of an entity deleted since, the store remembers up to where it is settled.
    """
    reached = [ts for ty, ts in store.positions().items() if ty in types and ts is not None]
    return feed_from(feed, min(reached), rewind_ms) if reached else feed
