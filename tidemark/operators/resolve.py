"""Turn changes into update and delete commands, using the landed content."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.functions.payload import stub_document
from tidemark.plans.reduce import highest_revision
from tidemark.schemas import KEY
from tidemark.sources.content import ContentTable


def one_per_request(content: DataFrame, parse: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """Content that was landed more than once, reduced to the highest found revision per asked revision.

    With ``parse``, ``content`` are landed rows that it makes parsed ones from: what repeats is found without a parse.
    """
    def columns(rows: DataFrame) -> DataFrame:
        return rows.select(*KEY, "requested_revision", "revision", "data")

    key = [*KEY, "requested_revision"]
    if parse is None:
        return highest_revision(columns(content), key)
    return highest_revision(content, key, lambda landed: columns(parse(landed)))


def asked_by(changes: DataFrame, content: DataFrame | ContentTable) -> DataFrame:
    """The content rows, parsed or not, that the changes ask for: prune first, parse the rest.

    Of a ``ContentTable`` only the blocks that the changes fall into are listed and read.
    """
    asked = changes.where(F.col("kind") != "log").select(*KEY, F.col("revision").alias("requested_revision")).distinct()
    if isinstance(content, ContentTable):
        return content.asked(asked)
    return content.join(asked, [*KEY, "requested_revision"], "left_semi")


def resolve(changes: DataFrame, content: DataFrame) -> DataFrame:
    """Commands (seq, event_ts_ms, entity_type, entity_num, op, revision, data, reason).

    ``content`` has (entity_type, entity_num, requested_revision, revision, data), unique per asked
    entity and revision (``one_per_request``). A change whose content is there becomes an update with the content's own
    revision. Without content an edit is a delete (reason ``redirect`` or ``not_found``) and a new
    entity an update with a stub. Log records give no command.
    """
    found = content.select(
        *KEY,
        F.col("requested_revision").alias("revision"),
        F.col("revision").alias("found_revision"),
        F.col("data").alias("found_data"),
    )
    joined = changes.where(F.col("kind") != "log").join(found, [*KEY, "revision"], "left")
    hit = F.col("found_revision").isNotNull()
    new = F.col("kind") == "new"
    return joined.select(
        "seq",
        "event_ts_ms",
        *KEY,
        F.when(hit | new, "U").otherwise("D").alias("op"),
        F.coalesce("found_revision", "revision").alias("revision"),
        F.when(hit, F.col("found_data"))
        .when(new, stub_document(F.col("entity_type"), F.col("entity_num"), F.col("revision")))
        .alias("data"),
        F.when(hit, None)
        .when(new, "stub")
        .when(F.col("is_redirect"), "redirect")
        .otherwise("not_found")
        .alias("reason"),
    )
