"""Entity types and the target schemas shared by every operator."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column
from pyspark.sql import functions as F


class EntityType(NamedTuple):
    name: str
    type_ord: int
    namespace: int
    title_prefix: str
    id_prefix: str
    export_name: str


# The three entity types, in their sort order.
ENTITY_TYPES = (
    EntityType("Item", 0, 0, "", "Q", "items"),
    EntityType("Property", 1, 120, "Property:", "P", "properties"),
    EntityType("Lexeme", 2, 146, "Lexeme:", "L", "lexemes"),
)

# Ids are unsigned 32-bit numbers; text marks of a redirecting edit.
MAX_ENTITY_NUM = 4294967295
REDIRECT_MARK = "wbcreateredirect:"

KEY = ("entity_type", "entity_num")

ENTITY_SCHEMA = "entity_type STRING, entity_num BIGINT, revision BIGINT, data STRING"
STORED_SCHEMA = ENTITY_SCHEMA + ", raw_bytes BIGINT"
FEED_RAW_SCHEMA = "seq BIGINT, event_id_json STRING, data STRING"
POSITION_SCHEMA = "array<struct<topic:string,partition:int,timestamp:bigint,offset:bigint>>"
MANIFEST_SCHEMA = (
    "entity_type STRING, volume_id INT, lo BIGINT, hi BIGINT, rows BIGINT, raw_bytes BIGINT, "
    "last_num BIGINT, path STRING, files INT"
)
PROGRESS_SCHEMA = (
    f"entity_type STRING, last_event_id {POSITION_SCHEMA}, last_event_ts_ms BIGINT, initialized BOOLEAN"
)
STREAMS_SCHEMA = "stream_id STRING, batch_id BIGINT, last_seq BIGINT"
COMMAND_SCHEMA = (
    "seq BIGINT, event_ts_ms BIGINT, entity_type STRING, entity_num BIGINT, op STRING, revision BIGINT, data STRING, reason STRING"
)
SETTLED_SCHEMA = "entity_type STRING, entity_num BIGINT, revision BIGINT, settled_ts_ms BIGINT"


def entity_type(name: str) -> EntityType:
    for ty in ENTITY_TYPES:
        if ty.name == name:
            return ty
    raise ValueError(f"unknown entity type: {name}")


def entity_type_by_export_name(export_name: str) -> EntityType:
    for ty in ENTITY_TYPES:
        if ty.export_name == export_name:
            return ty
    raise ValueError(f"unknown export name: {export_name}")


def by_type(type_col: Column, field: str) -> Column:
    """Value of an entity-type attribute, as an expression over the type's name."""
    branches = None
    for ty in ENTITY_TYPES:
        value = F.lit(getattr(ty, field))
        hit = type_col == ty.name
        branches = F.when(hit, value) if branches is None else branches.when(hit, value)
    return branches


def type_of_namespace(namespace: Column) -> Column:
    """Name of the entity type that lives in a feed namespace; null for any other namespace."""
    branches = None
    for ty in ENTITY_TYPES:
        hit = namespace == ty.namespace
        branches = F.when(hit, F.lit(ty.name)) if branches is None else branches.when(hit, F.lit(ty.name))
    return branches
