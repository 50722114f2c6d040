"""Feed positions: a JSON array of stream parts, compared by the first part with a timestamp."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tidemark.schemas import POSITION_SCHEMA

# How far a reader steps back at job start and at a reconnect.
START_REWIND_MS = 20_000
RECONNECT_REWIND_MS = 2_000


def decode_position(json_col: Column) -> Column:
    """Parts of a position; null when the text is not one."""
    return F.from_json(json_col, POSITION_SCHEMA)


def encode_position(parts: Column) -> Column:
    """JSON text of a position; absent timestamps and offsets are left out."""
    return F.to_json(parts)


def position_ts_ms(parts: Column) -> Column:
    """Timestamp of the first part that has one."""
    return F.get(F.filter(parts, lambda part: part["timestamp"].isNotNull()), F.lit(0))["timestamp"]


def rewind_position(parts: Column, ms: Column | int) -> Column:
    """The position moved back: only the first part with a timestamp changes."""
    ms = F.lit(ms) if isinstance(ms, int) else ms
    at = F.array_position(F.transform(parts, lambda part: part["timestamp"].isNotNull()), F.lit(True)) - 1
    return F.transform(
        parts,
        lambda part, i: F.when(
            i == at, part.withField("timestamp", part["timestamp"] - ms.cast("bigint"))
        ).otherwise(part),
    )


def earlier_position(stored: Column, offered: Column) -> Column:
    """The earlier of two positions; the offered one on a tie or when nothing is stored."""
    return F.when(
        stored.isNull() | (position_ts_ms(stored) >= position_ts_ms(offered)), offered
    ).otherwise(stored)
