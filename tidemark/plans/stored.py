"""Intermediate tables in the shared folder, and joins that depend on their size."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.session import fresh_path

# A narrow table up to this many rows (some tens of megabytes) is broadcast, a longer one is shuffled.
BROADCAST_ROWS = 200_000


def stored(df: DataFrame, name: str, at: str | None = None) -> DataFrame:
    """``df`` written once and read back, below ``at`` or the shared folder."""
    path = fresh_path(df.sparkSession, name) if at is None else f"{at}/{name}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def counted(narrow: DataFrame) -> tuple[DataFrame, int]:
    """A stored table and its number of rows; marked for broadcast if that is small."""
    rows = narrow.count()
    return (F.broadcast(narrow) if rows <= BROADCAST_ROWS else narrow), rows
