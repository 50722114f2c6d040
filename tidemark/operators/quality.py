"""Rule violations in volumes, ledgers, content and snapshots. An empty result means all is well."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.operators.volumes import MAX_VOLUME_BYTES
from tidemark.schemas import KEY


def outside_volume(assigned: DataFrame, volumes: DataFrame) -> DataFrame:
    """Entities whose id is outside the range of the volume they are stored in."""
    ranges = volumes.select("entity_type", "volume_id", "lo", "hi")
    below = F.col("entity_num") < F.col("lo")
    above = F.coalesce(F.col("entity_num") > F.col("hi"), F.lit(False))
    joined = assigned.join(ranges, ["entity_type", "volume_id"], "left")
    return joined.where(F.col("lo").isNull() | below | above)


def empty_ranges(volumes: DataFrame) -> DataFrame:
    """Closed volumes whose range ends before it starts. A range of one id, lo = hi, is not empty."""
    return volumes.where(F.col("hi") < F.col("lo"))


def oversize_volumes(volumes: DataFrame, max_bytes: int = MAX_VOLUME_BYTES, factor: int = 2) -> DataFrame:
    """Volumes far above the budget."""
    return volumes.where(F.col("raw_bytes") > F.lit(max_bytes * factor))


def repeated_entities(snapshot: DataFrame) -> DataFrame:
    """Entities that occur more than once, with their number of rows."""
    counts = snapshot.groupBy(*KEY).agg(F.count("*").alias("copies"))
    return counts.where(F.col("copies") > 1)


def repeated_commands(commands: DataFrame) -> DataFrame:
    """Commands of one entity that share a seq; a merge needs them to be unique."""
    counts = commands.groupBy(*KEY, "seq").agg(F.count("*").alias("copies"))
    return counts.where(F.col("copies") > 1)


def id_gaps(snapshot: DataFrame) -> DataFrame:
    """Per type, how many ids between the first and the last one are missing."""
    ids = snapshot.groupBy(*KEY).agg(F.count("*").alias("copies"))
    return ids.groupBy("entity_type").agg(
        F.min("entity_num").alias("first_num"),
        F.max("entity_num").alias("last_num"),
        F.count("*").alias("entities"),
        F.sum("copies").alias("rows"),
        (F.max("entity_num") - F.min("entity_num") + 1 - F.count("*")).alias("missing"),
    )


def summary(**checks: DataFrame) -> DataFrame:
    """One row (check_name, violations) per check."""
    counted = [
        rows.agg(F.count("*").alias("violations")).select(F.lit(name).alias("check_name"), "violations")
        for name, rows in checks.items()
    ]
    return reduce(DataFrame.unionByName, counted)
