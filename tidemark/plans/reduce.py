"""One row per key, without sorting or grouping the bodies of keys that occur once."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def highest_revision(rows: DataFrame, key: Sequence[str], parse: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """Of each key the row with the highest revision, of equal ones the greatest body (``data``).

    Which keys repeat is counted on the keys alone, a hash aggregate; only the rows of those are put in order.
    ``parse``, a map, may make the rows from those given: after they are parted, so that each is parsed once.
    """
    key = list(key)
    repeated = rows.groupBy(*key).agg(F.count("*").alias("_n")).where("_n > 1").select(*key)
    once, again = rows.join(repeated, key, "left_anti"), rows.join(repeated, key, "left_semi")
    if parse is not None:
        once, again = parse(once), parse(again)
    best_first = Window.partitionBy(*key).orderBy(F.desc("revision"), F.desc("data"))
    several = again.withColumn("_place", F.row_number().over(best_first)).where("_place = 1")
    return once.unionByName(several.drop("_place").select(*once.columns))
