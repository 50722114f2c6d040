"""Hand every chunk of an ordered sequence the combined summary of all chunks before it.

For summaries that Spark's window aggregates cannot carry (a composed function, the N largest values).
Chunks combine up a tree with a fixed fan-out and the prefixes come back down it, so a list holds at
most one fan-out of summaries. Give as many levels as the highest chunk number needs; the topmost list holds
what they leave.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

FAN_BITS = (8, 8)


def fold_runs(runs: Column, compose: Callable[[Column, Column], Column], identity: Column) -> Column:
    """Combine an array of (chunk, v) structs in order of chunk."""
    return F.aggregate(runs, identity, lambda acc, run: compose(acc, run["v"]))


def exclusive_carry(
    chunks: DataFrame,
    key: Sequence[str],
    compose: Callable[[Column, Column], Column],
    identity: Column,
    value_type: str,
    fan_bits: Sequence[int] = FAN_BITS,
) -> DataFrame:
    """From (key…, chunk, v), one row per chunk, to (key…, chunk, carry)."""
    key = list(key)
    runs = F.array_sort(F.collect_list(F.struct("chunk", "v"))).alias("runs")
    grouped = []
    level = chunks
    for bits in fan_bits:
        lists = level.groupBy(*key, F.shiftright("chunk", bits).alias("parent")).agg(runs)
        grouped.append(lists)
        level = lists.select(
            *key, F.col("parent").alias("chunk"), fold_runs(F.col("runs"), compose, identity).alias("v")
        )
    lists = level.groupBy(*key).agg(runs).withColumn("carry", identity)

    entries_type = f"array<struct<chunk:bigint,carry:{value_type}>>"

    def step(acc: Column, run: Column) -> Column:
        entry = F.struct(run["chunk"].alias("chunk"), acc["before"].alias("carry"))
        return F.struct(
            compose(acc["before"], run["v"]).alias("before"),
            F.concat(acc["entries"], F.array(entry)).alias("entries"),
        )

    def prefixes(frame: DataFrame) -> DataFrame:
        start = F.struct(
            F.col("carry").alias("before"), F.array().cast(entries_type).alias("entries")
        )
        walked = F.aggregate("runs", start, step, lambda acc: acc["entries"])
        return frame.select(*key, F.inline(walked))

    carried = prefixes(lists)
    for lists in reversed(grouped):
        above = carried.withColumnRenamed("chunk", "parent")
        carried = prefixes(lists.join(above, [*key, "parent"]))
    return carried
