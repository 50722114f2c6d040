"""Running aggregates over a total order, without putting the whole order into one task.

Rows are grouped by blocks of their position. Block totals come from a hash aggregate with map-side
combine, so a window only ever sees the positions of one block, the blocks of one superblock, or the
superblocks. With 16 bits per level each of the first two holds at most 65,536 positions.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BLOCK_BITS = 16

_AGGREGATE: Mapping[str, Callable[[Column], Column]] = {"sum": F.sum, "max": F.max}


def _combine(kind: str, parts: list[Column]) -> Column:
    if kind == "max":
        return F.greatest(*parts)
    return reduce(lambda a, b: a + b, [F.coalesce(p, F.lit(0).cast("bigint")) for p in parts])


def running_before(
    df: DataFrame,
    values: Mapping[str, tuple[Column, str]],
    position: str,
    ties: Sequence[str] = (),
    partition: Sequence[str] = (),
    bits: int = BLOCK_BITS,
) -> DataFrame:
    """Add, per row, the aggregate of all rows before it.

    ``values`` maps an output name to (expression, "sum" or "max"). Rows are ordered by the whole
    number ``position``, then by ``ties``, separately for each value of ``partition``. The first row
    gets 0 for a sum and null for a max.
    """
    partition = list(partition)
    names = list(values)
    rows = df.select(
        "*",
        F.shiftright(F.col(position), bits).alias("_block"),
        *[expr.alias(f"_v_{name}") for name, (expr, _) in values.items()],
    )
    superblock = F.shiftright(F.col("_block"), bits).alias("_super")
    blocks = rows.groupBy(*partition, "_block", superblock).agg(
        *[_AGGREGATE[kind](f"_v_{name}").alias(f"_v_{name}") for name, (_, kind) in values.items()]
    )
    supers = blocks.groupBy(*partition, "_super").agg(
        *[_AGGREGATE[kind](f"_v_{name}").alias(f"_v_{name}") for name, (_, kind) in values.items()]
    )

    def before(frame: DataFrame, group: list[str], order: list[str], level: str, keep: list[str]) -> DataFrame:
        window = Window.partitionBy(*group).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
        return frame.select(
            *keep,
            *[
                _AGGREGATE[kind](f"_v_{name}").over(window).alias(f"_{level}_{name}")
                for name, (_, kind) in values.items()
            ],
        )

    super_carry = before(supers, partition, ["_super"], "s", [*partition, "_super"])
    block_carry = before(blocks, [*partition, "_super"], ["_block"], "b", [*partition, "_super", "_block"])
    carry = block_carry.join(super_carry, [*partition, "_super"]).drop("_super")
    in_block = before(
        rows, [*partition, "_block"], [position, *ties], "r", [*df.columns, "_block"]
    )
    joined = in_block.join(carry, [*partition, "_block"])
    return joined.select(
        *df.columns,
        *[
            _combine(values[name][1], [F.col(f"_s_{name}"), F.col(f"_b_{name}"), F.col(f"_r_{name}")]).alias(name)
            for name in names
        ],
    )


def number_rows(
    df: DataFrame,
    position: str,
    ties: Sequence[str] = (),
    partition: Sequence[str] = (),
    out: str = "row_index",
    bits: int = BLOCK_BITS,
) -> DataFrame:
    """Number the rows 0, 1, 2, … in order, per partition value."""
    return running_before(df, {out: (F.lit(1).cast("bigint"), "sum")}, position, ties, partition, bits)
