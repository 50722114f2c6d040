"""Order of a feed: total order, late rows of a bounded reorder buffer, and how disordered a feed is.

``arrival`` columns give the order of arrival. Operators that need the arrival rank number the rows
first, so holes and ties in the arrival columns do not matter.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.functions.ids import type_order
from tidemark.plans.prefix import BLOCK_BITS, number_rows, running_before
from tidemark.plans.stored import stored

# Buffer sizes used on the feed and on a dump.
FEED_BUFFER = 30
DUMP_BUFFER = 200

# Bits of the number of a block of keys that are looked at together.
DIGIT_BITS = 5


def total_order(entities: DataFrame) -> DataFrame:
    """Entities sorted by type, then by numeric id."""
    return entities.orderBy(type_order(F.col("entity_type")), "entity_num")


def in_order(df: DataFrame, key: str, arrival: Sequence[str]) -> DataFrame:
    """A reorder buffer that never overflows: sort by key, equal keys by arrival."""
    return df.orderBy(key, *arrival)


def disorder_profile(df: DataFrame, key: str, arrival: str, ties: Sequence[str] = ()) -> DataFrame:
    """How many rows arrive behind the largest key seen so far, and how far behind at most."""
    seen = running_before(df, {"seen": (F.col(key), "max")}, arrival, ties)
    behind = F.col("seen") > F.col(key)
    return seen.agg(
        F.count("*").alias("rows"),
        F.count_if(behind).alias("behind"),
        F.coalesce(F.max(F.when(behind, F.col("seen") - F.col(key))), F.lit(0).cast("bigint")).alias(
            "largest_gap"
        ),
    )


def reordered(df: DataFrame, key: str, arrival: str, ties: Sequence[str] = ()) -> DataFrame:
    """The rows with ``arrival_rank`` and ``emit_index``, their places in order of arrival and of key.

    This is what a reorder buffer emits that is at least ``smallest_buffer`` rows long; equal keys leave in order
    of arrival.
    """
    ranked = number_rows(df, arrival, ties, out="arrival_rank")
    return number_rows(ranked, key, ["arrival_rank"], out="emit_index")


def reordered_in(df: DataFrame, key: str, arrival: str, size: int, ties: Sequence[str] = ()) -> DataFrame:
    """``reordered`` rows with ``late``: whether a buffer of ``size`` rows has let a later place in order go before them."""
    rows = stored(reordered(df, key, arrival, ties), "reordered")
    late = _greater_before(rows.select("arrival_rank", "emit_index")).select("arrival_rank", (F.col("n") > size).alias("late"))
    return rows.join(late, "arrival_rank").select(*rows.columns, "late")


def greater_before(
    df: DataFrame, key: str, arrival: str, ties: Sequence[str] = (), cap: int | None = None, bits: int = BLOCK_BITS
) -> DataFrame:
    """Per row (``arrival_rank``), how many earlier arrivals have a greater key; with ``cap`` counted up to ``cap`` + 1.

    A buffer of n rows emits a row late exactly when this count exceeds n.

    Both places of a row, in order of arrival and of key, are cut into blocks. Of the rows to count, those in the same
    block of arrivals are found inside it, those in earlier ones but the same block of keys inside that, and the rest are
    whole cells (block of arrivals, block of keys). Places are dense, so no block has more than 2^``bits`` rows, and the work
    is the same however late a row is.
    """
    places = reordered(df.select(*{key, arrival, *ties}), key, arrival, ties).select("arrival_rank", "emit_index")
    rows = _greater_before(stored(places, "places"), bits)
    greater = F.col("n") if cap is None else F.least(F.col("n"), F.lit(cap + 1).cast("bigint"))
    return rows.select("arrival_rank", greater.alias("greater_before"))


def _greater_before(places: DataFrame, bits: int = BLOCK_BITS) -> DataFrame:
    """The count of ``greater_before`` as ``n``, added to stored rows (arrival_rank, emit_index)."""
    blocks = [F.shiftright("arrival_rank", bits).alias("_arrivals"), F.shiftright("emit_index", bits).alias("_keys")]
    rows = places.select("*", *blocks, F.lit(0).cast("bigint").alias("n"))
    rows = _greater_in_block(rows, "_arrivals", ["arrival_rank"])
    # In order of block, then place: no row has a greater one of its own block of arrivals before it.
    rows = _greater_in_block(rows, "_keys", ["_arrivals", "emit_index"])
    last = places.agg(F.max("emit_index")).first()[0] or 0
    if last >> bits:
        cells = stored(places.groupBy(*blocks).agg(F.count("*").alias("n")), "cells")
        above = _greater_cells_before(cells, last >> bits)
        rows = rows.join(above, ["_arrivals", "_keys"]).withColumn("n", F.col("n") + F.col("above"))
    return rows.select("arrival_rank", "emit_index", "n")


def _greater_in_block(rows: DataFrame, block: str, order: Sequence[str]) -> DataFrame:
    """``n`` plus, per row, how many rows of its block come earlier in ``order`` and have a greater ``emit_index``."""

    def counted(table: pa.Table) -> pa.Table:
        table = table.sort_by([(name, "ascending") for name in order])
        by_place = np.argsort(table.column("emit_index").to_numpy())
        size, steps = len(by_place), np.arange(len(by_place))
        rank = np.empty(size, np.int64)
        rank[by_place] = steps
        # From the highest bit of the rank on, rows are dealt to the halves of their range, staying in order: who goes to
        # the lower one counts those before it that went to the upper one.
        row, total = steps, np.zeros(size, np.int64)
        for bit in reversed(range(size.bit_length())):
            upper = (rank >> bit) & 1
            start = (rank >> (bit + 1)) << (bit + 1)
            before = np.cumsum(upper) - upper
            before -= before[start]
            total[row] += np.where(upper, 0, before)
            to = np.where(upper, start + (1 << bit) + before, steps - before)
            dealt = np.empty((2, size), np.int64)
            dealt[0, to], dealt[1, to] = rank, row
            rank, row = dealt
        n = pa.array(table.column("n").to_numpy() + total)
        return table.set_column(table.schema.get_field_index("n"), "n", n)

    return rows.groupBy(block).applyInArrow(counted, rows.schema)


def _greater_cells_before(cells: DataFrame, last: int) -> DataFrame:
    """(_arrivals, _keys, above): the rows in cells of earlier blocks of arrivals and later blocks of keys.

    Of two blocks of keys the numbers first differ in one digit. So for every digit, running totals over the cells that
    share the digits before it say how many rows of greater ones came earlier.
    """
    size = 1 << DIGIT_BITS
    counts = cells.select("_arrivals", "_keys", F.lit(0).cast("bigint").alias("above"))
    for level in range(-(-last.bit_length() // DIGIT_BITS)):
        digit = F.shiftright("_keys", DIGIT_BITS * level).bitwiseAND(size - 1).cast("int")
        same = F.shiftright("_keys", DIGIT_BITS * (level + 1)).alias("_same")
        later = {f"_over{d}": (F.when(F.col("_digit") > d, F.col("n")).otherwise(0), "sum") for d in range(size - 1)}
        seen = running_before(cells.select("*", same, digit.alias("_digit")), later, "_arrivals", ["_keys"], partition=["_same"])
        totals = F.array(*[F.col(name) for name in later], F.lit(0).cast("bigint"))
        counts = counts.unionByName(seen.select("_arrivals", "_keys", F.element_at(totals, F.col("_digit") + 1).alias("above")))
    return counts.groupBy("_arrivals", "_keys").agg(F.sum("above").alias("above"))


def late_rows(
    df: DataFrame, key: str, arrival: str, sizes: Sequence[int], ties: Sequence[str] = ()
) -> DataFrame:
    """How many rows a reorder buffer of each size would emit out of order."""
    counted = greater_before(df, key, arrival, ties)
    one_row = counted.agg(
        *[F.count_if(F.col("greater_before") > n).alias(str(n)) for n in dict.fromkeys(sizes)]
    )
    pairs = F.array(
        *[F.struct(F.lit(n).alias("buffer_size"), F.col(f"`{n}`").alias("late_rows")) for n in dict.fromkeys(sizes)]
    )
    return one_row.select(F.inline(pairs))


def smallest_buffer(df: DataFrame, key: str, arrival: str, ties: Sequence[str] = ()) -> int:
    """Smallest buffer size that emits no row late."""
    return int(greater_before(df, key, arrival, ties).agg(F.max("greater_before")).first()[0] or 0)
