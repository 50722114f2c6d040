"""Revision-guarded application of commands as an associative fold.

Applied to an entity at revision r, any run of commands does one of two things: it leaves the entity
alone when r is above a threshold, and otherwise gives one fixed outcome. So a run is summed up by
(threshold, outcome revision, outcome seq), an absent outcome meaning "deleted", and two adjacent runs
combine into one such summary.

The threshold is the highest revision of the run. If its last command with that revision is an update,
nothing after it can apply, and it is the outcome. Only if it is a delete, the outcome is that of the
commands after it, applied to nothing. The first case is a plain maximum per entity, with map-side
combine; what is left is folded in chunks of the arrival order first and then per entity, so no list
holds more than one chunk of a hot entity.
"""

from __future__ import annotations

from collections.abc import Sequence
from decimal import Decimal

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.plans.carry import exclusive_carry
from tidemark.plans.stored import BROADCAST_ROWS, counted, stored
from tidemark.schemas import KEY

SUMMARY = "struct<threshold:bigint,out_rev:bigint,out_seq:bigint>"
# Commands, or summaries of chunks, that one list of a fold holds at most, as a power of two.
LIST_BITS = 13
OUTCOME_CHUNK_BITS = 12
CARRY_BITS = 10

# Base of the packed (revision, seq, kind): more than any seq below 2**62 with its kind.
_SHIFT = Decimal(10**19)
OUTCOMES = ("inserted", "replaced", "deleted", "stale", "missing_delete")


def levels(top: int, first: int, step: int) -> tuple[int, ...]:
    """Chunk sizes, as powers of two of seq, that leave lists of 2**step entries at most up to seq ``top``."""
    bits = [first]
    while top >> bits[-1] >= 1 << step:
        bits.append(bits[-1] + step)
    return tuple(bits)


def _nothing() -> Column:
    return F.lit(None).cast(SUMMARY)


def _then(first: Column, second: Column) -> Column:
    """Summary of one run followed by another; a null summary is the empty run."""
    stays = first["out_rev"] > second["threshold"]
    return F.struct(
        F.greatest(first["threshold"], second["threshold"]).alias("threshold"),
        F.when(stays, first["out_rev"]).otherwise(second["out_rev"]).alias("out_rev"),
        F.when(stays, first["out_seq"]).otherwise(second["out_seq"]).alias("out_seq"),
    )


def _fold() -> Column:
    """Combine a group's summaries in order of pos."""
    runs = F.array_sort(F.collect_list(F.struct("pos", "threshold", "out_rev", "out_seq")))
    return F.aggregate(runs, _nothing(), _then)


def command_summaries(commands: DataFrame) -> DataFrame:
    """Each command as the summary of a run of length one."""
    update = F.col("op") == "U"
    return commands.select(
        *KEY,
        F.col("seq").alias("pos"),
        F.col("revision").alias("threshold"),
        F.when(update, F.col("revision")).alias("out_rev"),
        F.when(update, F.col("seq")).alias("out_seq"),
    )


def _fold_chunks(commands: DataFrame, bits: Sequence[int]) -> DataFrame:
    """Summary per entity, by chunk of the arrival order first."""
    runs = command_summaries(commands)
    below = 0
    for width in bits:
        chunk = F.shiftright("pos", width - below).alias("chunk")
        runs = runs.groupBy(*KEY, chunk).agg(_fold().alias("run"))
        runs = runs.select(*KEY, F.col("chunk").alias("pos"), "run.*")
        below = width
    return runs.groupBy(*KEY).agg(_fold().alias("run")).select(*KEY, "run.*")


def _highest(commands: DataFrame) -> DataFrame:
    """(entity, threshold, seq, is_update, last_seq): the last command with the highest revision.

    Revision, seq and kind are packed into one number, which keeps the maximum a hash aggregate.
    """
    update = F.when(F.col("op") == "U", 1).otherwise(0)
    low = F.shiftleft("seq", 1) + update
    packed = F.col("revision").cast("decimal(19,0)") * F.lit(_SHIFT) + low.cast("decimal(19,0)")
    best = commands.groupBy(*KEY).agg(F.max(packed).alias("best"), F.max("seq").alias("last_seq"))
    rest = F.expr(f"CAST(best % {_SHIFT}BD AS BIGINT)")
    return best.select(
        *KEY,
        F.expr(f"best div {_SHIFT}BD").alias("threshold"),
        F.shiftright(rest, 1).alias("seq"),
        (rest.bitwiseAND(1) == 1).alias("is_update"),
        "last_seq",
    )


def _settled(highest: DataFrame) -> DataFrame:
    """Summaries when nothing after the highest command counts."""
    update = F.col("is_update")
    return highest.select(
        *KEY,
        "threshold",
        F.when(update, F.col("threshold")).alias("out_rev"),
        F.when(update, F.col("seq")).alias("out_seq"),
    )


def fold_latest(commands: DataFrame) -> DataFrame:
    """One summary per entity when arrival order is not trusted: highest revision, then highest seq."""
    return _settled(_highest(commands))


def fold_sequence(
    commands: DataFrame, bits: Sequence[int] | None = None, scratch: str | None = None
) -> DataFrame:
    """One summary per entity for commands applied in order of seq.

    (entity, seq) must be unique, revisions and seqs not negative, seqs below 2**62. Runs a job: the
    highest commands are written below ``scratch`` (or the shared folder), and only entities with
    commands after their highest one, a delete, are looked at again. ``bits`` are the chunk sizes of
    that second look as powers of two of seq. They follow from the highest seq unless given, so that no list
    holds more than 2**LIST_BITS entries, however sparse seq is.
    """
    highest = stored(_highest(commands), "highest", scratch)
    again = highest.where(~F.col("is_update") & (F.col("last_seq") > F.col("seq")))
    again, entities = counted(again.select(*KEY, F.col("seq").alias("cut")))
    settled = _settled(highest)
    if entities == 0:
        return settled
    if bits is None:
        bits = levels(highest.agg(F.max("last_seq")).first()[0], LIST_BITS, LIST_BITS)
    after = commands.join(again, list(KEY)).where(F.col("seq") > F.col("cut"))
    rest = _fold_chunks(after, bits).select(
        *KEY, F.col("out_rev").alias("rest_rev"), F.col("out_seq").alias("rest_seq")
    )
    # At most one row per entity looked at again.
    rest = F.broadcast(rest) if entities <= BROADCAST_ROWS else rest
    return settled.join(rest, list(KEY), "left").select(
        *KEY,
        "threshold",
        F.coalesce("out_rev", "rest_rev").alias("out_rev"),
        F.coalesce("out_seq", "rest_seq").alias("out_seq"),
    )


def _count_run(start: Column, commands: Column) -> Column:
    """Outcome counts of commands in order, on an entity standing at revision ``start`` (null: absent)."""

    def count(acc: Column, cmd: Column) -> Column:
        standing = acc["met"]
        present = standing.isNotNull()
        update = cmd["op"] == "U"
        stale = F.coalesce(standing > cmd["revision"], F.lit(False))
        happened = {
            "inserted": ~present & update,
            "replaced": present & ~stale & update,
            "deleted": present & ~stale & ~update,
            "stale": stale,
            "missing_delete": ~present & ~update,
        }
        return F.struct(
            F.when(stale, standing).when(update, cmd["revision"]).alias("met"),
            *[(acc[n] + happened[n].cast("bigint")).alias(n) for n in OUTCOMES],
        )

    zero = F.struct(start.alias("met"), *[F.lit(0).cast("bigint").alias(n) for n in OUTCOMES])
    return F.aggregate(commands, zero, count)


def outcome_counts(
    commands: DataFrame,
    state: DataFrame | None = None,
    bits: int = OUTCOME_CHUNK_BITS,
) -> DataFrame:
    """Per entity, how many commands inserted, replaced, deleted, were stale, or deleted nothing.

    What a command did depends on the revision it met. Entities are walked in chunks of 2**bits places of seq:
    each chunk first gets the summary of the chunks before it and applies it to the stored revision.
    """
    key = list(KEY)
    in_order = F.array_sort(F.collect_list(F.struct("seq", "revision", "op"))).alias("run")

    def with_stored(frame: DataFrame) -> DataFrame:
        if state is None:
            return frame.withColumn("stored", F.lit(None).cast("bigint"))
        return frame.join(state.select(*key, F.col("revision").alias("stored")), key, "left")

    chunk = F.shiftright("pos", bits).alias("chunk")
    chunks = command_summaries(commands).groupBy(*key, chunk).agg(_fold().alias("v"))
    top = (commands.agg(F.max("seq")).first()[0] or 0) >> bits
    fan_bits = (CARRY_BITS,) * (max(0, top.bit_length() - 1) // CARRY_BITS)
    before = with_stored(exclusive_carry(chunks, key, _then, _nothing(), SUMMARY, fan_bits))
    untouched = F.col("carry").isNull() | (F.col("stored") > F.col("carry.threshold"))
    met = F.when(untouched, F.col("stored")).otherwise(F.col("carry.out_rev")).alias("met")
    chunked = commands.groupBy(*key, F.shiftright("seq", bits).alias("chunk")).agg(in_order)
    walked = chunked.join(before.select(*key, "chunk", met), [*key, "chunk"])
    walked = walked.select(*key, _count_run(F.col("met"), F.col("run")).alias("c"))
    return walked.groupBy(*key).agg(*[F.sum(f"c.{n}").alias(n) for n in OUTCOMES])
