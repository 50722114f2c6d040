"""Apply update and delete commands to the stored entities."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.plans.fold import OUTCOMES, fold_latest, fold_sequence, outcome_counts
from tidemark.schemas import KEY

MODES = ("sequence", "lww")


def summarize(
    commands: DataFrame,
    mode: str = "sequence",
    bits: Sequence[int] | None = None,
    scratch: str | None = None,
) -> DataFrame:
    """Fold the commands of each entity to (threshold, out_rev, out_seq); see ``plans.fold``."""
    if mode == "sequence":
        return fold_sequence(commands, bits, scratch)
    if mode == "lww":
        return fold_latest(commands)
    raise ValueError(f"unknown merge mode: {mode}")


def merge(
    state: DataFrame | None,
    commands: DataFrame,
    mode: str = "sequence",
    bits: Sequence[int] | None = None,
    scratch: str | None = None,
) -> DataFrame:
    """The entities after the commands.

    ``commands`` has (seq, entity_type, entity_num, op, revision, …) with op U or D; the other columns
    are the body and must match those of ``state``. (entity, seq) is unique, an entity occurs once in
    ``state``.

    * ``sequence``: commands apply in order of seq. A command older than the stored revision is
      skipped; an equal or newer one replaces or deletes. A deleted or absent entity takes any update.
    * ``lww``: only the command with the highest revision (then seq) of an entity counts.

    ``commands`` is read more than once and should be a stored table. Only (seq, revision, op) are folded,
    through a small table below ``scratch`` (or the shared folder) in the first mode. Bodies are fetched for the winning commands alone, and stored
    bodies are never shuffled when the folded side is small enough for AQE to broadcast.
    """
    key = list(KEY)
    folded = summarize(commands, mode, bits, scratch)
    body = [c for c in commands.columns if c not in (*KEY, "seq", "op", "revision", "event_ts_ms", "reason")]
    winners = folded.where(F.col("out_seq").isNotNull())
    if state is not None:
        stored = state.select(*key, F.col("revision").alias("_stored"))
        winners = winners.join(stored, key, "left").where(
            F.col("_stored").isNull() | (F.col("_stored") <= F.col("threshold"))
        )
    winners = winners.select(*key, F.col("out_seq").alias("seq"))
    applied = commands.join(winners, [*key, "seq"]).select(*key, "revision", *body)
    if state is None:
        return applied
    kept = (
        state.join(folded.select(*key, "threshold"), key, "left")
        .where(F.col("threshold").isNull() | (F.col("revision") > F.col("threshold")))
        .select(*key, "revision", *body)
    )
    return kept.unionByName(applied)


def changes_of(folded: DataFrame, commands: DataFrame) -> DataFrame:
    """One row per entity that has commands: (key, threshold, revision, data), the last two null where it ends up deleted.

    ``folded`` comes from ``summarize``. Bodies are fetched for the winning commands alone, by entity and seq, so
    that an entity with many commands is spread.
    """
    won = commands.select(*KEY, F.col("seq").alias("out_seq"), "revision", "data")
    picked = folded.select(*KEY, "threshold", "out_seq").join(won, [*KEY, "out_seq"], "left")
    return picked.select(*KEY, "threshold", "revision", "data", F.col("out_seq").isNotNull().alias("lives"))


def merged_in_place(laid: DataFrame, place: Sequence[str]) -> DataFrame:
    """The entities after the changes, for rows of both that already lie together.

    ``laid`` has stored rows (``threshold`` and ``lives`` null) and rows of ``changes_of``; all rows of an entity are in one
    partition, which ``place`` (columns) says. At most two rows of an entity meet in its window.
    """
    together = Window.partitionBy(*place, *[k for k in KEY if k not in place])
    is_change = F.col("lives").isNotNull()
    rows = laid.withColumns({
        "_threshold": F.max("threshold").over(together),
        "_stored": F.max(F.when(~is_change, F.col("revision"))).over(together),
    })
    stays = ~is_change & (F.col("_threshold").isNull() | (F.col("revision") > F.col("_threshold")))
    comes = F.col("lives") & (F.col("_stored").isNull() | (F.col("_stored") <= F.col("_threshold")))
    return rows.where(F.coalesce(F.when(is_change, comes).otherwise(stays), F.lit(False))).drop("_threshold", "_stored", "threshold", "lives")


def merge_outcomes(
    commands: DataFrame, state: DataFrame | None = None, by: Sequence[str] = ("entity_type",)
) -> DataFrame:
    """Counts of what the commands did, totalled over ``by`` (columns of the commands' entities)."""
    counts = outcome_counts(commands, state)
    return counts.groupBy(*by).agg(*[F.sum(n).alias(n) for n in OUTCOMES])
