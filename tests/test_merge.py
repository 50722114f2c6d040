import random

import pytest
from pyspark.sql import functions as F

from tidemark.operators.merge import merge, merge_outcomes
from tidemark.plans import fold
from tidemark.plans.fold import OUTCOMES, outcome_counts

COMMANDS = "seq BIGINT, entity_type STRING, entity_num BIGINT, op STRING, revision BIGINT, data STRING"
STATE = "entity_type STRING, entity_num BIGINT, revision BIGINT, data STRING"


def replay(state, commands):
    """The rules, one command at a time."""
    stored = {num: (rev, data) for _, num, rev, data in state}
    counts = {}
    for seq, _, num, op, rev, data in sorted(commands):
        happened = counts.setdefault(num, dict.fromkeys(OUTCOMES, 0))
        present = num in stored
        if present and stored[num][0] > rev:
            happened["stale"] += 1
        elif op == "U":
            happened["replaced" if present else "inserted"] += 1
            stored[num] = (rev, data)
        elif present:
            happened["deleted"] += 1
            del stored[num]
        else:
            happened["missing_delete"] += 1
    return stored, counts


def random_case(seed, entities=6, commands=300, revisions=12, deletes=0.4):
    rng = random.Random(seed)
    state = [("Item", n, rng.randrange(revisions), f"s{n}") for n in range(entities) if rng.random() < 0.5]
    cmds = [
        (seq, "Item", rng.randrange(entities), "D" if rng.random() < deletes else "U", rng.randrange(revisions), f"c{seq}")
        for seq in range(commands)
    ]
    return state, cmds


def as_dict(df):
    return {r.entity_num: (r.revision, r.data) for r in df.collect()}


@pytest.mark.parametrize("seed,bits", [(1, None), (2, (3,)), (3, (2, 5)), (4, (1, 2, 4))])
def test_merge_equals_replay(spark, seed, bits):
    state, cmds = random_case(seed)
    want, _ = replay(state, cmds)
    got = merge(spark.createDataFrame(state, STATE), spark.createDataFrame(cmds, COMMANDS), bits=bits)
    assert as_dict(got) == want


def test_merge_when_nothing_is_small_enough_to_broadcast(spark, monkeypatch):
    from tidemark.plans import fold, stored

    monkeypatch.setattr(fold, "BROADCAST_ROWS", 0)
    monkeypatch.setattr(stored, "BROADCAST_ROWS", 0)
    state, cmds = random_case(12)
    want, counts = replay(state, cmds)
    df, base = spark.createDataFrame(cmds, COMMANDS), spark.createDataFrame(state, STATE)
    assert as_dict(merge(base, df)) == want
    got = outcome_counts(df, base, 3)
    assert {r.entity_num: {n: r[n] for n in OUTCOMES} for r in got.collect()} == counts


@pytest.mark.parametrize("seed,bits,carry", [(5, 12, 10), (6, 3, 2), (7, 1, 1), (9, 12, 10)])
def test_outcomes_equal_replay(spark, monkeypatch, seed, bits, carry):
    monkeypatch.setattr(fold, "CARRY_BITS", carry)
    state, cmds = random_case(seed)
    _, want = replay(state, cmds)
    got = outcome_counts(spark.createDataFrame(cmds, COMMANDS), spark.createDataFrame(state, STATE), bits)
    assert {r.entity_num: {n: r[n] for n in OUTCOMES} for r in got.collect()} == want


def test_large_numbers(spark):
    top = 2**62 - 1
    cmds = [
        (top - 2, "Item", 1, "U", 2**63 - 2, "a"), (top - 1, "Item", 1, "D", 2**63 - 1, None),
        (top, "Item", 1, "U", 0, "b"), (0, "Item", 2, "U", 2**63 - 1, "c"), (1, "Item", 2, "U", 0, "d"),
    ]
    for mode, want in (("sequence", {1: (0, "b"), 2: (2**63 - 1, "c")}), ("lww", {2: (2**63 - 1, "c")})):
        assert as_dict(merge(None, spark.createDataFrame(cmds, COMMANDS), mode=mode)) == want


def test_merge_in_any_split_of_batches(spark):
    state, cmds = random_case(8)
    want, _ = replay(state, cmds)
    for cuts in ([150], [1, 40, 41, 299]):
        standing, start = spark.createDataFrame(state, STATE), 0
        for end in [*cuts, len(cmds)]:
            batch = spark.createDataFrame(cmds[start:end], COMMANDS)
            merged = merge(standing, batch).collect()
            standing, start = spark.createDataFrame(merged, STATE), end
        assert as_dict(standing) == want


def test_rules_one_by_one(spark):
    state = [("Item", n, 5, "old") for n in range(1, 8)]
    cmds = [
        (1, "Item", 1, "U", 4, "stale"),
        (2, "Item", 2, "U", 5, "equal"),
        (3, "Item", 3, "D", 4, None),
        (4, "Item", 4, "D", 5, None),
        (5, "Item", 5, "D", 9, None),
        (6, "Item", 5, "U", 1, "older than the delete"),
        (7, "Item", 20, "U", 0, "new"),
        (8, "Item", 21, "D", 3, None),
    ]
    got = as_dict(merge(spark.createDataFrame(state, STATE), spark.createDataFrame(cmds, COMMANDS)))
    assert got == {
        1: (5, "old"), 2: (5, "equal"), 3: (5, "old"), 5: (1, "older than the delete"),
        6: (5, "old"), 7: (5, "old"), 20: (0, "new"),
    }


def test_latest_revision_wins_without_arrival_order(spark):
    cmds = [
        (1, "Item", 1, "U", 9, "nine"), (2, "Item", 1, "U", 4, "four"),
        (3, "Item", 2, "D", 9, None), (4, "Item", 2, "U", 4, "four"),
        (5, "Item", 3, "U", 7, "first"), (6, "Item", 3, "U", 7, "second"),
    ]
    df = spark.createDataFrame(cmds, COMMANDS)
    assert as_dict(merge(None, df, mode="lww")) == {1: (9, "nine"), 3: (7, "second")}
    assert as_dict(merge(None, df)) == {1: (9, "nine"), 2: (4, "four"), 3: (7, "second")}
    with pytest.raises(ValueError):
        merge(None, df, mode="other")


def test_one_hot_entity(spark):
    """A third of the commands on one entity: its chunks fold apart and then together."""
    n = 60_000
    cmds = spark.range(n).select(
        F.col("id").alias("seq"),
        F.lit("Item").alias("entity_type"),
        F.when(F.col("id") % 3 == 0, 0).otherwise(F.col("id") % 997).cast("bigint").alias("entity_num"),
        F.when(F.col("id") % 7 == 0, "D").otherwise("U").alias("op"),
        ((F.col("id") * 7919) % 5003).alias("revision"),
        F.col("id").cast("string").alias("data"),
    )
    want, counts = replay([], [tuple(r) for r in cmds.collect()])
    assert as_dict(merge(None, cmds, bits=(8, 12))) == want
    got = merge_outcomes(cmds).first().asDict()
    assert got == {"entity_type": "Item", **{k: sum(c[k] for c in counts.values()) for k in OUTCOMES}}


def test_other_types_are_other_entities(spark):
    cmds = [(1, "Item", 1, "U", 2, "item"), (2, "Property", 1, "D", 9, None), (3, "Lexeme", 1, "U", 1, "lexeme")]
    got = merge(None, spark.createDataFrame(cmds, COMMANDS))
    assert {(r.entity_type, r.data) for r in got.collect()} == {("Item", "item"), ("Lexeme", "lexeme")}


def test_sparse_seqs_and_one_hot_entity(spark):
    """Seqs of the form k << 40: chunks come out of the highest seq, and lists stay short."""
    rng = random.Random(12)
    ops = [("Item", 1, rng.choice("UUD"), rng.randrange(40)) for _ in range(3000)]
    dense = spark.createDataFrame([(i, *o, f"b{i}") for i, o in enumerate(ops)], COMMANDS)
    sparse = dense.withColumn("seq", F.shiftleft("seq", 40))
    assert as_dict(merge(None, sparse)) == as_dict(merge(None, dense))
    assert [tuple(r) for r in outcome_counts(sparse).collect()] == [tuple(r) for r in outcome_counts(dense).collect()]
    assert fold.levels(3000 << 40, 13, 13) == (13, 26, 39)
    assert fold.levels(100, 13, 13) == (13,)
