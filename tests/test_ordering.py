import random
from bisect import insort

import pytest
from pyspark.sql import functions as F

from tidemark.operators import ordering
from tidemark.plans.prefix import number_rows, running_before


def buffer_output(keys, size):
    """A reorder buffer, one row at a time: (key, arrival) as they leave."""
    held, out = [], []
    for i, key in enumerate(keys):
        insort(held, (key, -i))
        if len(held) > size:
            out.append(held.pop(0))
    return [(key, -back) for key, back in out + held]


@pytest.mark.parametrize("keys", [[1], [2, 1], [5, 2, 3, 1, 4], [1, 1], [3, 1, 3, 1, 2]])
def test_reordered(spark, keys):
    rows = spark.createDataFrame(list(enumerate(keys)), "arrival BIGINT, k BIGINT")
    got = ordering.reordered(rows, "k", "arrival").orderBy("emit_index").collect()
    assert [(r.k, r.arrival_rank) for r in got] == sorted((k, i) for i, k in enumerate(keys))
    assert [r.emit_index for r in got] == list(range(len(keys)))
    assert ordering.reordered(rows.limit(0), "k", "arrival").collect() == []


@pytest.mark.parametrize("size", [0, 3, 40])
def test_late_rows_over_block_boundaries(spark, size):
    rng = random.Random(size)
    keys = [i // 2 + rng.randrange(30) for i in range(500)]
    seen, late = None, 0
    for key, _ in buffer_output(keys, size):
        late += seen is not None and key < seen
        seen = key if seen is None else max(seen, key)
    rows = spark.createDataFrame(list(enumerate(keys)), "arrival BIGINT, k BIGINT")
    assert ordering.late_rows(rows, "k", "arrival", [size]).first().late_rows == late


@pytest.mark.parametrize("bits", [2, 6])
def test_greater_before_and_smallest_buffer(spark, bits):
    rng = random.Random(11)
    keys = [rng.randrange(100) for _ in range(200)]
    exact = [sum(k > keys[i] for k in keys[:i]) for i in range(len(keys))]
    rows = spark.createDataFrame(list(enumerate(keys)), "arrival BIGINT, k BIGINT")
    got = ordering.greater_before(rows, "k", "arrival", cap=10, bits=bits).orderBy("arrival_rank").collect()
    assert [r.greater_before for r in got] == [min(c, 11) for c in exact]
    assert ordering.smallest_buffer(rows, "k", "arrival") == max(exact)


def test_disorder_profile(spark):
    rows = spark.createDataFrame(list(enumerate([1, 5, 3, 5, 2, 9])), "arrival BIGINT, k BIGINT")
    row = ordering.disorder_profile(rows, "k", "arrival").first()
    assert (row.rows, row.behind, row.largest_gap) == (6, 2, 3)


def test_in_order(spark):
    rows = spark.createDataFrame([(2, 0), (1, 1), (1, 2)], "k BIGINT, arrival BIGINT")
    assert [tuple(r) for r in ordering.in_order(rows, "k", ["arrival"]).collect()] == [(1, 1), (1, 2), (2, 0)]


def test_running_aggregates_over_levels(spark):
    rng = random.Random(3)
    rows = [(f"p{i % 2}", pos, i, rng.randrange(50)) for i, pos in enumerate(rng.choices(range(-40, 300), k=200))]
    df = spark.createDataFrame(rows, "part STRING, pos BIGINT, tie BIGINT, v BIGINT")
    got = running_before(
        df, {"total": (F.col("v"), "sum"), "top": (F.col("v"), "max")}, "pos", ["tie"], ["part"], bits=2
    ).collect()
    assert len(got) == len(rows)
    for r in got:
        before = [v for part, pos, tie, v in rows if part == r.part and (pos, tie) < (r.pos, r.tie)]
        assert (r.total, r.top) == (sum(before), max(before, default=None))


def test_number_rows(spark):
    df = spark.range(1000).select((F.col("id") * 37 % 1000).alias("pos"))
    got = number_rows(df, "pos", bits=3).collect()
    assert all(r.row_index == r.pos for r in got)


def test_one_row_very_late(spark):
    """One row behind all others: counted by the same work as any other."""
    rows = spark.range(100_001).select(F.col("id").alias("arrival"), F.when(F.col("id") == 100_000, -1).otherwise(F.col("id")).alias("k"))
    assert ordering.smallest_buffer(rows, "k", "arrival") == 100_000
    assert ordering.late_rows(rows, "k", "arrival", [30, 200_000]).orderBy("buffer_size").collect()[0].late_rows == 1
    assert ordering.smallest_buffer(rows.limit(0), "k", "arrival") == 0


def test_late_column_of_a_reordered_feed(spark):
    """A row is late if more rows than the buffer holds came before it with a greater key."""
    rng = random.Random(5)
    keys = [i + rng.randrange(60) for i in range(300)]
    rows = spark.createDataFrame(list(enumerate(keys)), "arrival BIGINT, k BIGINT")
    got = ordering.reordered_in(rows, "k", "arrival", 20).orderBy("arrival_rank").collect()
    late = [sum(k > keys[i] for k in keys[:i]) > 20 for i in range(len(keys))]
    assert [r.late for r in got] == late and any(late) and not all(late)
    assert [r.emit_index for r in got] == [sorted(range(300), key=lambda i: (keys[i], i)).index(i) for i in range(300)]


def test_no_wide_rows_are_sorted_to_count_late_ones(spark, monkeypatch):
    """Rows that are counted carry one running number; only cells of blocks have one for each digit."""
    widths = []
    held = ordering.running_before

    def running(df, values, *args, **kwargs):
        widths.append((len(values), "arrival_rank" in df.columns))
        return held(df, values, *args, **kwargs)

    monkeypatch.setattr(ordering, "running_before", running)
    rng = random.Random(7)
    keys = [rng.randrange(1000) for _ in range(400)]
    rows = spark.createDataFrame(list(enumerate(keys)), "arrival BIGINT, k BIGINT")
    got = ordering.greater_before(rows, "k", "arrival", bits=3).orderBy("arrival_rank").collect()
    assert [r.greater_before for r in got] == [sum(k > keys[i] for k in keys[:i]) for i in range(len(keys))]
    assert widths and not any(of_rows for _, of_rows in widths)
