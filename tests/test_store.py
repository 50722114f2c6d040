import random

import pytest
from pyspark.sql import functions as F

from test_merge import COMMANDS, replay
from tidemark.operators import quality
from tidemark.operators.export import write_volumes
from tidemark.schemas import POSITION_SCHEMA
from tidemark.sources.store import EntityStore

ENTITY = "entity_type STRING, entity_num BIGINT, revision BIGINT, data STRING"
POSITIONS = (
    "entity_type STRING, last_event_id array<struct<topic:string,partition:int,timestamp:bigint,offset:bigint>>, "
    "last_event_ts_ms BIGINT"
)


def entities(spark, nums):
    return spark.createDataFrame([("Item", n, 5, f"body {n}") for n in nums], ENTITY)


def commands(spark, rows):
    return spark.createDataFrame([(i, "Item", n, op, rev, data) for i, (n, op, rev, data) in enumerate(rows)], COMMANDS)


def held(store, **kw):
    return {r.entity_num: (r.revision, r.data) for r in store.read(**kw).collect()}


def check(store):
    table = store.manifest().orderBy("entity_type", "volume_id").collect()
    for ty in {v.entity_type for v in table}:
        vols = [v for v in table if v.entity_type == ty]
        assert [v.volume_id for v in vols] == list(range(len(vols)))
        assert all(a.hi + 1 == b.lo for a, b in zip(vols, vols[1:])) and vols[-1].hi is None
    rows = store.read()
    assert quality.outside_volume(rows, store.manifest()).count() == 0
    stats = {(r.entity_type, r.volume_id): (r.n, r.b) for r in rows.groupBy("entity_type", "volume_id").agg(F.count("*").alias("n"), F.sum("raw_bytes").alias("b")).collect()}
    for v in table:
        assert stats.get((v.entity_type, v.volume_id), (0, 0)) == (v.rows, v.raw_bytes)
    return table


def test_empty_store(spark, tmp_path):
    store = EntityStore(spark, str(tmp_path))
    assert store.latest() is None
    assert store.read().count() == 0
    assert store.manifest().count() == 0 and store.progress().count() == 0


def test_first_load_then_commands(spark, tmp_path):
    store = EntityStore(spark, str(tmp_path), max_volume_bytes=100)
    at = spark.createDataFrame([("Item", [("a", 0, 77, None)], 77)], POSITIONS)
    assert store.load(entities(spark, range(1, 41)), at) == 0
    before = check(store)
    assert len(before) > 3
    assert store.progress().first().last_event_ts_ms == 77

    version = store.apply(
        commands(spark, [(1, "U", 6, "new 1"), (2, "D", 5, None), (3, "U", 4, "stale"), (99, "U", 1, "x")]),
        stream_id="s", batch_id=0,
    )
    assert version == 1
    want = {n: (5, f"body {n}") for n in range(1, 41)}
    want[1], want[99] = (6, "new 1"), (1, "x")
    del want[2]
    assert held(store) == want
    after = check(store)
    # Only the first and the open volume were rewritten.
    assert [a.path == b.path for a, b in zip(before, after)] == [False, *[True] * (len(before) - 2), False]
    # The version before is still there, and positions carry over.
    assert held(store, version=0)[2] == (5, "body 2")
    assert store.progress().first().last_event_ts_ms == 77


def test_a_batch_applies_once(spark, tmp_path):
    store = EntityStore(spark, str(tmp_path))
    store.load(entities(spark, [1]))
    update = commands(spark, [(1, "U", 6, "six")])
    assert store.apply(update, stream_id="s", batch_id=3) == 1
    assert store.apply(update, stream_id="s", batch_id=3) is None
    assert store.apply(update, stream_id="s", batch_id=2) is None
    assert store.versions() == [0, 1]
    assert store.apply(update, stream_id="other", batch_id=0) == 2


def test_dead_attempt_leaves_no_trace(spark, tmp_path, monkeypatch):
    store = EntityStore(spark, str(tmp_path))
    store.load(entities(spark, [1, 2]))
    update = commands(spark, [(1, "U", 6, "six"), (2, "D", 9, None)])

    def die(*_):
        raise RuntimeError("executor lost")

    with monkeypatch.context() as broken:
        broken.setattr(EntityStore, "_publish", die)
        with pytest.raises(RuntimeError):
            store.apply(update, stream_id="s", batch_id=0)
    assert store.latest() == 0 and held(store) == {1: (5, "body 1"), 2: (5, "body 2")}
    assert store.apply(update, stream_id="s", batch_id=0) == 1
    assert held(store) == {1: (6, "six")}


def test_open_volume_is_cut_and_closed_ranges_stay(spark, tmp_path):
    store = EntityStore(spark, str(tmp_path), max_volume_bytes=100)
    store.load(entities(spark, range(1, 21)))
    before = check(store)
    store.apply(commands(spark, [(n, "U", 1, f"added {n}") for n in range(21, 60)]))
    after = check(store)
    closed = [(v.lo, v.hi) for v in before if v.hi is not None]
    assert [(v.lo, v.hi) for v in after][: len(closed)] == closed
    assert len(after) == len(before) + 3
    assert sorted(held(store)) == list(range(1, 60))


def test_volume_that_becomes_empty_and_fills_again(spark, tmp_path):
    store = EntityStore(spark, str(tmp_path), max_volume_bytes=1)
    store.load(entities(spark, [1, 2, 3]))
    store.apply(commands(spark, [(2, "D", 9, None)]))
    table = check(store)
    assert [(v.rows, v.path is None) for v in table] == [(1, False), (0, True), (1, False)]
    store.apply(commands(spark, [(2, "U", 1, "again")]))
    check(store)
    assert held(store)[2] == (1, "again")


def test_range_reads_touch_only_their_volumes(spark, tmp_path):
    store = EntityStore(spark, str(tmp_path), max_volume_bytes=50)
    store.load(entities(spark, range(1, 41)))
    part = store.read(lo=10, hi=12)
    assert sorted(r.entity_num for r in part.collect()) == [10, 11, 12]
    # The scan starts from the folders of the volumes that the range touches, and from no others.
    touched = store.manifest().where("lo <= 12 and (hi is null or hi >= 10)").count()
    assert len({f.rsplit("/", 1)[0] for f in part.inputFiles()}) == touched
    assert touched < len(store.read().select("volume_id").distinct().collect()) and len(store.read().select("volume_id").distinct().collect()) > 3
    assert store.read(types=["Lexeme"]).count() == 0


def test_random_batches_equal_replay(spark, tmp_path):
    rng = random.Random(5)
    store = EntityStore(spark, str(tmp_path), max_volume_bytes=300)
    start = [("Item", n, 5, f"body {n}") for n in range(1, 30)]
    store.load(spark.createDataFrame(start, ENTITY))
    rows = [(s, "Item", rng.randrange(1, 45), rng.choice("UUD"), rng.randrange(12), f"c{s}") for s in range(240)]
    for i in range(3):
        store.apply(spark.createDataFrame(rows[i * 80 : (i + 1) * 80], COMMANDS), stream_id="s", batch_id=i)
    check(store)
    assert held(store) == replay(start, rows)[0]


def test_expire(spark, tmp_path):
    store = EntityStore(spark, str(tmp_path), max_volume_bytes=1)
    store.load(entities(spark, [1, 2]))
    for rev in (6, 7, 8):
        store.apply(commands(spark, [(1, "U", rev, f"at {rev}")]))
    assert store.expire(keep=2) == 2
    assert store.versions() == [2, 3]
    assert held(store) == {1: (8, "at 8"), 2: (5, "body 2")}
    assert held(store, version=2)[1] == (7, "at 7")
    assert store.expire(keep=5) == 0


def test_types_new_to_the_store(spark, tmp_path):
    store = EntityStore(spark, str(tmp_path))
    store.load(entities(spark, [1]))
    store.apply(spark.createDataFrame([(1, "Lexeme", 7, "U", 1, "l7"), (2, "Property", 1, "D", 1, None)], COMMANDS))
    assert [r.data for r in store.read(types=["Lexeme"]).collect()] == ["l7"]
    assert {v.entity_type for v in check(store)} == {"Item", "Lexeme", "Property"}


def test_one_body_shuffle_per_rewrite(spark, tmp_path, monkeypatch):
    """Stored rows and commands meet in one exchange; the merge and the sorted write use its partitions."""
    store = EntityStore(spark, str(tmp_path), max_volume_bytes=200)
    store.load(entities(spark, range(1, 60)))
    plans = []
    held_ = EntityStore._write

    def write(self, laid, version):
        rows = laid.sortWithinPartitions("entity_type", "volume_id", "piece", "entity_num")
        plans.append(rows._jdf.queryExecution().executedPlan().toString())
        return held_(self, laid, version)

    monkeypatch.setattr(EntityStore, "_write", write)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        store.apply(commands(spark, [(n, "U", 6, "x") for n in range(1, 60, 7)] + [(2, "D", 9, None)]))
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    exchange = [line for line in plans[0].splitlines() if "shufflepartitionidpassthrough" in line]
    assert len(exchange) == 1  # of the union of stored rows and changes
    above = plans[0][: plans[0].index("shufflepartitionidpassthrough")]
    assert above.count("Exchange") == 1 and above.count("Sort [") == 1 and "Window" in above
    assert 2 not in held(store) and held(store)[8] == (6, "x")


def test_dump_reads_volumes_as_they_are(spark, tmp_path):
    store = EntityStore(spark, str(tmp_path / "store"), max_volume_bytes=100)
    store.load(entities(spark, range(1, 100)))
    store.apply(commands(spark, [(n, "U", 6, "grown " * 30) for n in range(60, 69)] + [(101, "U", 1, "last"), (7, "U", 9, "")]))
    tables, pieces = store.volume_lines("Item")
    assert pieces == store.manifest().where("path is not null").count() > 3
    whole, outgrown = (t._jdf.queryExecution().executedPlan().toString() for t in tables)
    assert "Exchange" not in whole and "Sort" not in whole
    assert outgrown.count("Exchange") == 1
    single = store.manifest().where("files = 1").count()
    assert tables[0].rdd.getNumPartitions() == single
    for bounds in ((None, None), (5, 22)):
        out = tmp_path / f"out-{bounds[0]}"
        write_volumes(store.volume_lines("Item", *bounds)[0], str(out), "none")
        lines = [line for p in sorted(out.rglob("part-*.txt")) for line in p.read_text().split("\n")[:-1]]
        rows = store.read(lo=bounds[0], hi=bounds[1]).where("data != ''").orderBy("entity_num").collect()
        assert lines == [r.data for r in rows] and len(lines) > 10


def test_a_scan_lists_volumes_and_not_versions(spark, tmp_path):
    """After many small versions a scan still starts from one folder a volume, without a condition on folders."""
    store = EntityStore(spark, str(tmp_path), max_volume_bytes=200)
    store.load(entities(spark, range(1, 60)))
    volumes = store.manifest().count()
    for n in range(1, 13):
        store.apply(commands(spark, [(n * 4, "U", 6, f"v{n}")]))
    rows = store.read()
    roots = rows._jdf.queryExecution().optimizedPlan().collectLeaves().apply(0).relation().location().rootPaths().size()
    assert store.latest() == 12 and store.manifest().count() == volumes and roots == volumes
    assert "Filter" not in rows._jdf.queryExecution().optimizedPlan().toString()
    assert {n: held(store)[n * 4] for n in range(1, 13)} == {n: (6, f"v{n}") for n in range(1, 13)}


def test_small_volumes_share_a_task(spark, tmp_path):
    store = EntityStore(spark, str(tmp_path), max_volume_bytes=200)
    layout, pieces = store._layout({("Item", n): 150 + n % 60 for n in range(2000)} | {("Lexeme", 0): 1000})
    rows = layout.orderBy("entity_type", "volume_id").collect()
    assert pieces < 8 * spark.sparkContext.defaultParallelism
    assert [(r.entity_type, r.volume_id) for r in rows] == [("Item", n) for n in range(2000)] + [("Lexeme", 0)]
    assert {r.pieces for r in rows[:-1]} == {1} and rows[-1].pieces == 5 and rows[-1].first_piece == pieces - 5
    assert sorted({r.first_piece for r in rows[:-1]}) == list(range(pieces - 5))


def test_pieces_of_grown_volumes_follow_their_bytes(spark, tmp_path):
    store = EntityStore(spark, str(tmp_path), max_volume_bytes=200)
    layout, pieces = store._layout({("Item", n): 600 + n % 60 for n in range(2000)})
    assert pieces < 8 * spark.sparkContext.defaultParallelism
    assert layout.count() == 2000 and layout.where("pieces <> 1").isEmpty()


def test_positions_of_a_load_are_evaluated_once(spark, tmp_path):
    calls = spark.sparkContext.accumulator(0)

    def read(ty):
        calls.add(1)
        return ty

    at = spark.createDataFrame([("Item", 5), ("Lexeme", 7)], "ty STRING, last_event_ts_ms BIGINT").select(
        F.udf(read, "string").asNondeterministic()("ty").alias("entity_type"),
        F.lit(None).cast(POSITION_SCHEMA).alias("last_event_id"), "last_event_ts_ms",
    )
    store = EntityStore(spark, str(tmp_path))
    store.load(entities(spark, [1, 2]), at)
    assert calls.value == 2
    assert sorted((r.entity_type, r.last_event_ts_ms, r.initialized) for r in store.progress().collect()) == [("Item", 5, True), ("Lexeme", 7, True)]
