import pytest
from pyspark.sql import functions as F

from test_feed import WIKI, content, feed, record
from tidemark.operators.merge import merge
from tidemark.operators.resolve import asked_by, resolve
from tidemark.sources import content as content_source
from tidemark.sources import feed as feed_source
from tidemark.sources.quarantine import accepted
from tidemark.sources.store import EntityStore
from tidemark.schemas import FEED_RAW_SCHEMA
from tidemark.streaming import live
from tidemark.streaming.apply import apply_batch, resume_feed, run_stream

ENTITY = "entity_type STRING, entity_num BIGINT, revision BIGINT, data STRING"


def records():
    out = []
    for seq in range(60):
        num, rev = seq % 7 + 1, (seq * 13) % 20
        kind = ("edit", "new", "edit", "log", "edit")[seq % 5]
        out.append(record(seq, kind, f"Q{num}", revision=None if kind == "log" else rev))
    return out


def documents(spark):
    rows = [
        ("Item", n, rev, f'{{"entities":{{"Q{n}":{{"id":"Q{n}","lastrevid":{rev}}}}}}}')
        for n in range(1, 8) for rev in range(20) if (n + rev) % 3
    ]
    return content(spark, rows)


def held(store):
    return {(r.entity_num, r.revision, r.data) for r in store.read().collect()}


def test_stream_in_any_batches_equals_batch(spark, tmp_path):
    base = spark.createDataFrame([("Item", n, 10, f"body {n}") for n in range(1, 5)], ENTITY)
    whole = feed(spark, *records())
    commands = resolve(accepted(feed_source.decode_feed(whole, WIKI)), documents(spark))
    want = {(r.entity_num, r.revision, r.data) for r in merge(base, commands).collect()}
    for name, cuts in (("one", [60]), ("three", [7, 30, 60])):
        store = EntityStore(spark, str(tmp_path / name))
        store.load(base)
        start = 0
        for end in cuts:
            feed(spark, *records()[start:end]).coalesce(1).write.mode("append").json(str(tmp_path / f"{name}-feed"))
            start = end
            run_stream(
                store, feed_source.read_feed_stream(spark, str(tmp_path / f"{name}-feed")), documents(spark), WIKI,
                "feed", str(tmp_path / f"{name}-checkpoint"), trigger={"availableNow": True},
            ).awaitTermination()
        assert held(store) == want
        assert store.progress().first().last_event_ts_ms == 1059
        assert len(store.versions()) == 1 + len(cuts)


def test_repeated_batch_and_quarantine(spark, tmp_path):
    store = EntityStore(spark, str(tmp_path))
    batch = feed(spark, *records(), (99, "no position", records()[0][2]))
    assert apply_batch(store, batch, documents(spark), WIKI, "s", 0) == 0
    before = held(store)
    assert apply_batch(store, batch, documents(spark), WIKI, "s", 0) is None
    assert held(store) == before
    bad = spark.read.parquet(str(tmp_path / "batches/s/0/quarantine")).collect()
    assert [r.reason for r in bad] == ["bad_position"]


def test_resume_with_overlap(spark, tmp_path):
    store = EntityStore(spark, str(tmp_path))
    whole = feed(spark, *records())
    assert resume_feed(store, whole).count() == 60
    apply_batch(store, whole.where("seq < 40"), documents(spark), WIKI, "s", 0)
    rest = resume_feed(store, whole, rewind_ms=5)
    assert [r.seq for r in rest.orderBy("seq").collect()] == list(range(34, 60))
    # A record without a position passes, and so reaches quarantine.
    damaged = whole.union(feed(spark, (99, "no position", records()[0][2])))
    assert 99 in {r.seq for r in resume_feed(store, damaged, rewind_ms=5).collect()}


def test_record_delivered_twice_in_a_batch(spark, tmp_path):
    twice = feed(spark, *records()).union(feed(spark, *records()))
    again = documents(spark).union(documents(spark))
    stores = []
    for name, records_, found in (("one", feed(spark, *records()), documents(spark)), ("two", twice, again)):
        stores.append(EntityStore(spark, str(tmp_path / name)))
        apply_batch(stores[-1], records_, found, WIKI, "s", 0)
    assert held(stores[0]) == held(stores[1])
    assert stores[1].read().groupBy("entity_num").count().where("count > 1").isEmpty()


def test_content_is_pruned_before_it_is_parsed(spark):
    landed = spark.createDataFrame([("Item", 1, 2, "{}")], content_source.CONTENT_SCHEMA)
    changes = spark.createDataFrame([("edit", "Item", 1, 2)], "kind STRING, entity_type STRING, entity_num BIGINT, revision BIGINT")
    plan = content_source.extract_content(asked_by(changes, landed))._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("from_json") < plan.index("LeftSemi")  # the plan is printed from the top down


def test_progress_of_several_streams_and_types(spark, tmp_path):
    store = EntityStore(spark, str(tmp_path))
    store.load(spark.createDataFrame([("Item", 1, 1, "a")], ENTITY))
    batch = feed(spark, *records())
    apply_batch(store, batch, documents(spark), WIKI, "f", 0)
    store.load(spark.createDataFrame([("Lexeme", 1, 1, "b")], ENTITY))
    apply_batch(store, batch.where("seq < 9"), documents(spark), WIKI, "g", 4)
    assert store.applied("f", 0) and store.applied("g", 4) and not store.applied("f", 1)
    progress = {r.entity_type: (r.initialized, r.last_event_ts_ms) for r in store.progress().collect()}
    # Every followed type is where the stream is; only loaded ones are initialized.
    assert progress == {"Item": (True, 1059), "Lexeme": (True, 1059), "Property": (False, 1059)}
    assert apply_batch(store, batch.where("false"), documents(spark), WIKI, "f", 1) is None
    assert not (tmp_path / "batches/f/0/changes").exists() and (tmp_path / "batches/f/0/quarantine").exists()


def test_two_writers_of_one_version(spark, tmp_path):
    store = EntityStore(spark, str(tmp_path))
    store.load(spark.createDataFrame([("Item", 1, 1, "a")], ENTITY))
    before = held(store)
    with pytest.raises(Exception, match="exist"):
        store._publish(0, [], [], [])
    assert held(store) == before


def drained(stream, at):
    sink = stream.writeStream.format("parquet").option("checkpointLocation", f"{at}-checkpoint")
    sink.trigger(availableNow=True).start(f"{at}-out").awaitTermination()
    return stream.sparkSession.read.schema(stream.schema).parquet(f"{at}-out")


def test_replayed_records_are_dropped(spark, tmp_path):
    rows = [(n, 1000 + n * 1000, "Item", "x") for n in range(50)]
    df = spark.createDataFrame(rows, "seq BIGINT, event_ts_ms BIGINT, entity_type STRING, data STRING")
    at = str(tmp_path / "dedupe")
    for part in (df, df.where("seq >= 40")):
        part.coalesce(1).write.mode("append").parquet(at)
    stream = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(at)
    out = drained(live.drop_replayed(stream), at)
    assert sorted(r.seq for r in out.collect()) == list(range(50))


def test_live_rate_and_lag(spark, tmp_path):
    rows = [(n, n * 10_000, "Item", "xy", n * 10_000 + n) for n in range(1000)]
    df = spark.createDataFrame(rows, "seq BIGINT, event_ts_ms BIGINT, entity_type STRING, data STRING, arrived_ms BIGINT")
    at = str(tmp_path / "rate")
    df.coalesce(1).write.parquet(at)
    stream = spark.readStream.schema(df.schema).parquet(at)
    def windows(stream, name, key):
        live.write_windows(stream, f"{at}-{name}", f"{at}-{name}-checkpoint", {"availableNow": True}).awaitTermination()
        return live.read_windows(spark, f"{at}-{name}", key).orderBy("period_start_ms").collect()

    rate = windows(live.live_rate(stream, 600, "10 minutes"), "r", ["period_start_ms", "entity_type"])
    assert [(r.events, r.bytes) for r in rate] == [(60, 120)] * 16 + [(40, 80)]  # the open window too
    lag = windows(live.live_lag(stream, 600, "10 minutes"), "l", ["period_start_ms"])
    assert len(lag) == 17 and (lag[1].min_lag_ms, lag[1].max_lag_ms) == (60, 119)
    assert df.agg(F.max("seq")).first()[0] == 999


def test_only_the_blocks_of_a_batch_are_read(spark, tmp_path):
    """A content table lands in blocks of ids; a batch lists and reads those its changes fall into."""
    table = content_source.ContentTable(spark, str(tmp_path / "content"), bits=2)
    rows = [(ty, n, rev, f"{ty} {n} {rev}") for ty in ("Item", "Lexeme") for n in range(1, 41) for rev in (1, 2)]
    landed = spark.createDataFrame(rows, content_source.CONTENT_SCHEMA)
    table.land(landed.where("entity_num < 30"))
    table.land(landed.where("entity_num >= 30").union(spark.createDataFrame([(None, None, 1, "odd")], content_source.CONTENT_SCHEMA)))
    assert table.read().count() == len(rows) + 1
    changes = spark.createDataFrame(
        [("edit", "Item", 5, 2), ("new", "Item", 37, 1), ("edit", "Item", 900, 1), ("log", "Lexeme", 9, None), ("edit", "Lexeme", 9, 2)],
        "kind STRING, entity_type STRING, entity_num BIGINT, revision BIGINT",
    )
    found = asked_by(changes, table)
    assert {tuple(r) for r in found.collect()} == {("Item", 5, 2, "Item 5 2"), ("Item", 37, 1, "Item 37 1"), ("Lexeme", 9, 2, "Lexeme 9 2")}
    read = {p.split("/content/")[1].rsplit("/", 1)[0] for p in found.inputFiles()}
    assert read == {"entity_type=Item/id_block=1", "entity_type=Item/id_block=9", "entity_type=Lexeme/id_block=2"}
    nothing = asked_by(changes.where("entity_num = 900"), table)
    assert nothing.count() == 0 and nothing.columns == list(table.columns)


def test_content_table_gives_what_a_landed_table_gives(spark, tmp_path):
    table = content_source.ContentTable(spark, str(tmp_path / "content"), bits=1)
    docs = [("Item", n, rev, f'{{"entities":{{"Q{n}":{{"id":"Q{n}","lastrevid":{rev + more}}}}}}}') for n in range(1, 8) for rev in range(20) for more in (0, 1, 0)]
    landed = spark.createDataFrame(docs, content_source.CONTENT_SCHEMA)
    table.land(landed)
    stores = []
    for name, found in (("table", table), ("landed", landed)):
        stores.append(EntityStore(spark, str(tmp_path / name)))
        apply_batch(stores[-1], feed(spark, *records()), found, WIKI, "s", 0)
    assert held(stores[0]) == held(stores[1]) and len(held(stores[0])) > 3


def unnumbered(spark, *rows):
    return feed(spark, *rows).withColumn("seq", F.lit(None).cast("bigint"))


def test_records_without_numbers(spark, tmp_path):
    """Numbered by position, on from batch to batch; a repeated record counts once, whatever its number."""
    numbered, plain = EntityStore(spark, str(tmp_path / "numbered")), EntityStore(spark, str(tmp_path / "plain"))
    apply_batch(numbered, feed(spark, *records()), documents(spark), WIKI, "s", 0)
    cuts = [(0, 25), (20, 45), (40, 60)]
    for batch, (lo, hi) in enumerate(cuts):
        part = unnumbered(spark, *records()[lo:hi])
        mixed = part.union(feed(spark, *records()[lo : lo + 3]))  # three of them a second time, with numbers
        apply_batch(plain, mixed.repartition(3), documents(spark), WIKI, "s", batch)
        assert plain.last_seq("s") == sum(h - b for b, h in cuts[: batch + 1]) - 1
    assert held(plain) == held(numbered)
    assert {tuple(r) for r in plain.streams().collect()} == {("s", 2, 69)}


def test_broken_lines_are_kept(spark, tmp_path):
    lines = [*feed(spark, *records()[:2]).toJSON().collect(), *(f"{{broken {i}" for i in range(6)), "{broken 0", "[]", '{"seq": "x", "data": 1}', "{}"]
    (tmp_path / "feed").mkdir()
    (tmp_path / "feed/part.json").write_text("\n".join(lines) + "\n")
    store = EntityStore(spark, str(tmp_path / "store"))
    stream = feed_source.read_feed_stream(spark, str(tmp_path / "feed"))
    run_stream(store, stream, documents(spark), WIKI, "s", str(tmp_path / "checkpoint"), trigger={"availableNow": True}).awaitTermination()
    bad = sorted((r.reason, r.raw) for r in spark.read.parquet(str(tmp_path / "store/batches/s/0/quarantine")).collect())
    broken = [raw for reason, raw in bad if reason == "bad_record"]
    assert broken[-7:] == sorted([*(f"{{broken {i}" for i in range(6)), "{broken 0"])
    assert '{"seq": "x", "data": 1}' in broken and all(raw for _, raw in bad)
    assert len(bad) >= len(lines) - 3 and len(held(store)) == 2


def test_decoding_composes(spark):
    """Reducing, filtering and counting decoded records in one plan."""
    rows = feed(spark, *records(), (99, "no position", "{"), (None, None, "x"), (None, None, "x"))
    decoded = feed_source.decode_feed(feed_source.with_identity(rows.union(rows)), WIKI, keep=("identity",))
    once = feed_source.one_delivery(decoded)
    assert once.where("reason is not null").count() == 2
    assert once.where("reason is null").count() == 60
    assert feed_source.decode_feed(rows, WIKI).where("reason is not null").count() == 3
    plan = once._jdf.queryExecution().executedPlan().toString()
    assert "SortAggregate" not in plan
    assert spark.createDataFrame([], FEED_RAW_SCHEMA).transform(feed_source.with_identity).count() == 0


def test_a_batch_of_logs_moves_the_position(spark, tmp_path):
    store = EntityStore(spark, str(tmp_path))
    store.load(spark.createDataFrame([("Item", 1, 1, "a")], ENTITY))
    logs = feed(spark, *[r for r in records() if '"log"' in r[2]])
    assert apply_batch(store, logs, documents(spark), WIKI, "s", 0) == 1
    assert store.progress().where("entity_type = 'Item'").first().last_event_ts_ms == 1058 and store.applied("s", 0)
    assert held(store) == {(1, 1, "a")}
    assert apply_batch(store, logs, documents(spark), WIKI, "s", 0) is None


def test_replay_after_a_delete(spark, tmp_path):
    """Delete, then an older update replayed: it stays deleted until a later command, and marks go with the position."""
    store = EntityStore(spark, str(tmp_path), overlap_ms=100)
    schema = "seq BIGINT, event_ts_ms BIGINT, entity_type STRING, entity_num BIGINT, op STRING, revision BIGINT, data STRING"

    def apply(batch, *rows):
        at = [("Item", None, max(r[1] for r in rows))]
        return store.apply(spark.createDataFrame([(ts, ts, "Item", n, op, rev, data) for n, ts, op, rev, data in rows], schema), at, "s", batch)

    apply(0, (1, 10, "U", 4, "four"), (2, 11, "U", 4, "two"), (1, 20, "D", 5, None))
    assert held(store) == {(2, 4, "two")} and [tuple(r) for r in store.settled().collect()] == [("Item", 1, 5, 20)]
    apply(1, (1, 10, "U", 4, "four"), (2, 11, "U", 4, "two"))
    assert held(store) == {(2, 4, "two")}
    apply(2, (1, 20, "D", 5, None), (1, 30, "U", 3, "again"))  # arrived later: an older revision may come back
    assert held(store) == {(2, 4, "two"), (1, 3, "again")}
    apply(3, (1, 10, "U", 4, "four"), (1, 20, "D", 5, None), (1, 30, "U", 3, "again"))
    assert held(store) == {(2, 4, "two"), (1, 3, "again")}
    apply(4, (2, 500, "U", 9, "late"))
    assert store.settled().count() == 0
