import gzip

import pytest
from pyspark.sql import functions as F

from test_feed import WIKI, content, feed, position, record
from tidemark import jobs, session
from tidemark.plans.stored import stored
from tidemark.sources.feed import read_feed_stream
from tidemark.sources.snapshot import parse_entities
from tidemark.sources.quarantine import accepted
from tidemark.sources.store import EntityStore


def entity(n, rev):
    return f'{{"id":"Q{n}","lastrevid":{rev}}}'


def dump(spark, nums, rev=5):
    return accepted(parse_entities(spark.createDataFrame([(entity(n, rev),) for n in nums], "value STRING")))


def found(spark, nums, rev=7):
    return content(spark, [("Item", n, rev, f'{{"entities":{{"Q{n}":{entity(n, rev)}}}}}') for n in nums])


def written(path):
    parts = sorted(path.rglob("part-*.gz"))
    return "".join(gzip.decompress(p.read_bytes()).decode() for p in parts).split("\n")[:-1]


def test_load_follow_dump(spark, tmp_path):
    store = EntityStore(spark, str(tmp_path / "store"), max_volume_bytes=100)
    jobs.first_load(store, "Item", 20, position(1010), found(spark, [3, 40, 500]), dump(spark, [*range(1, 21), 400]))
    assert {r.entity_num for r in store.read().where("entity_num in (3, 40, 400, 500)").collect()} == {3, 40}
    assert store.read().where("entity_num = 3").first().revision == 5
    row = jobs.stored_up_to(store).first()
    assert (row.initialized_up_to, row.last_event_ts_ms) == (40, 1010)

    changes = [record(n, "edit", f"Q{n}", revision=9) for n in (5, 12, 30)]
    feed(spark, *changes).write.json(str(tmp_path / "feed"))
    lookups = content(spark, [("Item", n, 9, f'{{"entities":{{"Q{n}":{entity(n, 9)}}}}}') for n in (12, 30)])
    stream = read_feed_stream(spark, str(tmp_path / "feed"))
    jobs.follow(
        store, stream.where(F.col("seq") > 5), lookups, WIKI, "s", str(tmp_path / "checkpoint"),
        trigger={"availableNow": True},
    ).awaitTermination()
    want = [entity(n, 9 if n == 12 else 5) for n in range(1, 21)] + [entity(30, 9), entity(40, 7)]
    assert jobs.dump(store, "items", str(tmp_path / "out"), piece_bytes=150) > 2
    assert written(tmp_path / "out") == want
    jobs.dump(store, "items", str(tmp_path / "part"), lo=10, hi=13)
    assert written(tmp_path / "part") == want[9:13]
    jobs.dump(store, "items", str(tmp_path / "before"), version=0)
    assert entity(12, 5) in written(tmp_path / "before")
    with pytest.raises(ValueError):
        jobs.dump(store, "things", str(tmp_path / "x"))


def test_load_without_dump_and_resumed(spark, tmp_path):
    store = EntityStore(spark, str(tmp_path))
    jobs.first_load(store, "Item", 3, position(1), found(spark, [1, 2, 3]))
    jobs.first_load(store, "Item", 6, position(2), found(spark, range(1, 7), rev=8), dump(spark, [4]), lo=3)
    got = {r.entity_num: r.revision for r in store.read().collect()}
    assert got == {1: 7, 2: 7, 3: 8, 4: 5, 5: 8, 6: 8}
    # Entities 1 and 2 were kept, so the feed has to take over where their load began.
    assert store.progress().first().last_event_ts_ms == 1


def test_load_with_several_revisions_in_the_content(spark, tmp_path):
    store = EntityStore(spark, str(tmp_path))
    several = found(spark, [1, 2], rev=5).union(found(spark, [1, 2], rev=7)).union(found(spark, [1], rev=6))
    jobs.first_load(store, "Item", 3, position(1), several, dump(spark, [2]))
    assert sorted((r.entity_num, r.revision) for r in store.read().collect()) == [(1, 7), (2, 5)]


def test_each_type_loads_on_its_own(spark, tmp_path):
    store = EntityStore(spark, str(tmp_path))
    jobs.first_load(store, "Item", 3, position(1), found(spark, [1, 2]))
    lexeme = content(spark, [("Lexeme", 1, 1, '{"entities":{"L1":{"id":"L1","lastrevid":1}}}')])
    jobs.first_load(store, "Lexeme", 1, position(2), lexeme)
    assert {(r.entity_type, r.entity_num) for r in store.read().collect()} == {("Item", 1), ("Item", 2), ("Lexeme", 1)}
    assert {r.entity_type: r.last_event_ts_ms for r in store.progress().collect()} == {"Item": 1, "Lexeme": 2}


def test_load_of_nothing(spark, tmp_path):
    store = EntityStore(spark, str(tmp_path))
    jobs.first_load(store, "Item", 3, position(1), found(spark, [1000]))
    assert store.read().count() == 0
    assert store.progress().first().last_event_ts_ms == 1


class _Session:
    """What shared_dir looks at, for a session that is not local."""

    class sparkContext:
        master = "yarn"
        applicationId = "app"

    class conf:
        @staticmethod
        def get(_, default):
            return default


def test_shared_folder(spark, monkeypatch):
    with pytest.raises(RuntimeError):
        session.shared_dir(_Session)
    with monkeypatch.context() as local:
        local.setattr(_Session.sparkContext, "master", "local[2]")
        own = session.shared_dir(_Session)
        assert own == session.shared_dir(_Session)
        assert session.fresh_path(_Session, "x") != session.fresh_path(_Session, "x")


def test_scratch_is_cleared(spark, monkeypatch, tmp_path):
    monkeypatch.setattr(session, "shared_dir", lambda _: f"file://{tmp_path}")
    stored(spark.range(3), "numbers")
    assert list(tmp_path.glob("tidemark-*/numbers-*"))
    session.clear_scratch(spark)
    assert not list(tmp_path.glob("tidemark-*"))
