import json

from pyspark.sql import functions as F

from tidemark.functions.position import decode_position
from tidemark.operators.metrics import (
    feed_lag,
    last_position,
    lag_samples,
    never_pending,
    received_updates,
    safe_frontier,
    start_position,
)
from tidemark.operators.quality import repeated_commands
from tidemark.operators.resolve import one_per_request, resolve
from tidemark.plans import roles
from tidemark.schemas import PROGRESS_SCHEMA
from tidemark.sources import content as content_source
from tidemark.sources import feed as feed_source
from tidemark.sources.quarantine import accepted

WIKI = "mainwiki"


def position(ms):
    return json.dumps([{"topic": "a", "partition": 0, "offset": -1}, {"topic": "b", "partition": 0, "timestamp": ms}])


def record(seq, kind, title, namespace=0, wiki=WIKI, comment="", revision=None):
    payload = {
        "meta": {"uri": "x", "offset": 417}, "id": seq, "type": kind, "namespace": namespace, "title": title,
        "comment": comment, "user": "A. Writer", "bot": False, "length": {"old": 1, "new": 2}, "wiki": wiki,
    }
    if revision is not None:
        payload["revision"] = {"old": revision - 1, "new": revision}
    return (seq, position(1000 + seq), json.dumps(payload))


def feed(spark, *records):
    return spark.createDataFrame(list(records), "seq BIGINT, event_id_json STRING, data STRING")


def test_the_three_payloads(spark):
    df = feed(
        spark,
        record(1, "edit", "Q70112", comment="/* wbcreateredirect:0||Q70112|Q8801 */", revision=553201),
        record(2, "log", "Q90417"),
        record(3, "new", "Q120455", comment="made", revision=664410),
    )
    got = accepted(feed_source.decode_feed(df, WIKI)).orderBy("seq").collect()
    assert [(r.kind, r.entity_num, r.revision, r.is_redirect, r.event_ts_ms) for r in got] == [
        ("edit", 70112, 553201, True, 1001),
        ("log", 90417, None, False, 1002),
        ("new", 120455, 664410, False, 1003),
    ]


def test_filter_and_fan_out(spark):
    df = feed(
        spark,
        record(1, "edit", "Q1", revision=1),
        record(2, "edit", "Property:P1", namespace=120, revision=1),
        record(3, "edit", "Lexeme:L1", namespace=146, revision=1),
        record(4, "edit", "Special:Log", namespace=-1, revision=1),
        record(5, "edit", "Q1", wiki="otherwiki", revision=1),
    )
    got = accepted(feed_source.decode_feed(df, WIKI)).collect()
    assert sorted((r.seq, r.entity_type) for r in got) == [(1, "Item"), (2, "Property"), (3, "Lexeme")]
    only = accepted(feed_source.decode_feed(df, WIKI, ["Lexeme"]))
    assert [r.seq for r in only.collect()] == [3]


def test_unusable_records_have_a_reason(spark):
    good = record(1, "edit", "Q1", revision=1)
    df = feed(
        spark,
        good,
        (2, good[1], good[2][:50]),
        (3, "no position", good[2]),
        record(4, "categorize", "Q1", revision=1),
        record(5, "edit", "User:Q1", revision=1),
        record(6, "edit", "Q1"),
        record(7, "log", "anything"),
    )
    got = {r.seq: r.reason for r in feed_source.decode_feed(df, WIKI).collect()}
    assert got == {
        1: None, 2: "bad_payload", 3: "bad_position", 4: "unknown_kind", 5: "bad_title", 6: "bad_revision", 7: None,
    }


def test_feed_positions(spark, tmp_path):
    df = feed(spark, *[record(n, "new", f"Q{n * 2}", revision=n) for n in range(1, 6)])
    assert feed_source.feed_head(df).first().seq == 1
    assert [r.seq for r in feed_source.feed_from(df, 1004, 1).orderBy("seq").collect()] == [3, 4, 5]
    changes = accepted(feed_source.decode_feed(df, WIKI))
    assert feed_source.latest_entity_id(changes).first().entity_num == 10
    last = last_position(changes).first()
    assert (last.last_event_ts_ms, last.last_event_id[1].timestamp) == (1005, 1005)
    df.write.json(str(tmp_path / "feed"))
    back = feed_source.read_feed(spark, str(tmp_path / "feed"))
    assert sorted(map(tuple, back.drop("corrupt").collect())) == sorted(map(tuple, df.collect()))
    assert back.where("corrupt is not null").isEmpty()


def test_start_position_is_the_earlier_one(spark):
    parts = spark.range(1).select(decode_position(F.lit(position(500))).alias("p")).first().p
    rows = [("Item", parts, 500, True), ("Lexeme", None, None, True)]
    progress = spark.createDataFrame(rows, PROGRESS_SCHEMA)
    later = start_position(progress, decode_position(F.lit(position(900))))
    assert {r.entity_type: r.last_event_ts_ms for r in later.collect()} == {"Item": 500, "Lexeme": 900}
    earlier = start_position(progress, decode_position(F.lit(position(100))))
    assert {r.last_event_ts_ms for r in earlier.collect()} == {100}


def content(spark, rows):
    return accepted(content_source.extract_content(spark.createDataFrame(rows, content_source.CONTENT_SCHEMA)))


def test_content_extraction(spark):
    rows = [
        ("Item", 1, 5, '{"entities":{"Q1":{"id":"Q1","lastrevid":5,"x":[1,{"y":"é"}]}}}'),
        ("Item", 2, 5, '{"entities":{"Q9":{"id":"Q9","lastrevid":5}}}'),
        ("Item", 3, 5, None),
        ("Item", 4, 5, '{"entities":{"Q4":{"id":"Q4"}}}'),
        ("Item", 6, 5, '{"entities":{"Q6":{"id":"Q6","lastrevid":"5"}}}'),
        ("Item", 7, 5, '{"entities":{"Q7":{"id":"Q7","lastrevid":-1}}}'),
        ("Property", 1, 5, '{"entities":{"P1":{"id":"P1","lastrevid":0}}}'),
    ]
    all_rows = content_source.extract_content(spark.createDataFrame(rows, content_source.CONTENT_SCHEMA)).collect()
    got = {(r.entity_type, r.entity_num): (r.revision, r.reason) for r in all_rows}
    assert got == {
        ("Item", 1): (5, None), ("Item", 4): (None, "bad_revision"), ("Item", 6): (None, "bad_revision"),
        ("Item", 7): (None, "bad_revision"), ("Property", 1): (0, None),
    }
    assert json.loads(next(r.data for r in all_rows if r.reason is None and r.entity_type == "Item"))["x"][1]["y"] == "é"


def test_resolution_rules(spark):
    df = feed(
        spark,
        record(1, "edit", "Q1", revision=5),
        record(2, "edit", "Q2", revision=5, comment="/* wbcreateredirect:0||Q2|Q3 */"),
        record(3, "edit", "Q3", revision=5),
        record(4, "new", "Q1", revision=5),
        record(5, "new", "Q5", revision=6),
        record(6, "log", "Q1"),
    )
    found = content(spark, [("Item", 1, 5, '{"entities":{"Q1":{"id":"Q1","lastrevid":8}}}')])
    commands = resolve(accepted(feed_source.decode_feed(df, WIKI)), found)
    got = {r.seq: (r.op, r.revision, r.data, r.reason) for r in commands.collect()}
    assert got == {
        1: ("U", 8, '{"id":"Q1","lastrevid":8}', None),
        2: ("D", 5, None, "redirect"),
        3: ("D", 5, None, "not_found"),
        4: ("U", 8, '{"id":"Q1","lastrevid":8}', None),
        5: ("U", 6, '{"id":"Q5", "lastrevid":6}', "stub"),
    }
    assert received_updates(commands).first().updates_received == 5


def test_lag_of_every_tenth_record(spark):
    rows = [(n, 100 * n) for n in range(25)]
    df = spark.createDataFrame(rows, "seq BIGINT, event_ts_ms BIGINT")
    assert sorted((r.feed_index, r.lag_ms) for r in lag_samples(df, 5000).collect()) == [(0, 5000), (10, 4000), (20, 3000)]
    row = feed_lag(df, 5000).first()
    assert (row.samples, row.min_lag_ms, row.median_lag_ms, row.max_lag_ms) == (3, 3000, 4000, 5000)


def frontier(spark, *entries):
    rows = [("Item", int(e[1:]), "pending" if e[0] == "+" else "persisted") for e in entries]
    df = spark.createDataFrame(rows, "entity_type STRING, item_id BIGINT, state STRING")
    row = safe_frontier(df).first()
    return None if row is None else (row.frontier, row.all_persisted)


def test_frontier(spark):
    assert frontier(spark) is None
    assert frontier(spark, "+1") == (None, False)
    assert frontier(spark, "+1", "-1") == (1, True)
    assert frontier(spark, "+1", "+3", "+2", "-1") == (1, False)
    assert frontier(spark, "+1", "+3", "+2", "-1", "-2") == (2, False)
    assert frontier(spark, "+1", "+3", "+2", "-1", "-2", "-3") == (3, True)
    assert frontier(spark, "+1", "+1", "-1") == (0, False)
    assert frontier(spark, "+1", "+1", "-1", "-1") == (1, True)
    assert frontier(spark, "+1", "+2", "-2") == (0, False)
    assert frontier(spark, "+1", "+2", "-2", "-1") == (2, True)
    assert frontier(spark, "+2", "-2", "+1") == (0, False)


def test_never_pending(spark):
    df = spark.createDataFrame([("Item", 1, "persisted"), ("Item", 2, "pending"), ("Item", 2, "persisted")],
                               "entity_type STRING, item_id BIGINT, state STRING")
    assert [r.item_id for r in never_pending(df).collect()] == [1]


def test_landed_records_get_their_sequence(spark):
    landed = spark.createDataFrame(
        [(3, position(50), "c"), (1, position(70), "d"), (2, position(50), "b"), (0, "no position", "a")], "place LONG, event_id_json STRING, data STRING"
    )
    first = feed_source.sequenced(landed, ["place"]).orderBy("seq").collect()
    assert [(r.seq, r.data) for r in first] == [(0, "a"), (1, "b"), (2, "c"), (3, "d")]
    assert feed_source.sequenced(landed, ["place"], above=9).agg({"seq": "min"}).first()[0] == 10


def test_repeated_commands(spark):
    rows = [(1, "Item", 7), (1, "Item", 7), (2, "Item", 7), (1, "Lexeme", 7)]
    found = repeated_commands(spark.createDataFrame(rows, "seq LONG, entity_type STRING, entity_num LONG")).collect()
    assert [(r.entity_type, r.entity_num, r.seq, r.copies) for r in found] == [("Item", 7, 1, 2)]


def test_landed_content_is_parsed_once(spark):
    parsed = spark.sparkContext.accumulator(0)

    def read(body):
        parsed.add(1)
        return int(body)

    def parse(landed):
        return landed.withColumns({"revision": F.udf(read, "bigint").asNondeterministic()("body"), "data": F.col("body")})

    rows = [("Item", n, 1, str(n)) for n in range(20)] + [("Item", n, 1, str(n + 5)) for n in range(0, 20, 4)]
    landed = spark.createDataFrame(rows, content_source.CONTENT_SCHEMA).coalesce(1)
    found = one_per_request(landed, parse)
    assert {r.entity_num: r.revision for r in found.collect()} == {n: n + 5 * (n % 4 == 0) for n in range(20)}
    assert parsed.value == len(rows)


def test_the_head_of_the_feed_needs_no_payloads(spark, sf):
    head = feed_source.feed_head(roles.feed(spark, sf))
    assert "otherwiki" not in head._jdf.queryExecution().optimizedPlan().toString()
    assert head.first().seq == roles.feed(spark, sf).agg(F.min("seq")).first()[0]
