import bz2
import json

import pytest
from pyspark.sql import functions as F

from tidemark.operators import bootstrap
from tidemark.sources.quarantine import accepted, rejected, write_quarantine
from tidemark.sources.snapshot import dump_lines, parse_entities, read_dump

ENTITY = "entity_type STRING, entity_num BIGINT, revision BIGINT, data STRING"


def entities(spark, nums, data=""):
    return spark.createDataFrame([("Item", n, 0, data) for n in nums], ENTITY)


def spine(spark, nums):
    return spark.createDataFrame([("Item", n) for n in nums], "entity_type STRING, entity_num BIGINT")


@pytest.mark.parametrize(
    "ids,dump,found,want",
    [
        ([], [1], [], []),
        ([1], [], [1], [(1, "lookup")]),
        ([1], [1], [], [(1, "dump")]),
        ([1, 2], [2], [1], [(1, "lookup"), (2, "dump")]),
        ([2], [1, 2], [], [(2, "dump")]),
        ([1, 2], [2], [], [(2, "dump")]),
        ([1, 2], [1, 2], [1, 2], [(1, "dump"), (2, "dump")]),
    ],
)
def test_reconcile(spark, ids, dump, found, want):
    loaded = bootstrap.reconcile(spine(spark, ids), entities(spark, dump), entities(spark, found))
    assert sorted((r.entity_num, r.origin) for r in loaded.collect()) == want


def test_repeated_dump_entity_keeps_the_highest_revision(spark):
    dump = spark.createDataFrame([("Item", 1, 3, "c"), ("Item", 1, 9, "a"), ("Item", 1, 4, "b")], ENTITY)
    loaded = bootstrap.reconcile(spine(spark, [1]), dump, entities(spark, []))
    assert [(r.revision, r.data) for r in loaded.collect()] == [(9, "a")]


def test_missing_ids_and_resume(spark):
    ids = bootstrap.id_spine(spark, "Item", 3, 8)
    assert [r.entity_num for r in bootstrap.missing_ids(ids, entities(spark, [4, 5, 99])).orderBy("entity_num").collect()] == [3, 6, 7, 8]
    assert bootstrap.resume_from(entities(spark, [1, 2, 3]), 2).count() == 2
    assert bootstrap.bootstrap_end(7) == 107
    with pytest.raises(ValueError):
        bootstrap.id_spine(spark, "Nothing", 1, 2)


def lines():
    return [json.dumps({"id": f"Q{n}", "lastrevid": n * 10, "label": "é,]"}, ensure_ascii=False) for n in (3, 1, 2)]


def test_array_dump_keeps_the_last_entity(spark, tmp_path):
    text = "[\n" + ",\n".join(lines()) + "\n]\n"
    (tmp_path / "dump.json.bz2").write_bytes(bz2.compress(text.encode()))
    parsed = accepted(parse_entities(read_dump(spark, str(tmp_path / "dump.json.bz2"))))
    assert sorted((r.entity_num, r.revision, r.data) for r in parsed.collect()) == sorted(
        zip((3, 1, 2), (30, 10, 20), lines())
    )


def test_line_dump(spark, tmp_path):
    (tmp_path / "dump.jsonl").write_text("\n".join(lines()) + "\n\n", encoding="utf-8")
    parsed = accepted(parse_entities(read_dump(spark, str(tmp_path / "dump.jsonl"), "json_lines")))
    assert sorted(r.entity_num for r in parsed.collect()) == [1, 2, 3]
    with pytest.raises(ValueError):
        dump_lines(spark.createDataFrame([("x",)], "value STRING"), "xml")


def test_unusable_lines_are_kept_with_a_reason(spark, tmp_path):
    rows = [
        '{"id":"Q1","lastrevid":5}',
        '{"id":"Q1","lastrevid":5',
        "not json",
        '{"id":"P1","lastrevid":5}',
        '{"id":"Qx","lastrevid":5}',
        '{"id":"Q2"}',
        '{"id":"Q2","lastrevid":"5"}',
        '{"id":"Q2","lastrevid":-5}',
        '{"lastrevid":5}',
        '{"id":"Q1","lastrevid":5} {"id":"Q2","lastrevid":5}',
        '{"id":"Q1","lastrevid":5},{"id":"Q2","lastrevid":5}',
        '[{"id":"Q1","lastrevid":5}]',
    ]
    parsed = parse_entities(spark.createDataFrame([(r,) for r in rows], "value STRING"))
    reasons = {r.raw: r.reason for r in parsed.collect()}
    assert reasons == {
        rows[0]: None, rows[1]: "bad_json", rows[2]: "bad_json", rows[4]: "bad_id",
        rows[5]: "bad_revision", rows[6]: "bad_revision", rows[7]: "bad_revision", rows[8]: "bad_json",
        **{row: "bad_json" for row in rows[9:]},
    }
    write_quarantine(rejected(parsed, "dump"), str(tmp_path / "q"))
    assert spark.read.parquet(str(tmp_path / "q")).where("source = 'dump'").count() == 10


def test_several_types_at_once(spark):
    rows = [(f'{{"id":"{p}{n}","lastrevid":1}}',) for n, p in enumerate("QPLX")]
    df = spark.createDataFrame(rows, "value STRING")
    got = accepted(parse_entities(df, ("Item", "Property", "Lexeme")))
    assert sorted((r.entity_type, r.entity_num) for r in got.collect()) == [("Item", 0), ("Lexeme", 2), ("Property", 1)]
    assert accepted(parse_entities(df, ("Property",))).select(F.col("entity_num")).first()[0] == 1


def test_no_body_is_sorted_where_nothing_repeats(spark):
    """Repeats are counted on the keys; the plan sorts bodies only behind a join with what repeats."""
    rows = [("Item", n, rev, f"{n} {rev}") for n in range(50) for rev in ((1, 2, 2) if n % 10 == 0 else (1,))]
    df = spark.createDataFrame(rows, "entity_type STRING, entity_num BIGINT, revision BIGINT, data STRING")
    once = bootstrap.one_per_entity(df)
    assert sorted(tuple(r) for r in once.collect()) == [("Item", n, 2 if n % 10 == 0 else 1, f"{n} {2 if n % 10 == 0 else 1}") for n in range(50)]
    plan = once._jdf.queryExecution().executedPlan().toString()
    assert "SortAggregate" not in plan and "ObjectHashAggregate" not in plan
    assert bootstrap.one_per_entity(df.limit(0)).count() == 0


def test_a_task_reconciles_so_many_ids_however_long_the_spine(spark, monkeypatch):
    monkeypatch.setattr(bootstrap, "TASK_IDS", 100)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        entity = [F.lit("Item").alias("entity_type"), F.col("id").alias("entity_num"), F.lit(1).cast("bigint").alias("revision")]
        dump = spark.range(10_000).select(*entity, F.lit("dump").alias("data")).where("entity_num % 2 = 0")
        content = spark.range(10_000).select(*entity, F.lit("found").alias("data")).where("entity_num % 5 > 0")
        got = bootstrap.reconcile(bootstrap.id_spine(spark, "Item", 1, 5000), dump, content)
        tasks = got.groupBy(F.spark_partition_id()).agg(F.count("*").alias("n"), F.count_if(F.col("data") == "dump").alias("dumped")).collect()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert sum(t.n for t in tasks) == 2500 + 2000 and sum(t.dumped for t in tasks) == 2500
    assert max(t.n for t in tasks) < 300
