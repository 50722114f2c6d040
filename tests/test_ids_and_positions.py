from pyspark.sql import functions as F

from tidemark.functions.ids import format_id, next_id, parse_id, parse_title, type_order
from tidemark.functions.position import (
    decode_position,
    earlier_position,
    encode_position,
    position_ts_ms,
    rewind_position,
)
from tidemark.operators.ordering import total_order
from tidemark.schemas import POSITION_SCHEMA

PARTS = '[{"topic":"a","partition":0,"offset":-1},{"topic":"b","partition":0,"timestamp":1700000045007}]'


def test_parse_id(spark):
    cases = [
        ("Item", "Q42", 42),
        ("Item", "Q007", 7),
        ("Item", "Q4294967295", 4294967295),
        ("Item", "Q4294967296", None),
        ("Item", "Q99999999999999999999999", None),
        ("Item", "Q+7", None),
        ("Item", "Q-7", None),
        ("Item", "Q", None),
        ("Item", "", None),
        ("Item", "P1", None),
        ("Item", "q1", None),
        ("Item", "Q1\n", None),
        ("Item", "Q 1", None),
        ("Property", "P12", 12),
        ("Lexeme", "L3", 3),
        ("Lexeme", None, None),
    ]
    rows = spark.createDataFrame(cases, "ty STRING, id STRING, want BIGINT")
    got = rows.select("id", "want", parse_id(F.col("ty"), F.col("id")).alias("got")).collect()
    assert [(r.id, r.got) for r in got] == [(r.id, r.want) for r in got]


def test_parse_title(spark):
    cases = [
        ("Item", "Q1", 1),
        ("Item", "Property:P1", None),
        ("Property", "Property:P31", 31),
        ("Property", "P31", None),
        ("Property", "Lexeme:P31", None),
        ("Lexeme", "Lexeme:L5", 5),
        ("Lexeme", "Lexeme:Q5", None),
    ]
    rows = spark.createDataFrame(cases, "ty STRING, title STRING, want BIGINT")
    got = rows.select("want", parse_title(F.col("ty"), F.col("title")).alias("got")).collect()
    assert [r.got for r in got] == [r.want for r in got]


def test_format_and_next(spark):
    row = spark.range(9, 10).select(
        format_id(F.lit("Property"), F.col("id")).alias("text"), next_id(F.col("id")).alias("next")
    ).first()
    assert (row.text, row.next) == ("P9", 10)


def test_ids_are_ordered_by_type_then_number(spark):
    rows = [("Lexeme", 1), ("Item", 10), ("Item", 2), ("Property", 1)]
    df = spark.createDataFrame(rows, "entity_type STRING, entity_num BIGINT")
    assert [tuple(r) for r in total_order(df).collect()] == [
        ("Item", 2), ("Item", 10), ("Property", 1), ("Lexeme", 1),
    ]
    assert df.select(type_order(F.col("entity_type")).alias("o")).distinct().count() == 3


def test_position_timestamp_and_rewind(spark):
    df = spark.createDataFrame([(PARTS,)], "j STRING").select(decode_position(F.col("j")).alias("p"))
    back = rewind_position(F.col("p"), 20_000)
    row = df.select(position_ts_ms(F.col("p")).alias("ts"), encode_position(back).alias("back")).first()
    assert row.ts == 1700000045007
    assert row.back == PARTS.replace("1700000045007", "1700000025007")


def test_rewind_changes_only_the_first_timestamp(spark):
    text = '[{"topic":"a","partition":0,"timestamp":5000},{"topic":"b","partition":0,"timestamp":5000}]'
    df = spark.createDataFrame([(text,)], "j STRING").select(decode_position(F.col("j")).alias("p"))
    back = df.select(rewind_position(F.col("p"), 2000).alias("b")).first().b
    assert [part.timestamp for part in back] == [3000, 5000]


def test_positions_without_timestamp_or_json(spark):
    rows = [('[{"topic":"a","partition":0,"offset":-1}]',), ("nonsense",), (None,)]
    df = spark.createDataFrame(rows, "j STRING").select(position_ts_ms(decode_position(F.col("j"))).alias("ts"))
    assert [r.ts for r in df.collect()] == [None, None, None]


def test_earlier_position(spark):
    def at(ms):
        return decode_position(F.lit(PARTS.replace("1700000045007", str(ms))))

    def pick(stored, offered):
        return spark.range(1).select(position_ts_ms(earlier_position(stored, offered)).alias("ts")).first().ts

    assert pick(at(100), at(200)) == 100
    assert pick(at(200), at(100)) == 100
    assert pick(F.lit(None).cast(POSITION_SCHEMA), at(7)) == 7
