import gzip
import random

import pytest
from pyspark.sql import functions as F

from tidemark.operators import quality, volumes
from tidemark.operators.export import export, export_lines
from tidemark.operators.metrics import feed_rate, feed_rate_total

SIZES = "entity_type STRING, entity_num BIGINT, raw_bytes BIGINT"
ENTITY = "entity_type STRING, entity_num BIGINT, revision BIGINT, data STRING"


def sized(spark, rows):
    return spark.createDataFrame(rows, SIZES)


def cut_by_hand(rows, budget):
    out = {}
    for ty in sorted({r[0] for r in rows}):
        offset, seen = 0, []
        for _, num, size in sorted(r for r in rows if r[0] == ty):
            bucket = offset // max(budget, 1)
            if bucket not in seen:
                seen.append(bucket)
            out[ty, num] = len(seen) - 1
            offset += size
    return out


@pytest.mark.parametrize("budget", [0, 1, 500, 10**9])
def test_cut_and_route(spark, budget):
    rng = random.Random(budget)
    rows = [(ty, n, rng.choice([1, 20, 90, 1700])) for ty in ("Item", "Lexeme") for n in sorted(rng.sample(range(1, 900), 120))]
    table = volumes.cut_volumes(sized(spark, rows), budget, bits=3).cache()
    want = cut_by_hand(rows, budget)
    for limit in (0, 10**6):
        got = volumes.route(sized(spark, rows), table, broadcast_rows=limit).collect()
        assert {(r.entity_type, r.entity_num): r.volume_id for r in got} == want
    per_type = {}
    for row in table.orderBy("entity_type", "volume_id").collect():
        per_type.setdefault(row.entity_type, []).append(row)
    for ty, vols in per_type.items():
        assert vols[0].lo == 1 and vols[-1].hi is None
        assert all(a.hi + 1 == b.lo for a, b in zip(vols, vols[1:]))
        assert sum(v.raw_bytes for v in vols) == sum(r[2] for r in rows if r[0] == ty)
    assigned = volumes.route(sized(spark, rows), table)
    assert quality.outside_volume(assigned, table).count() == 0
    assert quality.empty_ranges(table).count() == 0


def test_ids_beyond_the_last_range_belong_to_the_open_volume(spark):
    table = volumes.cut_volumes(sized(spark, [("Item", n, 10) for n in range(1, 11)]), 40)
    ids = spark.createDataFrame([("Item", 0), ("Item", 4), ("Item", 5), ("Item", 4294967295)], "entity_type STRING, entity_num BIGINT")
    got = {r.entity_num: r.volume_id for r in volumes.route(ids, table).collect()}
    assert got == {0: 2, 4: 0, 5: 1, 4294967295: 2}


def test_size_is_in_bytes(spark):
    df = spark.createDataFrame([("Item", 1, 1, "é€")], ENTITY)
    assert volumes.volume_sizes(df).first().raw_bytes == 6


def test_initialized_up_to(spark):
    table = volumes.cut_volumes(sized(spark, [("Item", n, 10) for n in range(1, 11)]), 40)
    for done, want in ((True, 10), (False, 8)):
        flag = spark.createDataFrame([("Item", done)], "entity_type STRING, initialized BOOLEAN")
        assert volumes.initialized_up_to(table, flag).first().initialized_up_to == want


def test_oversize_and_gaps(spark):
    table = volumes.cut_volumes(sized(spark, [("Item", 1, 10), ("Item", 2, 500)]), 100)
    assert quality.oversize_volumes(table, 100).count() == 1
    rows = spark.createDataFrame([("Item", n, 1, "") for n in (1, 1, 4)], ENTITY)
    gaps = quality.id_gaps(rows).first()
    assert (gaps.missing, gaps.entities, gaps.rows) == (2, 2, 3)
    assert [r.copies for r in quality.repeated_entities(rows).collect()] == [2]
    found = quality.summary(a=rows, b=rows.where("false"))
    assert {r.check_name: r.violations for r in found.collect()} == {"a": 3, "b": 0}


def exported(path):
    out = []
    for part in sorted(path.glob("part-*")):
        text = gzip.decompress(part.read_bytes()) if part.suffix == ".gz" else part.read_bytes()
        out.append(text.decode().split("\n")[:-1])
    return out


def entities(spark, n=300):
    rows = [("Item", i, i, f'{{"id":"Q{i}","text":"{"é" * (i % 17)}"}}') for i in range(n, 0, -1)]
    rows += [("Property", 5, 1, "p5"), ("Item", n + 1, 1, "")]
    return spark.createDataFrame(rows, ENTITY).repartition(7), [r[3] for r in reversed(rows[:n])]


@pytest.mark.parametrize("compression", ["gzip", "none"])
def test_export_is_sorted_and_whole(spark, tmp_path, compression):
    df, lines = entities(spark)
    pieces = export(df, "items", str(tmp_path / "out"), compression=compression, piece_bytes=1000)
    parts = exported(tmp_path / "out")
    assert pieces > 5 and len(parts) == pieces
    assert [line for part in parts for line in part] == lines
    joined = b"".join(p.read_bytes() for p in sorted((tmp_path / "out").glob("part-*")))
    text = gzip.decompress(joined) if compression == "gzip" else joined
    assert text.decode() == "\n".join(lines) + "\n"


def test_export_range_and_names(spark, tmp_path):
    df, lines = entities(spark)
    export(df, "items", str(tmp_path / "out"), lo=50, hi=60, compression="bzip2")
    got = [r.value for r in spark.read.text(str(tmp_path / "out")).collect()]
    assert got == lines[49:60]
    table = export_lines(df, "items", 50, 60).orderBy("position").collect()
    assert [(r.position, r.entity_num) for r in table] == [(i, 50 + i) for i in range(11)]
    export(df, "properties", str(tmp_path / "p"))
    assert [r.value for r in spark.read.text(str(tmp_path / "p")).collect()] == ["p5"]
    with pytest.raises(ValueError):
        export(df, "items.jsonl", str(tmp_path / "x"))
    with pytest.raises(ValueError):
        export(df, "items", str(tmp_path / "x"), compression="zstd")


def test_export_of_nothing(spark, tmp_path):
    df, _ = entities(spark)
    export(df, "lexemes", str(tmp_path / "out"))
    assert spark.read.schema("value STRING").text(str(tmp_path / "out")).count() == 0


def test_rates(spark):
    rows = [(0, "Item", "ab"), (999, "Item", "é"), (1000, "Lexeme", "x"), (2500, "Item", "x")]
    df = spark.createDataFrame(rows, "event_ts_ms BIGINT, entity_type STRING, data STRING")
    got = {(r.period_start_ms, r.entity_type): (r.events, r.bytes) for r in feed_rate(df, 1).collect()}
    assert got == {(0, "Item"): (2, 4), (1000, "Lexeme"): (1, 1), (2000, "Item"): (1, 1)}
    total = {r.entity_type: (r.events, r.bytes, r.share, r.events_per_sec) for r in feed_rate_total(df).collect()}
    assert total == {"Item": (3, 5, 0.75, 1.2), "Lexeme": (1, 1, 0.25, 0.4), None: (4, 6, 1.0, 1.6)}
    assert df.where(F.col("data") == "x").count() == 2
