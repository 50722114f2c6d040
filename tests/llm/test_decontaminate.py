"""Windows against plain search, and cuts."""

import re

import duckdb
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

import __spark_entry__ as entry
from oracle import duck, duck_rows, spark_rows
from tidemark.llm import decontaminate as d


def plain(text, items, n=10):
    """Number of words, hit positions and items, word by word."""
    fold = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    cut = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").translate(fold))
    words, hit, found = cut(text), set(), set()
    for item, own in items:
        own = cut(own)
        size = min(n, len(own))
        for i in range(len(own) - size + 1 if own else 0):
            for k in range(len(words) - size + 1):
                if words[k : k + size] == own[i : i + size]:
                    hit |= set(range(k, k + size))
                    found.add(str(item))
    return len(words), hit, sorted(found)


TEXT = st.text(st.sampled_from(list("aB c.é0")), max_size=60)


@settings(max_examples=300, deadline=None)
@given(st.lists(TEXT, max_size=4), st.lists(TEXT, max_size=4), st.integers(1, 4))
def test_scan(texts, items, n):
    items = list(enumerate(items))
    for text, (size, spans, found) in zip(texts, d.Windows(items, n).scan(texts), strict=True):
        hit = {i for a, b in spans for i in range(a, b)}
        assert (size, hit, found) == plain(text, items, n)


def test_query_equals_sql(spark, sf):
    assert spark_rows(entry.queries()["op1_decontaminate"](spark, sf)) == duck_rows(duck(sf), entry.oracle_sql()["op1_decontaminate"])


@pytest.mark.parametrize("part_chars", [10**6, 12])
def test_edges_in_one_part_and_many(spark, part_chars):
    items = [(1, "one two three"), (2, None), (3, "..."), (4, "a b c d e f g h i j k l"), (4, "one two three"), (5, "")]
    texts = [None, "", "...", "ONE, two: three four", "x a b c d e f g h i j z", "one two", "one two three " * 3000, "é One two three é"]
    docs = spark.createDataFrame([(i, t, "c") for i, t in enumerate(texts)] + [(3, texts[3], "c")], "doc_id long, text string, spans string")
    bench = spark.createDataFrame([(i, t, 1) for i, t in items], "item_id long, text string, doc_id int")
    rows = d.contamination(docs, bench, part_chars=part_chars).collect()
    assert len(rows) == len(texts) + 1
    for r in rows:
        hit = {i for s in r.spans for i in range(s["start"], s["end"])}
        assert (r.n_words, hit, list(r["items"])) == plain(texts[r.doc_id], items)
    kept = d.decontaminated(docs, bench)
    assert kept.columns == docs.columns and sorted(r.doc_id for r in kept.collect()) == [0, 1, 2, 5]
    cut = {r.doc_id: r.text for r in d.decontaminated(docs, bench, cut=True).collect()}
    assert cut[3] == " four" and cut[4] == "x  z" and cut[7] == "é  é" and cut[0] is None and cut[5] == "one two"
    assert d.contamination(docs, bench.where("false")).where("size(spans) > 0").count() == 0
    assert d.contamination(docs.where("false"), bench).count() == 0


def test_items_without_id(spark, tmp_path):
    """Their windows count as hits; only items with an id are listed and counted."""
    items = [(None, "one two three"), (7, "three four"), (None, None), (8, "one two three")]
    texts = ["one two three x", "three four", "nothing", "one two three four"]
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    columns, rows = spark_rows(entry.queries()["op1_decontaminate"](spark, str(tmp_path)))
    con = duckdb.connect()
    for name in ("documents", "benchmark"):
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{tmp_path}/{name}.parquet/*.parquet')")
    assert (columns, rows) == duck_rows(con, entry.oracle_sql()["op1_decontaminate"])
    got = {r.doc_id: (r.n_hit, r.n_items) for r in entry.queries()["op1_decontaminate"](spark, str(tmp_path)).collect()}
    assert got == {0: (3, 1), 1: (2, 1), 2: (0, 0), 3: (4, 2)}


@pytest.mark.parametrize("spans", ["string", "long"])
def test_cut_in_many_parts_equals_one_part(spark, spans):
    bench = spark.createDataFrame([(1, "a b c d"), (2, "c d e f"), (3, "x z"), (4, "f g"), (5, "u")], "item_id long, text string")
    texts = ["0 a b c d e f g 1", "x a b c d z", "x c d e f z", None, "", "u x u z", "no hit"]
    docs = spark.createDataFrame([(i, t, None) for i, t in enumerate(texts)], f"doc_id long, text string, spans {spans}")
    one = {r.doc_id: r.text for r in d.decontaminated(docs, bench, cut=True).collect()}
    assert one == {0: "0  1", 1: "x  z", 2: "x  z", 3: None, 4: "", 5: " x  z", 6: "no hit"}
    for part_chars in (1, 4, 12):
        out = d.decontaminated(docs, bench, cut=True, part_chars=part_chars)
        assert out.columns == docs.columns and {r.doc_id: r.text for r in out.collect()} == one
        assert sorted(r.doc_id for r in d.decontaminated(docs, bench, part_chars=part_chars).collect()) == [3, 4, 6]
