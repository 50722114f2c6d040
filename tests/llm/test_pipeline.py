"""Stages on a small corpus: what they keep, and that they keep rows as they are."""

import pytest

import corpus_pipeline as p
from test_ngram_join import brute
from tidemark.llm.decontaminate import Windows

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def kept(spark, tmp_path_factory):
    """Rows after each stage, each stage given what the one before wrote."""
    docs, out = spark.read.parquet(f"{SF}/documents.parquet"), []
    out.append(docs.collect())
    for i, (_, stage) in enumerate(p.STAGES):
        at = str(tmp_path_factory.mktemp("stage") / str(i))
        stage(spark, docs, SF).write.parquet(at)
        docs = spark.read.parquet(at)
        out.append(docs.collect())
    return out


def test_rows_pass_unchanged(kept):
    for before, after in zip(kept[:-2], kept[1:-1], strict=True):
        assert after and set(after) <= set(before)


def test_near_duplicates_against_brute_force(kept):
    before, after = kept[2], kept[3]
    component = brute([(r.doc_id, r.text) for r in before])
    assert sorted(r.doc_id for r in after) == sorted(set(component.values()))


def test_decontamination_against_search(spark, kept):
    items = [tuple(r) for r in spark.read.parquet(f"{SF}/benchmark.parquet").select("item_id", "text").collect()]
    clean = {r.doc_id for r, found in zip(kept[3], Windows(items).scan([r.text for r in kept[3]]), strict=True) if not found[1]}
    assert {r.doc_id for r in kept[4]} == clean


def test_last_stage_and_run(spark, kept):
    assert {r.doc_id for r in kept[5]} == {r.doc_id for r in kept[4]}
    assert all(len(r.ids) == 4 * r.n_tokens for r in kept[5])
    assert sorted(tuple(r) for r in p.run(spark, SF).collect()) == sorted(tuple(r) for r in kept[5])


def test_nulls_repeats_and_further_columns(spark):
    docs = spark.createDataFrame(
        [(1, None, None, None, None, 1), (2, "", "en", None, 0, 1), (None, "the and of with from that", "en", "s", 5, 2), (4, "the and of with from that", None, None, None, 3)] * 2,
        "doc_id long, text string, lang string, source string, n_chars long, score int",
    )
    for name, stage in p.STAGES[:-1]:
        out = stage(spark, docs, SF)
        assert out.columns == docs.columns, name
        assert {tuple(r) for r in out.collect()} <= {tuple(r) for r in docs.collect()}
        assert stage(spark, docs.where("false"), SF).count() == 0
    assert p.tokens(spark, docs, SF).count() == 8
    # Of copies with one doc_id one row stays.
    assert [r.doc_id for r in p.near_duplicates(spark, docs.where("doc_id = 4"), SF).collect()] == [4]


def test_null_and_equal_ids_with_different_texts(spark):
    a, b, c, d = (" ".join(f"{x}{i}" for i in range(60)) for x in "abcd")
    rows = [
        (1, a, 0), (1, a, 0), (7, b, 0), (7, c, 0), (8, f"{a} near", 0), (8, d, 0), (9, f"{c} near", 0), (10, b, 0),
        (None, f"{a} none", 0), (None, "one text without id", 0), (None, "one text without id", 0), (None, "two texts without id", 0),
        (None, f"{a} {b}", 0), (None, f"{a} {b} near", 0), (None, " ", 0), (None, None, 0), (11, None, 0), (11, "", 0), (12, "alone with its id", 0),
    ]
    docs = spark.createDataFrame(rows, "doc_id long, text string, fp int")
    key = lambda r: (str(r[0]), str(r[1]))
    out = sorted((tuple(r) for r in p.near_duplicates(spark, docs.repartition(3), SF).collect()), key=key)
    near = [r for r in out if r[1] in (f"{a} {b}", f"{a} {b} near")]
    assert len(near) == 1 and near[0][0] is None
    want = [(1, a), (7, b), (7, c), (8, d), (None, "one text without id"), (None, "two texts without id"), (None, " "), (None, None), (11, None), (11, ""), (12, "alone with its id")]
    assert [r[:2] for r in out if r not in near] == sorted(want, key=key)
