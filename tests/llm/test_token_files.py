"""Round trips of the coder, damage, and the files against the library."""

import zlib

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from tidemark.llm import q_token_files, token_files
from tidemark.llm.rans import Block, Table, encode_block

PATH = public_tokenizers.path("word_bpe_49k.json")
LIBRARY = Tokenizer.from_file(PATH)


def library_ids(text):
    return LIBRARY.encode(text or "", add_special_tokens=False).ids


@settings(max_examples=60, deadline=None)
@given(st.lists(st.lists(st.sampled_from([0, 1, 2, 7, 500, 49407, 2**31]), max_size=400), max_size=8), st.integers(1, 20))
def test_block_round_trip(documents, segments):
    documents = [(i * 3 - 5, np.array(d, np.uint32)) for i, d in enumerate(documents)]
    flat = np.concatenate([np.array([2], np.uint32), *(d for _, d in documents)])
    table = Table(*np.unique(flat, return_counts=True))
    block = Block(encode_block(documents, table, 77, segments))
    assert block.ids(table).tolist() == flat[1:].tolist()
    assert block.doc_ids.tolist() == [i for i, _ in documents] and block.lengths.tolist() == [len(d) for _, d in documents]
    assert block.start == 77


def test_segments_alone_and_damage():
    rng = np.random.default_rng(0)
    ids = (rng.zipf(1.3, 50_000) % 40_000).astype(np.uint32)
    table = Table(*np.unique(ids, return_counts=True))
    data = encode_block([(1, ids)], table)
    block = Block(data)
    run = block.steps * 64
    assert len(data) < 0.6 * ids.nbytes
    for g in (0, 7, block.segments - 1):
        assert block.ids(table, [g]).tolist() == ids[g * run : (g + 1) * run].tolist()
    bad = bytearray(data)
    bad[-40] ^= 4
    with pytest.raises(ValueError):
        Block(bytes(bad)).ids(table)
    with pytest.raises(ValueError):
        block.ids(Table(np.array([1, 2]), np.array([1, 1])))
    with pytest.raises(ValueError):
        encode_block([(1, np.array([123_456], np.uint32))], table)


@settings(max_examples=200, deadline=None)
@given(st.one_of(st.text(max_size=40), st.text(st.sampled_from(list("aB's <|endoftx>ΣÉé́\n\t \x1c1.")), max_size=40)))
def test_words_equal_whole(text):
    encoder = token_files.Encoder(PATH)
    assert np.frombuffer(encoder.encode([text, text])[1], encoder.kind).tolist() == library_ids(text)
    assert np.frombuffer(encoder.encode([text])[0], encoder.kind).tolist() == library_ids(text)


def test_query_against_library(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").orderBy("doc_id").collect()
    want, at = [], 0
    for d in docs:
        ids = np.array([*library_ids(d.text), 2], "<u4")
        want.append((d.doc_id, at, len(ids), zlib.crc32(ids.tobytes())))
        at += len(ids)
    got = sorted(tuple(r) for r in q_token_files.op3_token_files(spark, sf).collect())
    assert got == want


def test_edges(spark, tmp_path):
    texts = [None, "", "a word", "<|startoftext|>x <|endoftext|>", "long " * 60_000, "x" * 5000]
    rows = [(i * 10 - 20, t, 1) for i, t in enumerate(texts)] + [(0, "a word", 1), (-(2**63), "least", 1), (None, "no id", 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, start int")
    at = f"file://{tmp_path}/out"
    token_files.write(token_files.tokens(docs.repartition(3), PATH, 2), at, "<u2", block_ids=1000)
    got = sorted((r.start, r.doc_id, np.frombuffer(r.ids, "<u4").tolist()) for r in token_files.read(spark, at).collect())
    assert got[0][1] is None
    got = [(i, s, ids) for s, i, ids in got]
    assert sorted([(i, ids) for i, _, ids in got[1:]]) == sorted((i, [*library_ids(t), 2]) for i, t, _ in rows[:-1])
    assert [i for i, _, _ in got[1:]] == sorted(i for i, _, _ in rows[:-1])
    assert [s for _, s, _ in got] == np.concatenate([[0], np.cumsum([len(ids) for _, _, ids in got])[:-1]]).tolist()
    nothing = f"file://{tmp_path}/none"
    token_files.write(token_files.tokens(docs.where("false"), PATH, 2), nothing, "<u2")
    assert token_files.read(spark, nothing).count() == 0


@pytest.mark.parametrize("before, after", [("", "."), ("b", ", 1")])
def test_every_letter_and_number(before, after):
    """Also those that the normalizer takes apart, whose mark joins a stop."""
    encoder = token_files.Encoder(PATH)
    every = [chr(c) for c in range(0x110000) if not 0xD800 <= c < 0xE000 and chr(c).isalnum()]
    texts = [f"{before}{c}{after}" for c in every]
    for at in range(0, len(texts), 4096):
        want = [c.ids for c in LIBRARY.encode_batch(texts[at : at + 4096], add_special_tokens=False)]
        got = [np.frombuffer(ids, encoder.kind).tolist() for ids in encoder.encode(texts[at : at + 4096])]
        assert got == want


def test_one_id_over_many_partitions(spark, tmp_path):
    """Rows of one id, and of none, lie in several partitions and still in one order."""
    rows = [(None if i % 3 else 7, f"w{i % 50} x") for i in range(3000)]
    at = f"file://{tmp_path}/out"
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        token_files.write(token_files.tokens(spark.createDataFrame(rows, "doc_id long, text string").repartition(5), PATH, 2), at, "<u2", block_ids=100)
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    got = sorted((r.start, r.doc_id, r.n_tokens, bytes(r.ids)) for r in token_files.read(spark, at).collect())
    assert [r[1] for r in got] == [None] * 2000 + [7] * 1000
    assert [r[0] for r in got] == np.concatenate([[0], np.cumsum([r[2] for r in got])[:-1]]).tolist()
    want = sorted((i is not None, np.array([*library_ids(t), 2], "<u4").tobytes()) for i, t in rows)
    assert sorted((i is not None, ids) for _, i, _, ids in got) == want
    assert spark.read.parquet(f"{at}/blocks").select("part").distinct().count() > 3


def test_each_different_word_once():
    """Case and marks at the end of a word make no words of their own; the library is asked for each word once."""
    encoder = token_files.Encoder(PATH)
    asked = []

    class Counted:
        def __init__(self, library):
            self.library = library

        def encode_batch_fast(self, texts, **options):
            asked.extend(w for t in texts for w in t.split(" "))
            return self.library.encode_batch_fast(texts, **options)

    encoder.library = Counted(encoder.library)
    texts = ["Word word WORD, word. Word!! über Über&&& Word", "word?! over-all x<|endoftext|> word's <|ENDOFTEXT|>", "J̌ ǰ ΣΑΣ. İ."] * 2
    got = [np.frombuffer(ids, encoder.kind).tolist() for text in (texts, texts[:2]) for ids in encoder.encode(text)]
    assert got == [library_ids(t) for t in texts + texts[:2]]
    assert asked.count("word") == 1 and len(asked) == len(set(asked))
    assert "!!" in asked and "word!!" not in asked and "über" in asked
