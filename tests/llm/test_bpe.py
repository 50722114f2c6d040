"""Encoding, decoding and counting against the tokenizers library."""

import hashlib

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from tidemark.llm import bpe_codec, q_bpe, token_count
from tidemark.llm.pieces import all_characters

PATH = public_tokenizers.path("byte_bpe_50k.json")
LIBRARY = Tokenizer.from_file(PATH)
CODEC = bpe_codec.Codec(PATH, leaf=8)
COUNTER = token_count.Counter(PATH)

HARD = [
    "", " ", "  ", "\n", "a  b", "a \n b", "a\n \nb", "a\n  b ", " \n", "\t x  y", "it's  they'll 'S", "a" * 300, "ab" * 257,
    "你好" * 60, "\U0001f600‍" * 9, "x<|endoftext|>y", "<|endoftext|><|endoftext|> z <|endoftext|", " <|endoftext|> ",
    "1234567 890", "\x1c \x85 a", "  a", "....!!!!????" * 30, "thththththth" * 40, "a\r\n\r\n b", "é ́",
]


def ids(text):
    return LIBRARY.encode(text, add_special_tokens=False).ids


def agrees(text):
    want = ids(text)
    got = CODEC.encode(text)
    assert got.tolist() == want
    assert COUNTER.count(text) == len(want)
    assert CODEC.decode(got) == LIBRARY.decode(want, skip_special_tokens=False)
    assert CODEC.written(got).decode() == ",".join(map(str, want))


@pytest.mark.parametrize("text", HARD)
def test_hard_texts(text):
    agrees(text)


@settings(max_examples=300, deadline=None)
@given(st.text(st.sampled_from(list("ab tion'sE1.\n\té你 ")), max_size=80))
def test_small_alphabet(text):
    agrees(text)


@settings(max_examples=200, deadline=None)
@given(st.text(max_size=60))
def test_any_text(text):
    agrees(text)


@settings(max_examples=200, deadline=None)
@given(st.text(st.sampled_from(list("etaoinshr")), min_size=1, max_size=400), st.integers(1, 40))
def test_tree_equals_whole(text, leaf):
    v = CODEC.vocabulary
    assert bpe_codec.encode_piece(text.encode(), v, leaf) == bpe_codec.encode_leaf(text.encode(), v)


@pytest.mark.parametrize("before, after", [("a", "'s"), (" ", "\n1")])
def test_every_character(before, after):
    """Also those that the libraries' Unicode tables put into different classes."""
    every = all_characters()
    for at in range(0, len(every), 1 << 14):
        text = " ".join(before + c + after for c in every[at : at + (1 << 14)])
        want = ids(text)
        assert CODEC.encode(text).tolist() == want
        assert COUNTER.count(text) == len(want)


def test_queries_against_library(spark, sf):
    docs = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()}
    want = {i: ids(t) for i, t in docs.items()}
    for row in q_bpe.op6_bpe_codec(spark, sf).collect():
        own = want.pop(row.doc_id)
        assert row.n_tokens == len(own)
        assert row.ids_sha256 == hashlib.sha256(",".join(map(str, own)).encode()).hexdigest()
        text = LIBRARY.decode(own, skip_special_tokens=False)
        assert row.decoded_sha256 == hashlib.sha256(text.encode()).hexdigest()
    assert not want
    for row in q_bpe.op7_token_counts(spark, sf).collect():
        n = len(ids(docs[row.doc_id]))
        assert (row.n_bytes, row.n_tokens, row.over_limit) == (len(docs[row.doc_id].encode()), n, n > 1024)


def test_long_texts_in_parts(spark):
    long = [
        "the cat  sat \n on it " * 40, "x" * 900, "word " * 30 + "ab" * 400 + " end<|endoftext|> " + "q " * 200, "\n  \n" * 120, "a b" * 200,
    ]
    texts = [*long, None, "", "short", long[0]]
    docs = spark.createDataFrame([(i, t, "clash") for i, t in enumerate(texts)], "doc_id long, text string, ids string")
    got = sorted((r.doc_id, np.frombuffer(r.ids, "<u4").tolist()) for r in bpe_codec.encoded(docs, PATH, spread=100).collect())
    assert got == [(i, ids(t or "")) for i, t in enumerate(texts)]
    back = {r.doc_id: r.text for r in bpe_codec.decoded(bpe_codec.encoded(docs, PATH, spread=100), PATH).collect()}
    assert back == {i: LIBRARY.decode(ids(t or ""), skip_special_tokens=False) for i, t in enumerate(texts)}


def test_empty_table_and_repeats(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert bpe_codec.encoded(empty, PATH).count() == 0
    assert token_count.token_counts(empty, PATH).count() == 0
    twice = spark.createDataFrame([(1, "a b"), (1, "a b"), (2, None)], "doc_id long, text string")
    rows = sorted(tuple(r) for r in token_count.token_counts(twice, PATH).collect())
    assert rows == [(1, 3, 2), (1, 3, 2), (2, 0, 0)]
